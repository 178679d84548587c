"""Benchmark decontamination with spaced seeds.

A spaced seed hashes the words at fixed places of a window and ignores the
others, so a replaced word spoils only the windows that look at it.  Seeds of
all items and of all documents are joined by their hashes; a bit table of the
items' seeds, of a bounded size, spares the join those of documents that meet
none.  Around each hit the item is laid over the document and compared word by
word: the best run, where a match counts 1 and a replaced word costs
``penalty``, must hold ``least_words`` matches.

An item of which ``percent`` are no more than ``least_words`` words must have
that share of its words in place, wherever the replaced ones are, and one
shorter than the shortest seed all of them.  It is cut into one more piece than
words may be replaced, so one piece stands whole, and pieces are joined like
seeds.

Texts and items of equal words are compared once, whatever their number: they
go by a hash of all their words until the overlaps are known.  A seed, text or
item with more than ``hot_rows`` rows is dealt over parts in each join.
Documents are read twice, for their seeds and for the words of those that met one.

Nulls and edge cases: null or empty texts on either side match nothing; the
part of an item that a document's beginning or end cuts off counts as replaced;
null ids on either side are carried; repeated rows on either side give repeated
rows; either table may be empty; other columns are ignored.  Words are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import ALNUM, BitTable, Words, grams, mix, quoted, sequence_names, slices

#: Fixed masks over windows of words: 1 looks at a word, 0 ignores it.
MASKS = ("111111", "11010111", "110010111", "1110100101", "101100011001", "1011010011")
LEAST_WORDS, PENALTY, PERCENT, HOT_ROWS = 13, 2, 80, 50_000
_WEIGHTS = np.random.default_rng(99).integers(0, 2**63, (len(MASKS), 16), dtype=np.uint64) | np.uint64(1)
#: The bit table of seeds has 64 MB at most.
_MOST_BITS = 29


def _seeds(hashes: np.ndarray, k: int) -> np.ndarray:
    mask = MASKS[k]
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j, look in enumerate(mask):
        if look == "1":
            total += hashes[j : n + j] * _WEIGHTS[k, j]
    return mix(total)


def _demand(n: int, least_words: int, percent: int) -> tuple[bool, int]:
    """Whether an item of n words is a short one, and how many of its words must be in place."""
    share = -(-n * percent // 100)
    few = n < min(map(len, MASKS))
    return few or share <= least_words, min(n if few else share, least_words)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with a name of their words, the number of these and their hashes; texts without words are left out."""
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column(1), ALNUM)
            hashes, sizes = words.hashes(), np.diff(words.rows)
            own = np.flatnonzero(sizes)
            blobs = [hashes[words.rows[i] : words.rows[i + 1]].tobytes() for i in own]
            cols = [part.column(0).take(pa.array(own)), pa.array(sequence_names(hashes, words.rows)[own].view(np.int64)), pa.array(sizes[own].astype(np.int32)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "name", "n", "words"])


def _item_seeds(least_words: int, percent: int):
    """The seeds of long items and the pieces of short ones with the word each begins at; width is 0 for seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for name, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes = np.frombuffer(blob, np.uint64)
                short, demand = _demand(n, least_words, percent)
                if short:
                    parts = n - demand + 1
                    cuts = [n * k // parts for k in range(parts + 1)]
                    found = [(grams(hashes[a:z], z - a), np.array([a]), z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                else:
                    found = [(keys, np.arange(len(keys)), 0) for keys in (_seeds(hashes, k) for k in range(len(MASKS)))]
                for keys, places, width in found:
                    for col, values in zip(out, (keys.view(np.int64), np.full(len(keys), name), places, np.full(len(keys), width)), strict=True):
                        col.append(values)
            cols = [np.concatenate(c) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], ["key", "item", "place", "width"])

    return run


def _hits(table, masks: bool, widths: list[int]):
    """The windows of documents whose seed or piece an item may have: key, text and the word it begins at; equal texts of a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(0), ALNUM)
                hashes = words.hashes()
                names = sequence_names(hashes, words.rows)
                first = np.zeros(len(names), bool)
                first[np.unique(names, return_index=True)[1]] = True
                out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                looks = [(len(mask), lambda k=k: _seeds(hashes, k)) for k, mask in enumerate(MASKS) if masks] + [(n, lambda n=n: grams(hashes, n)) for n in widths]
                for width, look in looks:
                    keys = look()
                    at = np.flatnonzero(known.holds(keys))
                    row = np.searchsorted(words.rows, at, "right") - 1
                    whole = (at + width <= words.rows[row + 1]) & first[row]
                    at, row = at[whole], row[whole]
                    out.append((keys[at], names[row], at - words.rows[row]))
                keys, texts, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(texts.view(np.int64)), pa.array(at.astype(np.int32))], ["key", "text", "at"])

    return run


def _fetch(table):
    """The rows whose text may be wanted; the words only once for equal texts of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), ALNUM)
                hashes = words.hashes()
                names = sequence_names(hashes, words.rows)
                own = np.flatnonzero(wanted.holds(names) & (np.diff(words.rows) > 0))
                new = np.zeros(len(names), bool)
                new[np.unique(names, return_index=True)[1]] = True
                blobs = [hashes[words.rows[i] : words.rows[i + 1]].tobytes() if new[i] else None for i in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(names[own].view(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "text", "words"])

    return run


def _overlap(same: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """Most matches in a run worth at least one match for each ``penalty``: matches, first place, place after the last."""
    run = np.append(0, np.cumsum(np.where(same, 1, -penalty)))
    end = int((run - np.minimum.accumulate(run)).argmax())
    begin = int(run[: end + 1].argmin())
    return int(same[begin:end].sum()), begin, end


def _verify(least_words: int, penalty: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, item, shift, n, own, theirs in zip(*(batch.column(c).to_pylist() for c in ("text", "item", "shift", "n", "own", "theirs")), strict=True):
                here = np.frombuffer(own, np.uint64)
                begin = max(shift, 0)
                same = here == np.frombuffer(theirs, np.uint64)[begin - shift : begin - shift + len(here)]
                short, demand = _demand(n, least_words, percent)
                if short:
                    places = np.flatnonzero(same)
                    matched, a, z = len(places), *((int(places[0]), int(places[-1]) + 1) if len(places) else (0, 0))
                else:
                    matched, a, z = _overlap(same, penalty)
                if matched >= demand and matched:
                    out.append((text, item, n, matched, a + begin, z + begin))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["text", "item", "n", "matched", "first", "end"])

    return run


def _dealt_join(scratch: Scratch, many: DataFrame, few: DataFrame, key: str, by: tuple[str, ...], hot_rows: int) -> DataFrame:
    """Inner join on a key; a key with more than ``hot_rows`` rows on the left is dealt over parts, and its rows on the right go to each."""
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = scratch.save(hot.select(key, F.ceil(F.col("_n") / hot_rows).alias("_parts")), f"hot-{key}-{'-'.join(by)}")
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts)).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def _overlapping(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, least_words: int, penalty: int, percent: int, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, text) and (item_id, text): overlaps of texts and items by name, the rows of the texts in question, and those of the items."""
    spark = docs.sparkSession
    items = scratch.save(benchmark.mapInArrow(_named, "id long, name long, n int, words binary"), "items")
    distinct = items.groupBy(F.col("name").alias("item")).agg(F.first("n").alias("n"), F.first("words").alias("theirs"))
    seeds = scratch.save(distinct.select("item", "n", "theirs").mapInArrow(_item_seeds(least_words, percent), "key long, item long, place int, width int"), "seeds")
    # Widths of pieces are less than an item of least_words words is long, so they are few.
    kinds = {r["width"]: r["n"] for r in seeds.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(BitTable(seeds, "key", sum(kinds.values()), most_bits=_MOST_BITS, probes=2))
    hits = docs.select("text").mapInArrow(_hits(table, 0 in kinds, sorted(set(kinds) - {0})), "key long, text long, at int")
    hits = scratch.save(hits, "hits")
    met = _dealt_join(scratch, hits, seeds.select("key", "item", "place"), "key", ("text", "at"), hot_rows)
    found = scratch.save(met.select("text", "item", (F.col("at") - F.col("place")).alias("shift")).distinct(), "candidates")
    texts = found.select("text").distinct()
    wanted = spark.sparkContext.broadcast(BitTable(texts, "text", texts.count(), most_bits=_MOST_BITS))
    rows = scratch.save(docs.select("doc_id", "text").mapInArrow(_fetch(wanted), "doc_id long, text long, words binary"), "rows")
    words = rows.filter("words is not null").groupBy("text").agg(F.first("words").alias("words"))
    laid = _dealt_join(scratch, found, distinct, "item", ("text", "shift"), hot_rows)
    laid = _dealt_join(scratch, scratch.save(laid, "laid"), words, "text", ("item", "shift"), hot_rows)
    begin, end = F.greatest("shift", F.lit(0)), F.least(F.col("shift") + F.col("n"), (F.octet_length("words") / 8).cast("int"))
    cut = laid.filter(begin < end).select("text", "item", "shift", "n", F.substring("words", begin * 8 + 1, (end - begin) * 8).alias("own"), "theirs")
    ran = cut.mapInArrow(_verify(least_words, penalty, percent), "text long, item long, n long, matched long, first long, end long")
    best = ran.groupBy("text", "item", "n").agg(F.max(F.struct("matched", (-F.col("first")).alias("first"), "end")).alias("b"))
    return scratch.save(best.select("text", "item", "n", "b.*"), "overlaps"), rows, items


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, penalty: int = PENALTY, percent: int = PERCENT, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched words, the item's words, and the run's words in the document."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    theirs = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    overlaps, rows, items = _overlapping(own, theirs, scratch, least_words, penalty, percent, hot_rows)
    told = overlaps.join(items.select(F.col("id").alias("item_id"), F.col("name").alias("item")), "item")
    met = _dealt_join(scratch, rows.select("doc_id", "text"), told, "text", ("doc_id",), hot_rows)
    return met.select("doc_id", "item_id", F.col("matched").alias("matched_words"), F.col("n").alias("item_words"), (-F.col("first")).alias("first_word"), F.col("end").alias("end_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, penalty: int = PENALTY, percent: int = PERCENT, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns.

    Rows are told by their text, so those that share an id, or have none, are judged each by itself.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    theirs = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    bad = _overlapping(own, theirs, scratch, least_words, penalty, percent, hot_rows)[0].select(F.col("text").alias("_name")).distinct()
    bad = scratch.save(bad, "bad")
    table = docs.sparkSession.sparkContext.broadcast(BitTable(bad, "_name", bad.count(), most_bits=_MOST_BITS))

    def name(texts: pa.Array) -> pa.Array:
        """The name of a text that may overlap, null for others."""
        out = [pa.array([], pa.int64())]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            words = Words(part.column(0), ALNUM)
            names = sequence_names(words.hashes(), words.rows)
            out.append(pa.array(names.view(np.int64), mask=~table.value.holds(names)))
        return pa.concat_arrays(out)

    # Columns travel in a struct, so that none can clash with the names used here.
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_doc"), F.arrow_udf(name, "long")(F.col(quoted(text_col))).alias("_name"))
    # Only rows that may overlap are shuffled, dealt over 16 parts whatever their text.
    parts = 16
    asked = named.filter("_name is not null").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    told = bad.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kept = named.filter("_name is null").select("_doc").union(asked.join(told, ["_name", "_part"], "left_anti").select("_doc"))
    return kept.select(*(F.col(f"_doc.{quoted(c)}").alias(c) for c in docs.columns))
