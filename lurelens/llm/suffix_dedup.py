"""Repeated passages by a sparse suffix array.

Suffixes are retained only where a minimiser stands: the smallest hash of a
``gram`` of words among those inside a window of ``least_words`` words.  Every
passage of that length has one, chosen by its content, so both copies of a
passage retain the same place.  Suffixes whose gram occurs once are dropped.
Each of the others goes on with the words around it that its windows reach: to
the right of the minimiser and to the left.

Suffixes of one gram are sorted by the words on their right, and once more by
the words on their left, read backwards.  Neighbours in either order tell how
many words agree on that side.  A window of ``least_words`` words that begins
``a`` words before the minimiser is repeated where two suffixes lie in one run
of the right order that agrees in ``least_words - a`` words, and in one run of
the left order that agrees in ``a``.  Marked windows of a document join to
spans, so a match is as long as the texts agree, to the left and to the right.

A gram with more than ``hot`` suffixes is dealt out over parts, more of them the
more suffixes it has.  Each part is sorted and compared in the same way; suffixes
with equal surroundings become one there, with a count and the first of them, and
only the windows of those are compared across parts, under 64-bit names.

Which grams are common is told to the tasks by bit tables of a fixed size; one
that is wrongly told to be common only ships suffixes in vain.  Words are compared
by 32 bits of their hash, grams by 64.

Nulls and edge cases: null, empty and short texts have no passages; a passage
repeated inside one document counts; a null id is carried, and comes after all
others when the first occurrence is chosen; rows that repeat an id are
documents of their own, whose spans come out in rows of their own under that
id; very long texts are handled row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .text import BitTable, Words, grams, mix, quoted, slices

LEAST_WORDS, GRAM, HOT, SALTS = 50, 20, 20_000, 32
#: Suffixes that are compared at once, about; a gram's part is never cut.
BATCH = 8192

_SUFFIX = "gram long, salt int, doc long, no_id boolean, row long, place int, first int, words binary"
_FOUND = "kind int, no_id boolean, doc long, row long, first int, last int, lead boolean, gram long, salt int, context long, n int, windows binary"


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of ``width`` values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(h))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        covered += step
    return best[:n]


def _minimisers(hashes: np.ndarray, least_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each retained place: the place, its gram, and the first and last window start that it stands for."""
    every = grams(hashes, gram)
    chosen = _smallest(every, least_words - gram + 1)
    first = np.append(0, np.flatnonzero(np.diff(chosen)) + 1)
    last = np.append(first[1:], len(chosen)) - 1
    return chosen[first], every[chosen[first]], first, last


def _documents(part: pa.RecordBatch, least_words: int) -> Iterator[tuple[int, np.ndarray]]:
    words = Words(part.column(part.schema.names.index("text")))
    hashes = words.hashes()
    for row, (a, z) in enumerate(zip(words.rows[:-1], words.rows[1:], strict=True)):
        if z - a >= least_words:
            yield row, hashes[a:z]


def _retain(least_words: int, gram: int):
    """The grams of retained suffixes with their numbers in a slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = [np.zeros(0, np.uint64)]
                for _, hashes in _documents(part, least_words):
                    keys.append(_minimisers(hashes, least_words, gram)[1])
                own, counts = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts.astype(np.int32))], ["gram", "n"])

    return run


def _ship(least_words: int, gram: int, tables):
    """Suffixes whose gram may be common, with the words that their windows reach; those of hot grams are dealt over salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, *levels = tables.value
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part in slices(batch):
                docs, rows = part.column(0).to_pylist(), part.column(1).to_numpy()
                cols: list[list] = [[] for _ in kinds]
                for at, hashes in _documents(part, least_words):
                    place, keys, first, last = _minimisers(hashes, least_words, gram)
                    own = np.flatnonzero(common.holds(keys))
                    if not len(own):
                        continue
                    codes = np.maximum(hashes >> np.uint64(32), np.uint64(1)).astype("<u4")
                    spread = np.zeros(len(own), np.int64)
                    for k, table in enumerate(levels):
                        spread = np.where(table.holds(keys[own]), SALTS ** (k + 1), spread)
                    turn = (mix(np.uint64(rows[at]) + place[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)
                    salt = np.where(spread > 0, turn % np.maximum(spread, 1), -1)
                    cols[0] += keys[own].view(np.int64).tolist()
                    cols[1] += salt.tolist()
                    cols[2] += [docs[at] or 0] * len(own)
                    cols[3] += [docs[at] is None] * len(own)
                    cols[4] += [int(rows[at])] * len(own)
                    cols[5] += place[own].tolist()
                    cols[6] += first[own].tolist()
                    cols[7] += [codes[a : z + least_words].tobytes() for a, z in zip(first[own], last[own], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in _SUFFIX.split(", ")])

    return run


class _Suffixes:
    """Suffixes of whole groups (one gram and salt each) in both orders."""

    def __init__(self, table: pa.Table, least_words: int, gram: int):
        column = lambda name: table.column(name).to_numpy()
        self.least = least_words
        self.gram, self.salt, self.doc, self.no_id, self.row, self.place, first = (column(c) for c in ("gram", "salt", "doc", "no_id", "row", "place", "first"))
        self.n = table.num_rows
        self.group = np.cumsum(np.append(False, (self.gram[1:] != self.gram[:-1]) | (self.salt[1:] != self.salt[:-1])))
        words = table.column("words").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        ends = np.frombuffer(words.buffers()[1], np.int32, self.n + 1 + words.offset)[words.offset :].astype(np.int64) // 4
        self.codes = np.frombuffer(words.buffers()[2], "<u4")
        self.begin, size = ends[:-1], np.diff(ends)
        #: Words before the minimiser for the first window, and for the last.
        self.most = (self.place - first).astype(np.int64)
        self.fewest = self.most - (size - least_words)
        reach = least_words - gram
        self.right = self._side(self.begin + self.most, np.arange(least_words), size - self.most)
        self.left = self._side(self.begin + self.most - 1, -np.arange(reach), self.most)

    def _side(self, start: np.ndarray, steps: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.clip(start[:, None] + steps, 0, max(len(self.codes) - 1, 0))
        # No word has the code 0, which stands after the last.
        return np.where(np.abs(steps) < size[:, None], self.codes[at], np.uint32(0))

    def ordered(self, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by group and the words of a side, and for each how many of these it shares with the one before it; -1 for the first of a group."""
        keys = np.empty((self.n, side.shape[1] + 1), ">u4")
        keys[:, 0], keys[:, 1:] = self.group, side
        order = np.argsort(keys.view(f"S{4 * keys.shape[1]}").ravel(), kind="stable")
        here = side[order]
        differ = here[1:] != here[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), side.shape[1])
        shared[self.group[order][1:] != self.group[order][:-1]] = -1
        return order, np.append(-1, shared)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The repeated windows: suffix, words before its minimiser, and whether it is the first of its class."""
        rank = np.empty(self.n, np.int64)
        rank[np.lexsort((self.place, self.row, self.doc, self.no_id))] = np.arange(self.n)
        orders, near = [], []
        for side in (self.right, self.left):
            order, shared = self.ordered(side)
            best = np.empty(self.n, np.int64)
            best[order] = np.maximum(shared, np.append(shared[1:], -1))
            orders.append((order, shared))
            near.append(best)
        out: list[list[np.ndarray]] = [[], [], []]
        for before in range(int(self.fewest.min()), int(self.most.max()) + 1):
            after = self.least - before
            own = np.flatnonzero((self.fewest <= before) & (before <= self.most) & (near[0] >= after) & (near[1] >= before))
            if len(own) < 2:
                continue
            name = np.zeros(self.n, np.int64)
            for (order, shared), least in zip(orders, (after, before), strict=True):
                run = np.empty(self.n, np.int64)
                run[order] = np.cumsum(shared < least)
                name = name * (self.n + 1) + run
            own = own[np.lexsort((rank[own], name[own]))]
            same = name[own][1:] == name[own][:-1]
            again = np.append(False, same)
            marked = again | np.append(same, False)
            out[0].append(own[marked])
            out[1].append(np.full(int(marked.sum()), before))
            out[2].append(~again[marked])
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)

    def marks(self) -> pa.RecordBatch:
        """Rows of kind 0: runs of starts of repeated windows."""
        suffix, before, lead = self.windows()
        start = self.place[suffix].astype(np.int64) - before
        order = np.lexsort((start, suffix))
        suffix, start, lead = suffix[order], start[order], lead[order]
        new = (suffix[1:] != suffix[:-1]) | (start[1:] != start[:-1] + 1) | (lead[1:] != lead[:-1])
        at = np.flatnonzero(np.append(True, new)) if len(start) else np.zeros(0, np.int64)
        end = np.append(at[1:], len(start)) - 1 if len(at) else at
        own = suffix[at]
        return _rows(0, self.no_id[own], self.doc[own], self.row[own], start[at], start[end], lead[at].astype(bool))

    def contexts(self) -> list[pa.RecordBatch]:
        """Rows of kind 1, the suffixes with their surroundings' name, and of kind 2, a row for each of these: its number, its first suffix and its windows' names."""
        both = np.concatenate([self.right, self.left, self.most[:, None].astype(np.uint32), self.fewest[:, None].astype(np.uint32)], 1)
        order, shared = self.ordered(both)
        equal = shared == both.shape[1]
        borders = np.flatnonzero(~equal)
        label = np.empty(self.n, np.int64)
        label[order] = np.cumsum(~equal) - 1
        sizes = np.diff(np.append(borders, self.n))
        every = np.lexsort((self.place, self.row, self.doc, self.no_id, label))
        least = every[np.append(0, np.cumsum(sizes)[:-1])]
        names, blobs = [], []
        for k in least:
            a, before, size = self.begin[k], self.most[k], self.least + self.most[k] - self.fewest[k]
            own = grams(mix(self.codes[a : a + size].astype(np.uint64) + np.uint64(0x51ED27)), self.least)
            blobs.append(own.tobytes())
            names.append(int(mix((own.sum(keepdims=True) + np.uint64(before)) * np.uint64(0x9E3779B97F4A7C15) + own[:1]).view(np.int64)[0]))
        names = np.array(names, np.int64)
        members = _rows(1, self.no_id, self.doc, self.row, self.place, self.most, np.zeros(self.n, bool), self.gram, self.salt, names[label])
        told = _rows(2, self.no_id[least], self.doc[least], self.row[least], self.place[least], self.most[least], np.zeros(len(least), bool), self.gram[least], self.salt[least], names, sizes, blobs)
        return [members, told]


def _rows(kind, no_id, doc, row, first, last, lead, gram=None, salt=None, context=None, n=None, windows=None) -> pa.RecordBatch:
    size = len(doc)
    some = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    arrays = [pa.array(np.full(size, kind, np.int32)), pa.array(no_id, pa.bool_()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(np.asarray(first, np.int32)), pa.array(np.asarray(last, np.int32)), pa.array(lead, pa.bool_())]
    arrays += [some(gram, pa.int64()), some(salt, pa.int32()), some(context, pa.int64()), some(n if n is None else np.asarray(n, np.int32), pa.int32()), some(windows, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _FOUND.split(", ")])


def _compare(least_words: int, gram: int):
    """Suffixes sorted by gram and salt: whole groups are gathered, put in both orders and compared."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # One that is alone in its group was told to be common in vain, unless others are in other parts.
        gram_, salt = table.column("gram").to_numpy(), table.column("salt").to_numpy()
        new = np.flatnonzero(np.append(True, (gram_[1:] != gram_[:-1]) | (salt[1:] != salt[:-1])))
        sizes = np.diff(np.append(new, len(gram_)))
        of = np.repeat(sizes, sizes)
        for own, hot in (((salt < 0) & (of > 1), False), (salt >= 0, True)):
            if own.any():
                suffixes = _Suffixes(table.filter(pa.array(own)), least_words, gram)
                yield from suffixes.contexts() if hot else [suffixes.marks()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH:
                continue
            table = pa.Table.from_batches(held)
            gram_, salt = table.column("gram").to_numpy(), table.column("salt").to_numpy()
            cut = int(np.searchsorted(gram_, gram_[-1], "left"))
            cut += int(np.searchsorted(salt[cut:], salt[-1], "left"))
            if cut:
                yield from done(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield from done(pa.Table.from_batches(held))

    return run


def _spans(least_words: int):
    """Marked windows of a document, joined: a row for each span of words, and whether all of it is a first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, row, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "runs")), strict=True):
                for lead in (False, True):
                    end = -1
                    for r in sorted((r["first"], r["last"]) for r in runs if r["lead"] == lead):
                        a, z = r[0], r[1] + least_words
                        if a <= end:
                            out[3][-1] = end = max(end, z)
                        else:
                            for k, x in enumerate((doc, row, a, z, lead)):
                                out[k].append(x)
                            end = z
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.bool_()), strict=True)], ["doc_id", "row", "first_word", "end_word", "is_first"])

    return run


def _across(found: DataFrame) -> DataFrame:
    """Runs of marks of suffixes that were dealt out: windows are counted over all parts by what each part tells of them."""
    first = F.struct("no_id", "doc", "row", F.col("first").alias("place"))
    told = found.filter("kind = 2").select("gram", "salt", "context", "n", first.alias("first"), "last", "windows")
    # The windows of a suffix, from its leftmost: k is the place among them, so last - k words stand before the minimiser.
    each = F.transform(F.sequence(F.lit(0), (F.octet_length("windows") / 8).cast("int") - 1), lambda k: F.struct((F.col("last") - k).alias("before"), F.hex(F.substring("windows", k * 8 + 1, F.lit(8))).alias("window")))
    told = told.withColumn("w", F.explode(each)).select("gram", "salt", "context", "n", "first", "w.before", "w.window")
    # A class has at most one row of each surroundings in each part.
    total = told.groupBy("gram", "before", "window").agg(F.sum("n").alias("total"), F.min("first").alias("least")).filter("total > 1")
    met = told.join(total, ["gram", "before", "window"]).select("gram", "salt", "context", "before", "least")
    island = F.col("before") - F.row_number().over(Window.partitionBy("gram", "salt", "context", "least").orderBy("before"))
    runs = met.withColumn("island", island).groupBy("gram", "salt", "context", "least", "island").agg(F.min("before").alias("low"), F.max("before").alias("high"))
    # A row for each surroundings, so a suffix meets one; it has at most as many runs as windows.
    runs = runs.groupBy("gram", "salt", "context").agg(F.collect_list(F.struct("least", "low", "high")).alias("told"))
    members = found.filter("kind = 1").select("gram", "salt", "context", "no_id", "doc", "row", F.col("first").alias("place"))
    marks = members.join(runs, ["gram", "salt", "context"])
    own = F.struct("no_id", "doc", "row", "place")
    told = F.transform("told", lambda r: F.struct((F.col("place") - r["high"]).alias("first"), (F.col("place") - r["low"]).alias("last"), (own == r["least"]).alias("lead")))
    return marks.select("no_id", "doc", "row", told.alias("runs"))


def _spans_of_rows(frame: DataFrame, least_words: int, gram: int, hot: int) -> DataFrame:
    """``repeated_spans`` of a frame with doc, row (a number for each row) and text, with the row's number."""
    spark = frame.sparkSession
    scratch = Scratch(spark, "suffixes")
    # Null ids go through all steps, so the texts are what is filtered.
    frame = frame.filter("text is not null")
    retained = frame.select("text").mapInArrow(_retain(least_words, gram), "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))
    common = scratch.save(retained.filter("n > 1"), "common")
    seen = common.agg(F.count(F.lit(1)).alias("grams"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    tables, bound = [BitTable(common, "gram", seen["grams"])], hot
    while seen["most"] > bound:
        often = common.filter(F.col("n") > bound)
        tables.append(BitTable(often, "gram", often.count()))
        bound *= SALTS
    suffixes = frame.select("doc", "row", "text").mapInArrow(_ship(least_words, gram, spark.sparkContext.broadcast(tables)), _SUFFIX)
    found = suffixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(_compare(least_words, gram), _FOUND)
    found = scratch.save(found, "found")
    marks = found.filter("kind = 0").select("no_id", "doc", "row", F.array(F.struct("first", "last", "lead")).alias("runs"))
    if len(tables) > 1:
        marks = marks.union(_across(found))
    runs = marks.groupBy(F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return runs.mapInArrow(_spans(least_words), "doc_id long, row long, first_word long, end_word long, is_first boolean")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words of which every ``least_words`` in a row occur elsewhere too: doc_id, first_word, end_word, is_first.

    A window's first occurrence is that with the smallest id, then row, then place.  Spans
    of first occurrences and of later ones are separate rows and may overlap.
    """
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return _spans_of_rows(frame, least_words, gram, hot).drop("row")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for part in slices(pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])):
        words = Words(part.column(0))
        for row, (own, text) in enumerate(zip(part.column(1).to_pylist(), part.column(0), strict=True)):
            if own is None:
                out.append(text.as_py())
                continue
            a, z = words.offsets[row], words.offsets[row + 1]
            keep = np.ones(z - a, bool)
            base = words.rows[row]
            for s in own:
                keep[words.starts[base + s["first_word"]] - a : words.ends[base + s["end_word"] - 1] - a] = False
            out.append(words.bytes[a:z][keep].tobytes().decode())
    return pa.array(out, pa.string())


def cut_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every later occurrence of a repeated passage cut from the text, and all their columns; first occurrences stay.

    Rows are written once with a number each, by which cuts find their row, so
    rows that share an id, or have none, are cut each by itself.  Null, empty
    and short texts stay as they are; an ``n_chars`` column follows the text.
    """
    scratch = Scratch(docs.sparkSession, "suffixes-cut")
    # Columns travel in a struct, so that none can clash with the names used here.
    rows = scratch.save(docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    text = F.col(f"_doc.{quoted(text_col)}")
    frame = rows.select(F.col(f"_doc.{quoted(id_col)}").cast("long").alias("doc"), F.col("_row").alias("row"), text.alias("text"))
    later = _spans_of_rows(frame, least_words, gram, hot).filter("not is_first")
    later = scratch.save(later.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("first_word", "end_word")).alias("_spans")), "later")
    cut = F.arrow_udf(_cut, "string")
    met = rows.join(later, "_row", "left").withColumn("_text", cut(text, F.col("_spans")))
    own = {c: F.col(f"_doc.{quoted(c)}") for c in docs.columns} | {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return met.select(*(value.alias(c) for c, value in own.items()))
