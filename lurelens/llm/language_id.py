"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams, in order.  A document
is ranked the same way, over its whole text, and compared with each profile: an
n-gram costs the distance between its two ranks, or ``size`` if the profile
lacks it.  The language of the least sum is predicted.

Words are runs of letters and marks, lower-cased one by one, with a blank at
both ends; n-grams of one to three characters stay inside a word and its blanks,
so three code points of 21 bits name one without loss.  Equal counts are ordered
by n-gram.  Tasks count n-grams of each language before they hand them on, so a
language with most of the rows costs a row per n-gram and task; the first
``size`` are taken by a ranked limit that works ahead of the shuffle.  Profiles
are broadcast for at most about ``BLOCK_LANGUAGES`` languages at once; more of
them are compared in turns, each keeping the best so far.

Nulls and edge cases: a null text, a text without a letter, and any text where
no language was learned is ``und`` with score 0; documents without a language or
a letter teach nothing; a null id counts as empty text for the fold, so it
trains; of languages at equal distance the least name is taken; repeated rows
count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .text import slices, text_bytes

#: N-grams of a profile and of a document; languages compared at once; n-grams a task gathers before it hands them on.
SIZE, BLOCK_LANGUAGES, FLUSH_KEYS = 400, 256, 1_000_000
UNKNOWN = "und"
#: No character, and the blank at the ends of a word. No letter has these code points.
_NONE, _BLANK = 0, 1


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter or mark, else a blank; and whether it is a letter."""
    lower, letter = np.full(sys.maxunicode + 1, _BLANK, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            lower[i], letter[i] = ord(low) if len(low) == 1 else i, kind == "L"
    return lower, letter


def ngrams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row the names of all its n-grams, unsorted, and whether it has a letter."""
    lower, letter = _characters()
    data, offsets = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    n = len(heads) - 1
    lettered = np.diff(np.append(0, np.cumsum(letter[codes]))[heads]) > 0
    # A blank before and behind each row, then one of each run of blanks within a row.
    flat = np.full(len(codes) + 2 * n, _BLANK, np.uint64)
    flat[np.arange(len(codes)) + np.repeat(2 * np.arange(n) + 1, np.diff(heads))] = lower[codes]
    starts = heads[:-1] + 2 * np.arange(n)
    keep = np.append(True, (flat[1:] != _BLANK) | (flat[:-1] != _BLANK))[: len(flat)]
    keep[starts] = True
    place = np.append(0, np.cumsum(keep))
    borders = np.append(place[starts], place[-1])
    flat = flat[keep]
    one, two, three = flat, np.append(flat[1:], np.uint64(_BLANK)), np.append(flat[2:], np.full(2, _BLANK, np.uint64))[: len(flat)]
    full = one != _BLANK, (one != _BLANK) | (two != _BLANK), two != _BLANK
    names = one << np.uint64(42), one << np.uint64(42) | two << np.uint64(21), one << np.uint64(42) | two << np.uint64(21) | three
    # Runs of blanks stand only between rows, so no n-gram with a letter in each inner place reaches into the next row.
    cut = [np.append(0, np.cumsum(f))[borders] for f in full]
    kept = [x[f] for x, f in zip(names, full, strict=True)]
    return [np.concatenate([x[c[i] : c[i + 1]] for x, c in zip(kept, cut, strict=True)]) for i in range(n)], lettered


def _counted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.sort(names)
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
    return names[at], np.diff(np.append(at, len(names)))


def ranked(names: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, in order."""
    keys, counts = _counted(names)
    if len(keys) > size:
        # Only what reaches the count of the last place is sorted.
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")][:size]


def spelled(name: int) -> str:
    """The n-gram with this name, blanks as spaces."""
    codes = (name >> 42, name >> 21 & 0x1FFFFF, name & 0x1FFFFF)
    return "".join(" " if c == _BLANK else chr(c) for c in codes if c != _NONE)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each language with their number, summed over what a task has gathered."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> int:
        total = 0
        for lang, parts in held.items():
            if len(parts) > 1:
                keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                held[lang] = [(keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64))]
            total += len(held[lang][0][0])
        return total

    def batch_of() -> pa.RecordBatch:
        sizes = [len(parts[0][0]) for parts in held.values()]
        names = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        keys, counts = (np.concatenate([parts[0][i] for parts in held.values()]).astype(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([names, pa.array(keys), pa.array(counts)], ["lang", "key", "n"])

    for batch in batches:
        for part in slices(batch):
            rows, _ = ngrams(part.column(part.schema.names.index("text")))
            langs = part.column(part.schema.names.index("lang")).dictionary_encode()
            codes = np.asarray(langs.indices)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                found = _counted(np.concatenate([rows[i] for i in np.flatnonzero(codes == code)]))
                if len(found[0]):
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
            if size > FLUSH_KEYS and (size := merged()) > FLUSH_KEYS:
                yield batch_of()
                held.clear()
                size = 0
    if held:
        merged()
        yield batch_of()


def held_out(id_col: Column) -> Column:
    """Documents that no profile is learned from: a quarter, by the checksum of the id as text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``lang``, ``key`` and ``rank`` (from 0) of the ``size`` most frequent n-grams of each language of docs (lang, text)."""
    counts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_counts, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("lang", "key", (F.col("place") - 1).cast("int").alias("rank"))


class _Profiles:
    """Some languages' profiles, by n-gram."""

    def __init__(self, rows: pa.Table, size: int):
        self.size, self.langs = size, sorted(set(rows.column("lang").to_pylist()), key=str.encode)
        code = {x: i for i, x in enumerate(self.langs)}
        keys = rows.column("key").to_numpy().astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.of = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)[order]
        self.ranks = rows.column("rank").to_numpy().astype(np.int64)[order]

    def distances(self, names: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a document's n-grams, in order, to each language."""
        low, high = np.searchsorted(self.keys, names, "left"), np.searchsorted(self.keys, names, "right")
        found = high - low
        rank = np.repeat(np.arange(len(names)), found)
        at = np.arange(len(rank)) - np.repeat(np.cumsum(found) - found, found) + low[rank]
        saved = np.bincount(self.of[at], self.size - np.abs(self.ranks[at] - rank), len(self.langs))
        return len(names) * self.size - saved.astype(np.int64)


def _compare(table, size: int):
    """The nearest of some languages, unless the one found before is as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Profiles = table.value
        for batch in batches:
            for part in slices(batch):
                rows, lettered = ngrams(part.column(part.schema.names.index("text")))
                before = zip(*(part.column(part.schema.names.index(c)).to_pylist() for c in ("lang_pred", "distance")), strict=True)
                langs, distances, scores = [], [], []
                for row, has, (lang, distance) in zip(rows, lettered, before, strict=True):
                    score = 0.0
                    if has:
                        names = ranked(row, size)
                        d = own.distances(names)
                        k = int(d.argmin())
                        if distance is None or (int(d[k]), own.langs[k].encode()) < (distance, lang.encode()):
                            lang, distance = own.langs[k], int(d[k])
                        score = 1 - distance / (len(names) * size)
                    langs.append(lang)
                    distances.append(distance)
                    scores.append(score)
                same = [part.column(part.schema.names.index(c)) for c in ("doc_id", "text", "held_out")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(langs, pa.string()), pa.array(distances, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "text", "held_out", "lang_pred", "distance", "score"])

    return run


def classify(docs: DataFrame, learned: DataFrame, size: int = SIZE, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Adds ``lang_pred``, ``distance`` and ``score`` to docs (doc_id, text, held_out); ``learned`` are profiles.

    ``distance`` is null where nothing is compared; ``score`` is the share of the greatest possible distance that is saved.
    """
    names = learned.select("lang").distinct()
    turns = -(-names.count() // block)
    found = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "distance": F.lit(None).cast("long"), "score": F.lit(0.0)})
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, held_out boolean, lang_pred string, distance long, score double"
    for k in range(turns):
        # About ``block`` languages of ``size`` n-grams each.
        rows = learned.filter(F.pmod(F.xxhash64("lang"), F.lit(turns)) == k).toArrow()
        if rows.num_rows:
            found = found.mapInArrow(_compare(docs.sparkSession.sparkContext.broadcast(_Profiles(rows, size)), size), fields)
    return found.withColumn("lang_pred", F.coalesce("lang_pred", F.lit(UNKNOWN)))


def identify(docs: DataFrame, size: int = SIZE, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``distance`` for every row of docs (doc_id, text, lang); learned from rows that are not held out."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    learned = Scratch(docs.sparkSession, "language-id").save(profiles(own.filter("NOT held_out"), size), "profiles")
    return classify(own.select("doc_id", "text", "held_out"), learned, size, block).select("doc_id", "held_out", "lang_pred", "score", "distance")
