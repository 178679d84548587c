"""Best-fit packing of token sequences by exact-complement hashing.

The histogram of piece lengths (at most ``capacity`` entries, whatever the
input's size) is all that reaches the driver.  There, for the longest length
left, the gap to a full sequence is looked up in an index of the sums of one, two and
three available lengths; a combination that fills it is used as often as the
counts allow.  Lengths without one go to best-fit decreasing.  The result is a
list of patterns with multiplicities, so its size does not grow with the input.
Pieces are numbered within their length class and find their slot by a join.

Nulls and edge cases: a null text counts as empty, so it packs as the lone end
id; a null id is carried through; repeated rows are packed once each; an empty
table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch
from .text import NOT_SPACE, slices

#: Cached words per task; the cache starts anew beyond it.
CACHE_WORDS = 300_000
#: Bytes of text handled at once: each word is an object for a moment.
SLICE_BYTES = 1 << 19
#: Pieces of one length that are numbered in one task.
RANK_ROWS = 100_000


class _Memo(dict):
    """Token ids of a unit of text as little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[str], list[int]], prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = _as_bytes(self.encode(self.prefix + unit))
        if len(unit) <= 64:
            self[unit] = ids
        return ids


def _as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _word_encoder(tokenizer) -> Callable[[str], list[int]]:
    """Encodes text without special tokens in it.

    The ids of a byte-level BPE vocabulary in merge order are its merge ranks, so
    the same merges can run in a faster library; words of the vocabulary and of
    many kinds are compared first, and any difference keeps the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken

    slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain, strict=True)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words = [w for w in tokenizer.get_vocab() if w not in special]
    if not all(c in letters for w in words for c in w):
        return slow
    ranks = {bytes(letters[c] for c in w): tokenizer.token_to_id(w) for w in words}
    if not all(bytes([b]) in ranks for b in range(256)):
        return slow
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    probes = [" ".join(w.decode("utf-8", "ignore") for w in list(ranks)[k::199]) for k in range(199)] + ["it's  12,5\n\t x", "\u00a0\u2003y \u0905\u093f \U0001f600!"]
    return fast if all(fast(x) == slow(x) for x in probes) else slow


_ENCODERS: dict[str, Callable[[list[str]], list[bytes]]] = {}
#: White space beyond ASCII begins with one of these bytes in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_TWO_SPACES = re.compile(r"\s\s").search


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Token ids of whole texts by the tokenizer file at ``path``, through a memo of words.

    The byte-level pattern never joins what a single space parts, so a text is
    encoded word by word, each with the space before it.  A text with two white
    spaces in a row, or which holds a special token, is encoded as a whole.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode = _word_encoder(tokenizer)
        special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        first, later = _Memo(encode, ""), _Memo(encode, " ")

        def ids(texts: list[str]) -> list[bytes]:
            joined = "\x00".join(texts)
            data = np.frombuffer(joined.encode(), np.uint8)
            blank = ~NOT_SPACE[data]
            odd = bool((blank[1:] & blank[:-1]).any()) or bool(_WIDE_SPACE.search(data))
            named = bool(special(joined))
            out = []
            for text in texts:
                if named and special(text):
                    out.append(_as_bytes(tokenizer.encode(text, add_special_tokens=False).ids))
                elif odd and _TWO_SPACES(text):
                    out.append(_as_bytes(encode(text)))
                else:
                    head, *rest = text.split(" ")
                    out.append(first[head] + b"".join(map(later.__getitem__, rest)))
            return out

        def forget() -> None:
            """Gives back what a task has gathered, so that an idle worker holds little beside the next stage."""
            first.clear()
            later.clear()
            pa.default_memory_pool().release_unused()

        ids.forget = forget
        _ENCODERS[path] = ids
    return _ENCODERS[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                out: list[tuple] = []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, data in zip(part.column(0).to_pylist(), ids(texts), strict=True):
                    data += closing
                    n = len(data) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = data[4 * a : 4 * z]
                        out.append((doc, k, a, z - a, zlib.crc32(own), own))
                cols = list(zip(*out, strict=True)) or [[]] * 6
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(np.frombuffer(b"".join(cols[5]), "<u4")).cast(pa.int32())], [*names, "ids"]
                    flat = arrays.pop()
                    ends = np.cumsum([0, *cols[3]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                yield pa.RecordBatch.from_arrays(arrays, names)
        ids.forget()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut, and their first piece is the short one."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), fields)


class _Sums:
    """Index of the sums of one, two and three lengths under availability counts.

    Counts only fall, so what has run out is left behind for good: each sum
    keeps its pairs, the most even first, and the place up to which its triples are spent.
    """

    def __init__(self, free: np.ndarray):
        self.free, self.pairs, self.spent = free, {}, {}

    def _there(self, *parts: int) -> bool:
        return all(self.free[x] >= parts.count(x) for x in parts)

    def _pair(self, total: int, most: int, also: tuple[int, ...] = ()) -> tuple[int, ...]:
        if total not in self.pairs:
            high = np.arange((total + 1) // 2, max(total, 0))
            self.pairs[total] = high[(self.free[high] > 0) & (self.free[total - high] > 0)].tolist()[::-1]
        known = self.pairs[total]
        while known and not self._there(known[-1], total - known[-1]):
            known.pop()
        for high in reversed(known):
            if high > most:
                break
            if self._there(high, total - high, *also):
                return high, total - high
        return ()

    def filling(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths whose sum is the gap; empty if there are none.

        Sums of even parts come first, since short pieces fit in more places later.
        """
        if gap <= 0:
            return ()
        if self.free[gap]:
            return (gap,)
        if found := self._pair(gap, gap):
            return found
        for first in range(self.spent.get(gap, -(-gap // 3)), gap - 1):
            self.spent[gap] = first
            if self.free[first] and (found := self._pair(gap - first, first, (first,))):
                return first, *found
        self.spent[gap] = gap
        return ()


Plan = list[tuple[tuple[int, ...], int]]


def packing_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns of lengths and how many sequences follow each.

    A length without an exact combination can wait for the best-fit pass, or
    take at once the fullest combination that leaves at most ``slack`` unused,
    while short pieces are still there.  Of a few slacks the plan with the
    fewest sequences is kept; all begin with exact complements, and 0 is exact filling alone.
    """
    plans = [_plan(histogram, capacity, slack) for slack in (0, 4, 32, capacity)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], capacity: int, slack: int) -> Plan:
    free = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        free[length] = n
    plan: Plan = []
    sums = _Sums(free)
    rest: dict[int, int] = {}
    if free[capacity]:
        plan.append(((capacity,), int(free[capacity])))
        free[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            free[length] -= 1
            gap = capacity - length
            found = next(filter(None, (sums.filling(g) for g in range(gap, max(0, gap - slack - 1), -1))), ())
            free[length] += 1
            if not found:
                rest[length] = int(free[length])
                free[length] = 0
                break
            pattern = (length, *found)
            times = min(int(free[x]) // pattern.count(x) for x in pattern)
            for x in pattern:
                free[x] -= times
            plan.append((pattern, times))
    gaps: dict[int, Plan] = {}
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            fits = [g for g in gaps if g >= length]
            if not fits:
                each = capacity // length
                for per, bins in ((each, left // each), (left % each, 1)):
                    if per and bins:
                        gaps.setdefault(capacity - per * length, []).append(((length,) * per, bins))
                break
            gap = min(fits)
            pattern, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            used = min(left, bins)
            if bins > used:
                gaps.setdefault(gap, []).append((pattern, bins - used))
            gaps.setdefault(gap - length, []).append(((*pattern, length), used))
            left -= used
    return plan + [x for own in gaps.values() for x in own]


def _slots(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, sequence of the first rank, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            rows.append((length, at, at + times, sequence, offset))
            used[length], offset = at + times, offset + length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece"), rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``; no sequence holds more than ``capacity``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(1, -(-max(counts.values(), default=0) // rank_rows))
    part = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    own = Window.partitionBy("length", "_salt")
    offsets = part.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = part.withColumn("_own", F.row_number().over(own.orderBy(*keys)) - 1)
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    fields = T.StructType([T.StructField(n, T.LongType()) for n in ("_length", "_from", "_to", "_sequence", "offset")])
    # A row for each part of each pattern: bounded by the capacity, not by the input.
    slots = F.broadcast(spark.createDataFrame(_slots(packing_plan(counts, capacity)), fields))
    met = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(slots, met).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs documents; a row per piece.

    The pieces (six integers each) are written once, so texts are tokenised
    once; each gets a number of its own, by which rows without an id, or
    with the same one, are dealt over tasks like others.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("_nr", F.monotonically_increasing_id())
    pieces = Scratch(docs.sparkSession, "packing").save(pieces, "pieces")
    return pack(pieces, capacity, ("doc_id", "piece", "_nr")).drop("_nr")
