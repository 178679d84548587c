"""Vectorised text work on Arrow string columns, used inside Spark tasks.

Words and n-grams of a batch are found and hashed with whole-array numpy
operations on the UTF-8 bytes; there is no loop over words.  Hashes are 64 bits
wide: a sum of table entries times powers of an odd constant modulo 2**64,
followed by a bit mixer, so two different strings meet with a chance of about
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once, and bytes whose words are hashed at once; numpy's helper arrays are some 50 times as large as these.
SLICE_BYTES, CHUNK_BYTES = 2 << 20, 1 << 18

_SEED = 20240607
_TABLE = np.random.default_rng(_SEED).integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def quoted(name: str) -> str:
    """A column's name as Spark takes it whole, dots included."""
    return "`" + name.replace("`", "``") + "`"


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


#: Bytes of words: everything but space, tab, newline, vertical tab, form feed, carriage return.
NOT_SPACE = ~_byte_class(" \t\n\x0b\x0c\r")
#: Bytes of words made of ASCII letters, digits and every non-ASCII character.
ALNUM = _byte_class("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM[128:] = True


class _Powers:
    """Powers of an odd constant and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    offsets = offsets[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding at most ``limit`` bytes of text, or one row that is longer."""
    column = batch.column(batch.schema.names.index(name))
    _, offsets = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a text column: byte starts and ends, and ``rows``, the n + 1 word offsets of the rows."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NOT_SPACE):
        self.bytes, self.offsets = text_bytes(column)
        inside = word_bytes[self.bytes]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """One hash per word; ``fold`` treats A-Z as a-z.  Bytes are taken in chunks of whole words, so helper arrays stay small."""
        table, out, i = _FOLDED if fold else _TABLE, np.empty(len(self.starts), np.uint64), 0
        while i < len(self.starts):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + CHUNK_BYTES, "right")))
            a, z = self.starts[i:j] - begin, self.ends[i:j] - begin
            up, down = _BYTE_POWERS.get(int(z[-1]))
            run = np.zeros(len(up) + 1, np.uint64)
            np.cumsum(table[self.bytes[begin : self.ends[j - 1]]] * up, out=run[1:])
            out[i:j] = mix((run[z] - run[a]) * down[a] + (z - a).astype(np.uint64))
            i = j
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, ignoring row borders: entry i covers words i to i + n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _GRAM_POWERS.get(len(hashes))
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=run[1:])
    return mix((run[n:] - run[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def sequence_names(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One hash for all words of each row, the same as that of a gram of so many words."""
    up, down = _GRAM_POWERS.get(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=run[1:])
    return mix((run[rows[1:]] - run[rows[:-1]]) * down[rows[:-1]] + np.diff(rows).astype(np.uint64))


def shingle_sets(words: Words, hashes: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct n-word shingles; shorter rows have their whole sequence as one; rows without words none."""
    every = grams(hashes, n)
    for a, z in zip(words.rows[:-1], words.rows[1:], strict=True):
        if z - a >= n:
            own = np.sort(every[a : z - n + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        else:
            yield grams(hashes[a:z], int(z - a)) if z > a else np.zeros(0, np.uint64)


class BitTable:
    """A set of longs as bit tables of a fixed size, 2**``most_bits`` bits each at most: no false negatives.

    With two probes a second table looks at other bits of a long, so that fewer are wrongly held.
    """

    def __init__(self, keys: DataFrame, column: str, total: int, most_bits: int = 27, probes: int = 1):
        self.size = 1 << min(most_bits, max(20, int(total * 32).bit_length()))
        self.tables = []
        for probe in range(probes):
            place = F.pmod(F.shiftrightunsigned(column, 32 * probe), F.lit(self.size)) + 1
            rows = keys.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
            table = np.zeros(self.size // 8, np.uint8)
            for r in rows:
                table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
            self.tables.append(table)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        held = np.ones(len(keys), bool)
        for probe, table in enumerate(self.tables):
            at = (keys >> np.uint64(32 * probe)) & np.uint64(self.size - 1)
            held &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held
