"""Language-model scores by deleted interpolation.

A bigram model over whole texts: the maximum-likelihood estimates of bigram and
unigram and a uniform share are mixed, with weights that depend on how often the
context was seen (by powers of two).  The weights are learned by expectation
maximisation on held-out counts: one fold of the training documents is deleted
from the counts and its tokens are explained by the rest.  The final counts
cover all training documents.

Counts are exchanged by blocks of documents.  A block asks for each distinct
token and bigram once, with its own counts; hash ranges add the blocks' counts
up and answer only where the total differs from what the block counted itself.
So a word that makes up a third of all text costs a row per block, not one per
occurrence, no table of counts is ever gathered, and documents are scored where
their block's answers arrive.

Tokens are compared by 64-bit hashes, bigrams by enough bits that another one
is met with a chance below 2**-17 a token.

Nulls and edge cases: a null text is empty and has one token, the end; a null id
counts as empty text for the fold, so it trains; repeated rows count each time;
without training documents the counts are 0, the base model is uniform and so is
the mixture; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Words, mix, slices

#: Text of a block; keys of a hash range; tokens a task gathers before it asks.
BLOCK_BYTES, RANGE_KEYS, FLUSH_TOKENS = 12 << 20, 400_000, 2_000_000
#: The end of a text, which also is the context of its first token.
_END = np.uint64(0x0E4D0E4D0E4D0E4D)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Likelihood ratios of held-out tokens are binned by 1/16 of a power of two.
_BINS = 16
_ASK = "range int, kind int, block long, keys binary, c binary, d binary"
_ANSWER = "block long, kind int, keys binary, c binary, d binary, n_types long, n_tokens long, n_types_kept long, n_tokens_kept long"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each row, and the n + 1 offsets of the rows."""
    words = Words(column)
    n = len(column)
    out = np.full(len(words) + n, _END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(words.rows))] = words.hashes()
    return out, words.rows + np.arange(n + 1)


def _bigrams(tokens: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the tokens, and the bigrams' hashes."""
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[rows[:-1]] = _END
    return contexts, mix(contexts * _LEFT + tokens * _RIGHT) >> np.uint64(64 - bits)


def _count(keys: np.ndarray, *flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and for each flag array its sum over them."""
    if not len(keys):
        return (keys, *(np.zeros(0, np.int64) for _ in flags))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[at], *(np.add.reduceat(f[order].astype(np.int64), at) for f in flags))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, of four bytes where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    narrow = len(steps) < 2 or steps[1:].max() < 2**32
    return (b"\x04" if narrow else b"\x08") + steps[:1].tobytes() + steps[1:].astype("<u4" if narrow else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    rest = np.frombuffer(data, "<u4" if data[:1] == b"\x04" else "<u8", offset=9)
    return np.cumsum(np.append(np.frombuffer(data, "<u8", 1, 1), rest.astype(np.uint64)), dtype=np.uint64)


def _numbers(x: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in full."""
    large = x[x >= 255]
    return len(x).to_bytes(8, "little") + np.minimum(x, 255).astype("<u1").tobytes() + large.astype("<u8").tobytes()


def _counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    x = np.frombuffer(data, "<u1", n, 8).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<u8", offset=8 + n).astype(np.int64)
    return x


def _ask(bits: int, ranges: int):
    """A row for each block, kind (0 tokens, 1 bigrams) and hash range: the distinct keys and the block's own counts."""
    width = {0: 64, 1: bits}

    def rows(block: int, kind: int, counted: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        keys, c, d = counted
        place = ((keys >> np.uint64(width[kind] - 32)) * np.uint64(ranges)) >> np.uint64(32)
        borders = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(keys))
        for a, z in zip(borders[:-1], borders[1:], strict=True):
            yield int(place[a]), kind, block, _packed(keys[a:z]), _numbers(c[a:z]), _numbers(d[a:z])

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for block, parts in held.items():
            tokens, bigrams, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = [*rows(block, 0, _count(tokens, c, d)), *rows(block, 1, _count(bigrams, c, d))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _ASK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            for part in slices(batch):
                tokens, at = _tokens(part.column(2))
                bigrams = _bigrams(tokens, at, bits)[1]
                blocks = np.repeat(part.column(0).to_numpy(), np.diff(at))
                fold = np.repeat(part.column(1).to_numpy(), np.diff(at))
                for block in np.unique(blocks):
                    own = blocks == block
                    held.setdefault(int(block), []).append((tokens[own], bigrams[own], fold[own] != 2, fold[own] == 3))
                n += len(tokens)
                if n >= FLUSH_TOKENS:
                    yield from flush(held)
                    held, n = {}, 0
        yield from flush(held)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Adds up a hash range and answers each block where the totals differ from its own counts; block -1 has the range's sums."""
    out: list[tuple] = []
    kinds = table.column("kind").to_numpy()
    for kind in (0, 1):
        rows = [{k: table.column(k)[int(i)].as_py() for k in ("block", "keys", "c", "d")} for i in np.flatnonzero(kinds == kind)]
        if not rows:
            continue
        keys, c, d = [_unpacked(r["keys"]) for r in rows], [_counts(r["c"]) for r in rows], [_counts(r["d"]) for r in rows]
        known, c_all, d_all = _count(np.concatenate(keys), np.concatenate(c), np.concatenate(d))
        if kind == 0:
            rest = c_all - d_all
            out.append((-1, 0, None, None, None, int((c_all > 0).sum()), int(c_all.sum()), int((rest > 0).sum()), int(rest.sum())))
        for r, k, own in zip(rows, keys, c, strict=True):
            at = np.searchsorted(known, k)
            new = c_all[at] != own
            if new.any():
                out.append((r["block"], kind, _packed(k[new]), _numbers(c_all[at][new]), _numbers(d_all[at][new]), 0, 0, 0, 0))
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    cols = list(zip(*out, strict=True)) or [[]] * 9
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], [f.split()[0] for f in _ANSWER.split(", ")])


class _Block:
    """A block's documents with the counts of all their tokens, contexts and bigrams."""

    def __init__(self, docs: pa.Table, answers: pa.Table, bits: int):
        hashes, sizes = [], []
        for batch in docs.to_batches():
            for part in slices(batch):
                tokens, rows = _tokens(part.column(part.schema.names.index("text")))
                hashes.append(tokens)
                sizes.append(np.diff(rows))
        self.tokens = np.concatenate(hashes)
        self.rows = np.append(0, np.cumsum(np.concatenate(sizes)))
        contexts, bigrams = _bigrams(self.tokens, self.rows, bits)
        fold = np.repeat(docs.column("fold").to_numpy(), np.diff(self.rows))
        trained, deleted = fold != 2, fold == 3
        kinds = answers.column("kind").to_numpy()
        told = lambda kind: [{k: answers.column(k)[int(i)].as_py() for k in ("keys", "c", "d")} for i in np.flatnonzero(kinds == kind)]
        words = self._totals(self.tokens, trained, deleted, told(0))
        pairs = self._totals(bigrams, trained, deleted, told(1))
        self.word = self._look_up(words, self.tokens)
        # The end stands for the start as a context; it is a token of every block.
        self.context = self._look_up(words, contexts)
        self.pair = self._look_up(pairs, bigrams)

    @staticmethod
    def _totals(keys, trained, deleted, told):
        known, c, d = _count(keys, trained, deleted)
        for r in told:
            at = np.searchsorted(known, _unpacked(r["keys"]))
            c[at], d[at] = _counts(r["c"]), _counts(r["d"])
        return known, c, d

    @staticmethod
    def _look_up(totals, keys):
        known, c, d = totals
        at = np.searchsorted(known, keys)
        return c[at], d[at]


def _level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 unseen, else 1 + floor(log2)."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _held_out(bits: int, types: int, tokens: int):
    """Held-out tokens of a block, counted by bucket and by binned ratios of the estimates to the uniform share; -999 for an estimate of 0."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("level", "two", "one", "n")})
        block = _Block(docs, answers, bits)
        word, context, pair = (c - d for c, d in (block.word, block.context, block.pair))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = lambda p: np.where(p > 0, np.rint(_BINS * np.log2(p * (types + 1))), -999).astype(np.int64)
            two = ratio(np.where(context > 0, pair / np.maximum(context, 1), 0))
            one = ratio(word / max(tokens, 1))
        found = pd.DataFrame({"level": _level(context), "two": two, "one": one}).value_counts().reset_index(name="n")
        return pa.Table.from_pandas(found.astype("int64"), preserve_index=False)

    return run


def mixture_weights(held_out: pd.DataFrame, rounds: int = 100) -> np.ndarray:
    """Per bucket the weights of bigram, unigram and uniform share, by expectation maximisation; a bucket without tokens takes the nearest one's."""
    weights = np.full((64, 3), np.nan)
    for level, own in held_out.groupby("level"):
        ratio = np.stack([np.where(own[k] == -999, 0.0, 2.0 ** (own[k] / _BINS)) for k in ("two", "one")] + [np.ones(len(own))], 1)
        n, w = own["n"].to_numpy(float), np.array([0.0 if level == 0 else 1.0, 1.0, 1.0])
        w /= w.sum()
        for _ in range(rounds):
            share = ratio * w
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        # No weight is quite 0, so that no text is impossible.
        weights[int(level)] = (w + 1e-6 * np.array([level > 0, 1, 1])) / (w.sum() + 1e-6 * (2 + (level > 0)))
    known = np.flatnonzero(~np.isnan(weights[:, 0]) & (np.arange(64) > 0))
    if np.isnan(weights[0, 0]):
        weights[0] = [0, 0.5, 0.5]
    for k in np.flatnonzero(np.isnan(weights[:, 0])):
        weights[k] = weights[known[np.abs(known - k).argmin()]] if len(known) else [1 / 3] * 3
    return weights


def _score(bits: int, types: int, tokens: int, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        block = _Block(docs, answers, bits)
        word, context, pair = block.word[0], block.context[0], block.pair[0]
        w = weights[_level(context)]
        mixed = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
        sums = lambda x: np.add.reduceat(x, block.rows[:-1])
        cols = [docs.column("doc_id").combine_chunks(), pa.array(docs.column("fold").to_numpy() == 2), pa.array(np.diff(block.rows)), pa.array(sums((word > 0).astype(np.int64))), pa.array(np.full(docs.num_rows, tokens)), pa.array(sums(np.log10((word + 1) / (tokens + types + 1)))), pa.array(sums(np.log10(mixed)))]
        return pa.Table.from_arrays(cols, schema=_RESULT)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_RESULT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[Column, int]:
    """The block of a document, and all bytes of text.

    Ranges of ids keep neighbours together, so a task that reads them asks once;
    where ids are too unevenly spread for that, such as where very many rows
    share one, blocks are dealt by a hash of id and text.
    """
    seen = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    count = max(1, -(-(seen["bytes"] + seen["rows"]) // block_bytes))
    by_hash = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count))
    if count == 1 or seen["low"] is None or seen["low"] == seen["high"]:
        return by_hash, seen["bytes"] + seen["rows"]
    width = (seen["high"] - seen["low"]) // count + 1
    by_range = F.coalesce(((F.col("doc_id") - F.lit(seen["low"])) / width).cast("long"), by_hash)
    largest = docs.groupBy(by_range.alias("block")).agg(F.sum(F.octet_length("text")).alias("bytes")).agg(F.max("bytes")).first()[0]
    return (by_range if (largest or 0) <= 3 * block_bytes else by_hash), seen["bytes"] + seen["rows"]


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", folds: int = 7) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text leaves 2 modulo ``folds`` are held
    out; those that leave 3 train too, but serve to learn the mixture weights.
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    block, size = _blocks(frame, block_bytes)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)).cast("int")
    frame = frame.withColumns({"fold": fold, "block": block})
    # The fold that learns the weights has blocks of its own, as it is also read alone.
    frame = frame.withColumn("block", F.when(F.col("fold") == 3, F.floor(F.col("block") / 4) * 2 + 1).otherwise(F.col("block") * 2).cast("long"))
    bits = min(64, max(33, math.ceil(math.log2(size + 2)) + 16))
    ranges = max(8, -(-size // (7 * RANGE_KEYS)))
    asked = frame.select("block", "fold", "text").mapInArrow(_ask(bits, ranges), _ASK)
    answers = scratch.save(asked.groupBy("range").applyInArrow(_answer, _ANSWER), "answers")
    totals = answers.filter("block = -1").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_types", "n_tokens", "n_types_kept", "n_tokens_kept"))).first()
    told = answers.filter("block >= 0").select("block", "kind", "keys", "c", "d")

    def by_block(documents: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
        return documents.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

    deleted = by_block(frame.filter("fold = 3").select("block", "fold", "text"), told.filter("block % 2 = 1"), _held_out(bits, totals["n_types_kept"], totals["n_tokens_kept"]), "level long, two long, one long, n long")
    # Buckets times bins of ratios: bounded whatever the input's size.
    held_out = deleted.groupBy("level", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture_weights(held_out)
    return by_block(frame.select("block", "fold", "doc_id", "text"), told, _score(bits, totals["n_types"], totals["n_tokens"], weights), _RESULT_SQL)
