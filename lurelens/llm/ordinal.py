"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades 0, 1, ..., K - 1 share one weight vector over hashed text features; K - 1
ordered thresholds turn the score into probabilities of reaching each grade:
P(grade >= k) = sigmoid(score - threshold k).  Thresholds are kept in order by
fitting the first and the logarithms of the steps.  From a fit come the
expected grade and the tail probability on which documents are selected.

Features are the distinct lower-case words of the whole text, and the text's
shape: word length, repeated words, symbols and lines, each as a hashed level.
The model is fitted on at most ``sample_rows`` rated documents, those with the
smallest hash of their id; of these each is taken that still fits into
``sample_features`` features together, and if none does, fitting stops with an
error.  Everything else covers all documents.  It has 2**``bits``
weights whatever the input's size.  Rare grades weigh more while weights are
fitted; the thresholds are then set anew so that the probabilities of reaching
each grade are, on average over the fitted documents, the shares that reach it.

Nulls and edge cases: a null text is empty and is scored by its shape alone;
ratings with a null id or a null grade, or without a document, are ignored; an
id rated more than once counts with its lowest grade; without any rating all
grades are equally likely; repeated rows are scored row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Words, grams, mix, slices

BITS, SAMPLE_ROWS, SAMPLE_FEATURES, ROUNDS, PENALTY = 18, 20_000, 20_000_000, 120, 0.05
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def features(part: pa.RecordBatch, bits: int, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all rows, one after another, and the n + 1 offsets of the rows."""
    words = Words(part.column(part.schema.names.index(column)))
    hashes, n = words.hashes(), np.diff(words.rows)
    rows = np.repeat(np.arange(len(n)), n)
    shift = np.uint64(64 - bits)
    pairs = grams(hashes, 3)
    inside = np.flatnonzero(np.arange(len(pairs)) + 3 <= words.rows[rows[: len(pairs)] + 1]) if len(pairs) else np.zeros(0, np.int64)
    order = np.lexsort((pairs[inside], rows[inside]))
    again = (pairs[inside][order][1:] == pairs[inside][order][:-1]) & (rows[inside][order][1:] == rows[inside][order][:-1])
    repeated = np.bincount(rows[inside][order][1:][again], minlength=len(n)) if len(inside) else np.zeros(len(n), np.int64)
    sums = lambda flags: np.diff(np.append(0, np.cumsum(flags))[words.offsets])
    size = np.maximum(n, 1)
    chars = np.diff(words.offsets) - n
    levels = np.stack([
        np.clip(2 * chars / size, 0, 40),
        np.clip(10 * repeated / size, 0, 10),
        np.log2(1 + 100 * sums(_SYMBOL[words.bytes]) / size),
        np.clip(10 * sums(words.bytes == 10) / size, 0, 20),
        np.log2(size),
    ]).astype(np.int64)
    shape = mix(levels.astype(np.uint64) + (np.arange(len(levels), dtype=np.uint64)[:, None] << np.uint64(32)) + np.uint64(0xABCDEF))
    keys = np.concatenate([hashes >> shift, (shape >> shift).T.ravel()]).astype(np.int64)
    owner = np.concatenate([rows, np.repeat(np.arange(len(n)), len(levels))])
    both = np.unique(owner << bits | keys)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(n) + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def reach(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., K - 1: a column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def scores(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0.0, np.cumsum(self.weights[keys], dtype=np.float64))[offsets])


def _in_order(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first and the logarithms of the steps."""
    return np.cumsum(np.append(free[0], np.exp(free[1:])))


def gradient(weights: np.ndarray, free: np.ndarray, keys: np.ndarray, rows: np.ndarray, grades: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood, each row with its ``balance``, and its slopes along weights and free thresholds."""
    cuts, levels = _in_order(free), len(free) + 1
    scores = np.bincount(rows, weights[keys], len(grades))
    upper = np.append(np.ones((len(scores), 1)), _sigmoid(scores[:, None] - cuts), 1)
    lower = np.append(upper[:, 1:], np.zeros((len(scores), 1)), 1)
    at = np.arange(len(scores))
    p, q = upper[at, grades], lower[at, grades]
    likely = np.maximum(p - q, 1e-9)
    dp, dq = balance * p * (1 - p) / likely, balance * q * (1 - q) / likely
    g_score = -(dp - dq) / len(grades)
    g_cut = np.zeros(levels + 1)
    np.add.at(g_cut, grades, dp / len(grades))
    np.add.at(g_cut, grades + 1, -dq / len(grades))
    tail = np.cumsum(g_cut[1:levels][::-1])[::-1]
    g_free = np.append(tail[0], tail[1:] * np.exp(free[1:]))
    return float(-(balance * np.log(likely)).mean()), np.bincount(keys, g_score[rows], len(weights)), g_free


def fit(keys: np.ndarray, offsets: np.ndarray, grades: np.ndarray, levels: int, bits: int = BITS, rounds: int = ROUNDS, rate: float = 0.1, penalty: float = PENALTY) -> OrdinalModel:
    """Maximum likelihood with an absolute penalty on the weights, by full-batch adaptive gradient steps.

    After each step weights shrink towards 0 by ``penalty`` over the root of the
    number of rows, times their own step length, so words that tell nothing
    about the grade end with none.
    """
    sparsity = penalty / np.sqrt(max(len(grades), 1))
    counts = np.bincount(grades, minlength=levels) + 1.0
    above = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    start = -np.log(above / (1 - above))
    rows = np.repeat(np.arange(len(grades)), np.diff(offsets))
    weights = np.zeros(1 << bits)
    free = np.append(start[0], np.log(np.maximum(np.diff(start), 1e-3)))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(free), np.zeros_like(free)]
    balance = np.sqrt(len(grades) / (levels * counts))[grades]
    for t in range(1, rounds + 1 if len(grades) else 1):
        _, g_weights, g_free = gradient(weights, free, keys, rows, grades, balance)
        for k, (value, grad) in enumerate(((weights, g_weights), (free, g_free))):
            first, second = state[2 * k], state[2 * k + 1]
            first *= 0.9
            first += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad**2
            length = rate / (np.sqrt(second / (1 - 0.99**t)) + 1e-4)
            value -= length * first / (1 - 0.9**t)
            if k == 0:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - length * sparsity, 0)
    cuts = _in_order(free)
    if len(grades):
        cuts = _calibrated(np.bincount(rows, weights[keys], len(grades)), grades, levels)
    return OrdinalModel(weights.astype(np.float32), cuts, bits)


def _calibrated(scores: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """Thresholds at which the mean probability of reaching each grade is the share that does, by bisection.

    Shares fall with the grade, so the thresholds are in order; half a row is
    added on either side, so that none is infinite.
    """
    cuts = np.zeros(levels - 1)
    for k in range(1, levels):
        share = ((grades >= k).sum() + 0.5) / (len(grades) + 1)
        low, high = scores.min() - 40, scores.max() + 40
        for _ in range(80):
            cuts[k - 1] = (low + high) / 2
            low, high = (cuts[k - 1], high) if _sigmoid(scores - cuts[k - 1]).mean() > share else (low, cuts[k - 1])
    return cuts


def train(docs: DataFrame, ratings: DataFrame, levels: int, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> OrdinalModel:
    """Fits on documents (doc_id, text) with a grade in ``ratings`` (doc_id, grade)."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    # At most sample_rows rows of two integers.
    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, offsets = features(part, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([keys[a:z].astype("<i4").tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["doc_id", "grade", "keys"])

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, keys binary")
    found = found.withColumn("nr", F.monotonically_increasing_id())
    found = Scratch(docs.sparkSession, "ordinal").save(found, "found")
    # Rows are taken in order of a hash while they fit; one that does not is passed over, and the next may fit.
    order = [F.xxhash64("doc_id"), "doc_id", "n", F.xxhash64("keys"), "nr"]
    rows = found.withColumn("n", (F.octet_length("keys") / 4).cast("long")).orderBy(*order).limit(sample_rows).select("nr", "n").toPandas()
    left, taken = sample_features, []
    for nr, n in rows.itertuples(index=False):
        if n <= left:
            left -= n
            taken.append((nr,))
    if len(rows) and not taken:
        raise ValueError(f"each of {len(rows)} rated documents has more than {sample_features} features; raise sample_features")
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "nr long"))
    found = found.join(few, "nr", "left_semi").select("doc_id", "grade", "keys").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    sets = [np.frombuffer(x, "<i4") for x in found["keys"]]
    offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)
    return fit(np.concatenate([np.zeros(0, np.int32), *sets]), offsets, found["grade"].to_numpy(np.int64), levels, bits)


def score(docs: DataFrame, model: OrdinalModel, least_grade: int, least_tail: float = 0.5) -> DataFrame:
    """A row per document: doc_id, score, expected_grade, tail_probability of reaching ``least_grade``, and kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in slices(batch):
                scores = own.scores(*features(part, own.bits))
                reach = own.reach(scores)
                tail = reach[:, least_grade - 1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(reach.sum(1)), pa.array(tail), pa.array(tail >= least_tail)], ["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades from two flags: 0 toxic, 1 poor, 2 good; null if either is."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on labels (doc_id, quality, toxic) and scores all documents; kept are those that more likely than not are good."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(own, train(own, graded, 3, **options), 2)
