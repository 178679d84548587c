"""Phrases against a plain count, and the automata against dictionaries."""

import collections
import random
import re

import numpy as np
import pytest

from lurelens.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, score string"


def pieces(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top, longest=5, absorb=100):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    found = []
    for p, a in cands.items():
        inside = any(q[0] == p[0] and len(q) > len(p) and 100 * b >= absorb * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in cands.items())
        if not inside:
            n = totals[p[0]]
            score, k = min((1000 * a * n // (counts[p[: k + 1]] * counts[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            found.append((p[0], " ".join(p[1:]), a, counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])], n, score))
    out = []
    for lang in totals:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(out)


def table(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "Éa", "éa", "en", "x\x01y", "日本", "a-b", *(f"w{i}" for i in range(12))]
    out = []
    for i in range(n):
        words = []
        while len(words) < rng.choice([1, 4, 60]):
            words += rng.choice([["of", "the"], ["new", "york", "city"], ["one", "very", "common", "passage", "here"], ["x"] * 6, [rng.choice(vocabulary)]])
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " - "]) for w in words)
        out.append((text, "en" if i % 3 else rng.choice(["fr", None, "und", "of the"])))
    return [*out, (None, "en"), ("", None), ("...", "fr"), ("x " * 5000, "en"), out[0], out[0]]


def answers(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize(("least", "top", "options"), [(5, 2000, {}), (3, 10, {"ranges": 200}), (300, 2000, {}), (4, 50, {"absorb": 60, "ranges": 1}), (5, 7, {"longest": 3})])
def test_collocations(spark, least, top, options):
    rows = table(least)
    frame = spark.createDataFrame([(i, t, x, "a", "b", "c") for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    given = {k: v for k, v in options.items() if k != "ranges"}
    assert answers(collocations.collocations(frame, least, top, **options)) == brute(rows, least, top, **given)


def test_nothing(spark):
    frame = spark.createDataFrame([(1, "few words", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(frame.limit(0)).count() == 0


def trie_of(counts):
    """The trie of a dictionary of paths."""
    words = sorted({w for p in counts for w in p})
    levels, before = [], {(): 0}
    for depth in range(1, max(map(len, counts)) + 1):
        paths = sorted({p[:depth] for p in counts if len(p) >= depth})
        columns = [np.array(x, np.int64) for x in ([before[p[:-1]] for p in paths], [words.index(p[-1]) for p in paths], [counts.get(p, 0) for p in paths])]
        levels.append(tuple(columns))
        before = {p: i for i, p in enumerate(paths)}
    return words, levels


def paths_of(words, levels):
    out, before = {}, [()]
    for parents, labels, weights in levels:
        before = [(*before[p], words[x]) for p, x in zip(parents, labels, strict=True)]
        out |= {p: int(w) for p, w in zip(before, weights, strict=True) if w}
    return out


def random_counts(seed):
    rng = random.Random(seed)
    return {tuple(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 4) for _ in range(60)}


def test_automata():
    for seed in range(20):
        one, two = random_counts(seed), random_counts(seed + 100)
        words, levels = trie_of(one)
        automaton = collocations.minimal(levels)
        assert paths_of(words, collocations.unfolded(*automaton)) == one
        # As few states as there are different continuations with their weights, the root apart.
        tails = {p: frozenset((q[len(p) :], w) for q, w in one.items() if q[: len(p)] == p and q != p) for p in {q[:k] for q in one for k in range(1, len(q) + 1)}}
        ways = {p: frozenset((q[len(p) :], one.get(q, 0)) for q in tails if q[: len(p)] == p and q != p) for p in tails}
        assert len(automaton[0]) - 1 == len(set(ways.values()) | {frozenset()}) + 1
        both = collections.Counter(one) + collections.Counter(two)
        assert paths_of(*collocations.united([trie_of(one), trie_of(two)])) == both
        asked_words, asked = trie_of(two)
        found = collocations.composed(asked, asked_words, words, *automaton)
        assert {p: one.get(p, 0) for p in two if p in one} == paths_of(asked_words, [(p, x, np.where(t > 0, w, 0)) for (p, x, t), w in zip(asked, found, strict=True)])


def test_shards_add_up():
    rng = random.Random(1)
    words = np.array([rng.randrange(4) for _ in range(400)])
    on = np.array([rng.random() < 0.8 for _ in range(400)])
    names = list("abcd")
    cut = [0, 130, 131, 400]
    for x in cut[1:]:
        on[x - 1] = False
    whole = collocations.shard_trie(np.zeros(400, np.int64), words, np.ones(400, bool), on, 4)
    parts = [(names, collocations.shard_trie(np.zeros(z - a, np.int64), words[a:z], np.ones(z - a, bool), on[a:z], 4)) for a, z in zip(cut, cut[1:], strict=False)]
    assert paths_of(*collocations.united(parts)) == paths_of(names, whole)
