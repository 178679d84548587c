"""Language identification against a plain count, and on held-out documents."""

import collections
import os
import random
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from lurelens.llm import language_id

SCHEMA = "doc_id long, text string, lang string, distance string, key string"


def grams(text):
    out = collections.Counter()
    chars = [c.lower() if len(c.lower()) == 1 else c for c in text or ""]
    for word in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in chars).split(" "):
        if word:
            padded = f" {word} "
            out.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    return out


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute(rows, size):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang, *_ in rows:
        if not held(i) and lang is not None and grams(text):
            counts[lang] += grams(text)
    learned = {x: {g: k for k, g in enumerate(top(c, size))} for x, c in counts.items()}
    out = []
    for i, text, *_ in rows:
        own = top(grams(text), size)
        lang, score, distance = "und", 0.0, None
        if learned and any(c.isalpha() for c in text or ""):
            distance, lang = min((sum(abs(k - r[g]) if g in r else size for k, g in enumerate(own)), x) for x, r in learned.items())
            score = 1 - distance / (size * len(own))
        out.append((i, held(i), lang, round(score, 9), distance))
    return sorted(out, key=str)


def table(n=150, langs=("xa", "xb", "xç")):
    rng = random.Random(4)
    parts = {x: ["".join(rng.choice("abcdeéß") for _ in range(2)) for _ in range(9)] for x in langs}
    out = []
    for i in range(n):
        lang = langs[0] if i % 3 == 0 else rng.choice(langs)
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([1, 3, 40]))]
        out.append((i, rng.choice([" ", "\n", ", "]).join(words).capitalize(), lang if i % 7 else None, "x", "y"))
    odd = [None, "", "123 ...", "ʼ", "́", "a", "İSTANBUL ß", "日本語 テスト", "हिन्दी भाषा", "abc" * 30_000, "𐐀𐐨 x"]
    return [*out, *((n + k, t, "xa" if k % 2 else None, None, "y") for k, t in enumerate(odd)), (None, "no id", "xa", None, None), out[1], out[1]]


def answers(frame):
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9), r["distance"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"size": 30}, {"size": 30, "block": 1}, {"size": 7}])
def test_identify(spark, options):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert answers(language_id.identify(frame, **options)) == brute(rows, options.get("size", language_id.SIZE))


def test_many_languages_in_turns(spark):
    rows = table(langs=[f"l{i}" for i in range(12)])
    frame = spark.createDataFrame(rows, SCHEMA)
    assert answers(language_id.identify(frame, 20, block=5)) == answers(language_id.identify(frame, 20)) == brute(rows, 20)


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "some words", None), (2, None, "xa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(frame).collect()} == {"und"}
    assert language_id.identify(frame.limit(0)).count() == 0


def test_profiles_are_spelled(spark):
    frame = spark.createDataFrame([("xa", "ab ab é")], "lang string, text string")
    found = language_id.profiles(frame, 4).orderBy("rank").collect()
    assert [language_id.spelled(r["key"]) for r in found] == [" a", " ab", "a", "ab"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables are not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").filter("size >= 20")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97, right
