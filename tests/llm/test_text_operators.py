"""WARC, shards, language model, classifier, license scan, packing and quality rules against brute force."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.llm import language_model, license_scan, ordinal, packing, quality_rules, sharding, warc
from lurelens.llm.scratch import Scratch
from lurelens.llm.text import Words, grams, slices

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, extra string"


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return [w for w in SPACE.split(lowered(text)) if w]


def documents(seed=0, n=200):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", *(f"wörd{i}" for i in range(150))]
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary[:3]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 140))]
        out.append((i, " ".join(w) + ("\n" if i % 2 else ""), "en" if i % 3 else None, f"s{i % 2}", "x"))
    return [*out, (n, None, "en", None, None), (n + 1, "", None, None, None), (n + 2, "word " * 4000, "en", "s0", "y"), (n + 2, "word " * 4000, "en", "s0", "y"), (None, "no id here", "en", "s0", "y")]


def test_hashes_follow_words():
    import pyarrow as pa

    texts = ["A bc  déf", None, "", "a BC x", "  y", "bc a"]
    w = Words(pa.array(texts))
    h = w.hashes()
    want = [x for t in texts for x in words(t)]
    assert len(h) == len(want)
    assert len(set(zip(want, h.tolist(), strict=True))) == len(set(want)) == len(set(h.tolist()))
    assert grams(h[:2], 2)[0] == grams(h[3:5], 2)[0]
    rng = random.Random(1)
    long = [" ".join("".join(rng.choice("aBcé") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)), "x" * 700_000 + " y", "z"]
    assert Words(pa.array(long)).hashes().tolist() == [int(Words(pa.array([w])).hashes()[0]) for t in long for w in t.split(" ")]
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "c" * 9, None, "d"])], ["text"])
    assert [s.num_rows for s in slices(batch, limit=3)] == [1, 1, 2]


def test_warc(spark):
    long = "é" * 600
    rows = [(1, "u1", long, 0), (2, "u 2", long, 0), (3, None, "short", 0), (4, "u4", "short", 0), (5, "u5", None, 0), (7, "u7", "\r\n\r\n" * 400, 0), (2, "u 2", long, 0), (None, "n", long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int")
    folder = Scratch(spark, "warc-test").path
    index = Scratch(spark, "warc-index").save(warc.write_archives(pages, folder, archive_bytes=500), "index")
    back = warc.read_records(index, folder).collect()
    assert len(back) == len(rows)
    got = {}
    for r in back:
        got.setdefault(r.page_id, []).append(r)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert all((r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest()) for r in got[i])
    assert (got[1][0].record_type, got[1][0].refers_to, got[1][0].html) == ("revisit", 2, None)
    assert sorted(r.record_type for r in got[2]) == ["response", "revisit"]
    assert {got[i][0].record_type for i in (3, 4, 5, 7)} == {"response"} and got[7][0].html == "\r\n\r\n" * 400
    assert got[None][0].refers_to == 2
    some = warc.read_records(index.filter("page_id in (3, 7)"), folder).collect()
    assert {r.page_id for r in some} == {3, 7}
    one = index.first()
    path = f"{folder}/{one.archive}".removeprefix("file://")
    with open(path, "rb") as f:
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\n")
    assert list(warc.coalesce_ranges([(0, 10), (12, 5), (100, 5)], gap=2)) == [(0, 2, 0, 17), (2, 3, 100, 105)]
    assert warc.read_records(spark.createDataFrame([], index.schema), folder).collect() == []


def test_warc_copies_of_one_page(spark):
    """A third of all pages are one error page: its copies are dealt over parts; URLs come back as they were."""
    page = "<html>not found</html>" * 60
    rows = [(i, f"u  {i} " if i % 2 else f"a\nb{i}", page if i % 3 == 0 else f"{'x' * 1200}{i}", "d") for i in range(900)]
    rows += [(5000, None, rows[1][2], "d"), (None, "n", page, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(5)
    for hot in (50, 20_000):
        got = warc.classify(pages, hot_rows=hot).collect()
        assert len(got) == len(rows)
        kinds = {r.page_id: (r.record_type, r.refers_to, r.html) for r in got}
        assert all(kinds[i] == ("revisit", 897, None) for i in range(0, 897, 3)) and kinds[897] == ("response", None, page)
        assert kinds[None] == ("revisit", 897, None) and kinds[1] == ("revisit", 5000, None) and kinds[5000][0] == "response"
        assert all(kinds[i] == ("response", None, rows[i][2]) for i in range(2, 900, 3))
    back = {r.page_id: r.url for r in warc.round_trip(pages).collect()}
    assert back == {i: (u or "").replace("\n", "%0A") for i, u, *_ in rows}


def test_packing_deals_rows_without_ids(spark):
    """Rows without an id, with one id, and equal rows of one length are numbered apart."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(None, "one two three") for _ in range(300)] + [(7, "four five six") for _ in range(300)] + [(None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, 64).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_shards(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    store = sharding.ShardStore(spark, Scratch(spark, "shards-test").path, target_bytes=100_000, fanout=3)
    assert store.version() == 0 and store.read(docs.schema).count() == 0
    assert store.append(sharding.arrivals(docs, ("doc_id",), 10)) == 1
    before = store.shards()
    store.append(sharding.arrivals(docs.limit(30), ("doc_id",), 5))
    last = store.compact_fully()
    assert store.plan(store.shards()) == [] and len(store.shards()) < len(before)
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "extra").collect()))
    assert rows(store.read(docs.schema, 1)) == rows(docs)
    assert rows(store.read(docs.schema, last)) == rows(docs.union(docs.limit(30)))
    assert sum(s.rows for s in store.shards()) == docs.count() + 30
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(store.shards(), last - 1)


def test_a_tier_is_merged_in_bounded_runs(spark):
    """A tier with many shards is cut into runs; no run has many more paths than asked for, and all rows stay."""
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = sharding.ShardStore(spark, Scratch(spark, "shards-runs").path, target_bytes=60_000, fanout=3, run_files=8)
    store.append(docs.withColumn(sharding.ARRIVAL, (F.col("doc_id") % 48).cast("int")).repartition(1))
    assert len(store.shards()) == 48
    runs, packed = [], store._packed
    store._packed = lambda paths: runs.append(len(paths)) or packed(paths)
    assert store.compact() == len(runs) > 3 and max(runs) < 24 and store.version() == 2
    last = store.compact_fully()
    assert sum(s.rows for s in store.shards()) == 2400 and len(store.shards()) < 24
    rows = lambda version: sorted(map(tuple, store.read(docs.schema, version).select("doc_id", "text").collect()))
    assert rows(1) == rows(last) == sorted(map(tuple, docs.collect()))


def test_of_two_writers_one_commits(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.createDataFrame([(1, "a", 5, "v", "s")], "doc_id long, text string, arrival int, version string, shard_id string")
    store = sharding.ShardStore(spark, Scratch(spark, "shards-race").path)
    store.append(sharding.arrivals(docs, ("doc_id",), 5))
    own = store.shards()

    def commit(k):
        try:
            return store.commit([sharding.Shard(f"{own[0].path}", own[0].rows, k)], 1)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(commit, range(8)))
    assert got.count(2) == 1 and store.version() == 2 and store.shards()[0].bytes == got.index(2)
    row = store.read(docs.schema).first().asDict()
    assert {k: row[k] for k in docs.columns} == docs.first().asDict() and row["_version"] == 2 and row["_shard_id"] == own[0].path


def test_all_shards_are_compacted_at_every_size(spark):
    rng, target = random.Random(3), 40_000
    rows = [(i, rng.randbytes(50).hex()) for i in range(16_000)]
    small, large = (spark.createDataFrame(x, "doc_id long, text string").repartition(4) for x in (rows[:1000], rows))
    stores = {}
    for name, docs in (("small", small), ("large", large), ("scattered", large.repartition(120).withColumn("arrival", F.lit(0)))):
        store = stores[name] = sharding.ShardStore(spark, Scratch(spark, f"shards-{name}").path, target_bytes=target)
        store.append(docs.withColumnRenamed("arrival", sharding.ARRIVAL) if "arrival" in docs.columns else sharding.arrivals(docs, ("doc_id",), 20, target // 4))
        fresh = store.shards()
        assert all(2 * s.bytes < target for s in fresh) and len({s.path.split("/")[-2] for s in fresh}) in (len(fresh), 1)
        assert store.compact_fully() > 1
        left = store.shards()
        done = [s for s in left if 2 * s.bytes >= target]
        assert all(s.bytes < 1.6 * target for s in left) and len(left) - len(done) < 4 * 8
        assert name == "small" or sum(s.bytes for s in done) > 0.9 * sum(s.bytes for s in left)
        want = docs.count()
        assert sum(s.rows for s in left) == want == store.read(docs.schema).select("doc_id", "text").distinct().count()
        assert {s.path for s in left} == {r[0] for r in store.read(docs.schema).select("shard_id").distinct().collect()}
    assert len(stores["large"].shards(1)) > 4 * len(stores["small"].shards(1))


def brute_model(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    docs = [(d, fold(d), [*words(t), None]) for d, t, *_ in rows]

    def counts(keep):
        uni, bi = collections.Counter(), collections.Counter()
        for _, f, t in docs:
            if keep(f):
                uni.update(t)
                bi.update(zip([None, *t], t, strict=False))
        return uni, bi

    level = lambda c: 1 + int(math.floor(math.log2(c))) if c else 0
    kept, all_ = counts(lambda f: f not in (2, 3)), counts(lambda f: f != 2)
    bins = collections.Counter()
    v, n = len(kept[0]), sum(kept[0].values())
    ratio = lambda p: round(16 * math.log2(p * (v + 1))) if p else -999
    for _, f, t in docs:
        if f == 3:
            for h, w in zip([None, *t], t, strict=False):
                c = kept[0][h]
                bins[level(c), ratio(kept[1][h, w] / c if c else 0), ratio(kept[0][w] / n)] += 1
    import pandas as pd

    held = pd.DataFrame([(*k, x) for k, x in bins.items()], columns=["level", "two", "one", "n"])
    weights = language_model.mixture_weights(held)
    uni, bi = all_
    v, n = len(uni), sum(uni.values())
    out = {}
    for d, f, t in docs:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip([None, *t], t, strict=False):
            a = weights[level(uni[h])]
            score += math.log10(a[0] * bi[h, w] / max(uni[h], 1) + a[1] * uni[w] / n + a[2] / (v + 1))
        out[d] = (f == 2, len(t), sum(uni[w] > 0 for w in t), n, base, score)
    return out


def test_mixture_weights_match_plain_maximisation():
    import pandas as pd

    rng = random.Random(6)
    rows = [(rng.randrange(1, 5), rng.choice([0.0, rng.uniform(1, 4000)]), rng.choice([0.0, rng.uniform(0.5, 300)])) for _ in range(4000)]
    rows += [(0, 0.0, rng.choice([0.0, rng.uniform(0.5, 300)])) for _ in range(500)]
    bins = collections.Counter((level, *(round(16 * math.log2(x)) if x else -999 for x in own)) for level, *own in rows)
    got = language_model.mixture_weights(pd.DataFrame([(*k, n) for k, n in bins.items()], columns=["level", "two", "one", "n"]))
    for level in range(5):
        own = [r[1:] for r in rows if r[0] == level]
        w = [1 / 3] * 3 if level else [0.0, 0.5, 0.5]
        for _ in range(100):
            sums = [0.0] * 3
            for two, one in own:
                parts = [w[0] * two, w[1] * one, w[2]]
                for k in range(3):
                    sums[k] += parts[k] / sum(parts)
            w = [x / len(own) for x in sums]
        assert got[level].tolist() == pytest.approx(w, abs=5e-3)
        likely = lambda v: sum(math.log(v[0] * two + v[1] * one + v[2]) for two, one in own)
        for k in range(3):
            moved = [max(1e-9, x + (0.05 if i == k else -0.025)) for i, x in enumerate(got[level])]
            assert level == 0 or likely(got[level]) >= likely([x / sum(moved) for x in moved]) - 1e-6


def test_language_model(spark):
    rows = documents()
    want = brute_model(rows)
    for size in (1 << 24, 4000):
        got = language_model.score(spark.createDataFrame(rows, DOCS).repartition(3), block_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-6)
    assert language_model.score(spark.createDataFrame([], DOCS)).collect() == []


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(4)
    neutral = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        grade = i % 3
        w = [rng.choice(neutral) for _ in range(rng.randrange(20, 90))]
        if grade == 0:
            w[rng.randrange(len(w))] = rng.choice(["scum", "moron"])
        if grade == 1:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "x"))
        if i < 600:
            labels.append((i, int(grade != 1), int(grade == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (5, rows[5][1], "x")]
    labels += [(None, 1, 0), (7, None, 0), (5000, 1, 1), (4, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.classify(docs, rated).collect()}
    held = [i for i in range(600, 900)]
    right = sum(got[i].kept == (i % 3 == 2) for i in held)
    assert right >= 0.97 * len(held) and set(got) >= {1000, 1001}
    # Probabilities follow the real mix of grades: a third are good, and two thirds not toxic.
    assert sum(got[i].tail_probability for i in held) / len(held) == pytest.approx(1 / 3, abs=0.04)
    assert sum(got[i].expected_grade for i in held) / len(held) == pytest.approx(1, abs=0.08)
    assert all(0 <= r.expected_grade <= 2 for r in got.values())
    model = ordinal.fit(np.array([0, 1, 0], np.int64), np.array([0, 1, 2, 3]), np.array([0, 2, 1]), 3, bits=4, rounds=5)
    assert (np.diff(model.thresholds) > 0).all()
    assert ordinal.classify(docs, rated.limit(0)).count() == len(rows)
    assert ordinal.classify(docs.limit(0), rated).collect() == []


def test_ordinal_gradient_is_the_slope():
    rng = np.random.default_rng(3)
    rows = np.repeat(np.arange(30), rng.integers(1, 6, 30))
    keys, grades, balance = rng.integers(0, 16, len(rows)), rng.integers(0, 4, 30), rng.random(30) + 0.5
    point = [rng.normal(size=16), rng.normal(size=3)]
    likelihood = lambda w, f: ordinal.gradient(w, f, keys, rows, grades, balance)[0]
    # By hand, from P(grade >= k) = sigmoid(score - threshold k).
    cuts = [point[1][0], point[1][0] + math.exp(point[1][1]), point[1][0] + math.exp(point[1][1]) + math.exp(point[1][2])]
    total = 0.0
    for i in range(30):
        score = sum(point[0][k] for k, r in zip(keys, rows, strict=True) if r == i)
        reach = [1, *(1 / (1 + math.exp(c - score)) for c in cuts), 0]
        total -= balance[i] * math.log(reach[grades[i]] - reach[grades[i] + 1]) / 30
    assert likelihood(*point) == pytest.approx(total)
    slopes = ordinal.gradient(*point, keys, rows, grades, balance)[1:]
    for side in (0, 1):
        for k in range(len(point[side])):
            moved = [[x.copy() for x in point] for _ in range(2)]
            moved[0][side][k] -= 1e-5
            moved[1][side][k] += 1e-5
            assert slopes[side][k] == pytest.approx((likelihood(*moved[1]) - likelihood(*moved[0])) / 2e-5, abs=1e-6)


def test_ordinal_bounds_never_empty_the_fit(spark):
    """A document too long for what is left is passed over; repeated ids count row by row; nothing at all is an error."""
    rng = random.Random(8)
    text = lambda n, grade: " ".join([f"n{rng.randrange(10**6)}" for _ in range(n)] + ["good" if grade else "bad"] * 3)
    rows = [(i, text(300 if i % 2 else 8, i % 4 < 2)) for i in range(60)] + [(4, text(8, 1)) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(60)], "doc_id long, grade int")
    for bound in (40, 200, 10**6):
        model = ordinal.train(docs, rated, 2, bits=12, sample_features=bound)
        assert np.count_nonzero(model.weights) > 0
    assert np.count_nonzero(ordinal.train(docs, rated, 2, bits=12, sample_rows=5).weights) > 0
    with pytest.raises(ValueError, match="sample_features"):
        ordinal.train(docs, rated, 2, bits=12, sample_features=3)


def brute_licenses(text):
    low = lowered(text)
    own = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    starts, found = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(own) - len(p) + 1):
            if own[i : i + len(p)] == p:
                starts.append(i)
                found.add(label)
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def test_licenses(spark):
    rng = random.Random(8)
    bits = ["GNU General-Public\nLICENSE", "apache license", "cc-by", "MIT License", "xmit license", "mit licensex", "é mit license", "mité license", "plain", "SPDX-License-Identifier: GPL-3.0-only", "licensed under the Apache License, Version 2.0", "word " * 50]
    rows = [(i, rng.choice(["", " ", "."]).join(rng.choice(bits) + " " for _ in range(rng.randrange(0, 9))), "c") for i in range(150)] + [(500, None, "c"), (501, "", "c"), (None, "mit license", "c")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = lambda t: [d[2].label for d in license_scan.scanner().detections(t)]
    assert labels("licensed under the apache license, version 2.0 and") == ["apache-2.0"]
    assert labels("spdx-license-identifier: mit") == ["mit"]
    assert labels("creative commons attribution-sharealike 4.0 international") == ["cc-by-sa-4.0"]
    assert labels("submit licenses; commit") == []
    assert len(license_scan.rules()) > 250


def spellings(tree):
    """Plain texts of an expression: every alternative, with and without each optional part."""
    outs = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            new = [chr(arg)]
        elif op in ("NOT_LITERAL", "ANY"):
            new = ["*"]
        elif op == "IN":
            new = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif op == "BRANCH":
            new = [x for branch in arg[1] for x in spellings(branch)]
        elif op == "SUBPATTERN":
            new = spellings(arg[3])
        else:
            assert op == "MAX_REPEAT", op
            new = [x * n for n in {arg[0], min(arg[1], arg[0] + 1)} for x in spellings(arg[2])]
        outs = [a + b for a in outs for b in dict.fromkeys(new)]
    return outs


def test_every_spelling_of_a_license_matches():
    lines = {x[0]: x for x in ([y.strip() for y in line.split(" | ")] for line in license_scan.LICENSES.splitlines())}
    own, scanner, seen = [r for r in license_scan.rules() if r.kind != "body"], license_scan.scanner(), 0
    before = {"tag": "spdx-license-identifier: ", "grant": "released under the ", "place": "https://www.", "name": "see "}
    for rule in own:
        _, tag, names, place, _ = lines[rule.label]
        for plain in spellings(re._parser.parse({"tag": tag, "place": place.lower()}.get(rule.kind, names))):
            for text in {before[rule.kind] + plain, before[rule.kind] + (plain if rule.kind in ("tag", "place") else plain.replace(" ", "\r\n"))}:
                assert rule.pattern.search(text) and any(k in text for k in rule.keywords), (rule.label, rule.kind, text)
                assert scanner.detections(text), text
                seen += 1
    assert seen > 1000
    labels = lambda t: [d[2].label for d in scanner.detections(t)]
    for short, label in (("gpl{}v3", "gpl-3.0"), ("gpl{}v2", "gpl-2.0"), ("lgpl{}v3", "lgpl-3.0"), ("lgpl{}v2.1", "lgpl-2.1"), ("agpl{}v3", "agpl-3.0"), ("agpl{}3", "agpl-3.0")):
        for space in ("", " ", "\n"):
            assert labels(f"released under {short.format(space)}.") == labels(f"({short.format(space)})") == [label]
    assert labels("cc\nby-sa 4.0") == ["cc-by-sa-4.0"] and labels("an account of success") == []


def test_sentences_of_license_texts():
    scanner = license_scan.scanner()
    labels = lambda t: [d[2].label for d in scanner.detections(t.lower())]
    for line in license_scan.BODIES.splitlines():
        label, expression, _ = (x.strip() for x in line.split(" | "))
        for plain in spellings(re._parser.parse(re.sub(r"(?<!\\)\.(?= |$)", r"\\.", expression)))[:40]:
            for text in (plain, plain.replace(" ", "\n * "), plain.replace('"', "\u201c").replace(" ", "\r\n# ")):
                found = scanner.detections(f"see. {text} and")
                assert any(r.label == label and a <= 6 for a, _, r in found), (label, text)
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the") == ["mit"]
    assert labels("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:") == ["bsd"]
    notice = "it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or"
    assert labels(notice) == ["gpl-3.0"] and labels(notice.replace("3", "2").replace("Foundation,", "Foundation;")) == ["gpl-2.0"]
    assert labels("SPDX-License-Identifier: MIT-0") == ["mit-0"] and labels("https://opensource.org/licenses/mit-0") == ["mit-0"]
    assert labels("SPDX-License-Identifier: MIT-CMU") == [] and labels("SPDX-License-Identifier: GPL-2.0-only WITH x") == ["gpl-2.0"]
    assert len(license_scan.rules()) > 400 and len(license_scan.BODIES.splitlines()) > 100


def test_suppression_matches_brute_force():
    rng, scanner = random.Random(12), license_scan.scanner()
    parts = [line.split(" | ")[1].replace("\\", "").replace("(?:", "").replace(")?", "").replace(")", "") for line in license_scan.BODIES.splitlines()]
    parts += ["spdx-license-identifier: ", "mit", "mit-0", "gpl-3.0-only", "bsd-3-clause", "licensed under the ", "released under ", "apache license, version 2.0", "mit license", "gnu general public license version 3", "lesser general public license", "https://opensource.org/licenses/", "http://www.gnu.org/licenses/gpl-3.0.html", "cc-by-sa 4.0", "cc by", "plain words", "bsd license", "3-clause bsd license", "the unlicense"]
    for _ in range(300):
        text = rng.choice(["", " ", "\n"]).join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 12)))
        raw = [(m.start(), m.end(), r) for r in scanner.rules for m in r.pattern.finditer(text)]
        inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and e[2] is not d[2]
        want = {(a, z, r.label, r.kind, r.priority) for a, z, r in raw if not any(inside((a, z, r), e) and (e[2].priority > r.priority or (e[2].priority == r.priority and (e[0], e[1]) != (a, z))) for e in raw)}
        got = [(a, z, r.label, r.kind, r.priority) for a, z, r in scanner.detections(text)]
        assert len(got) == len(set(got)) and set(got) == want, text


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    odd = ["a  b   c", "x \n y", "<|endoftext|> hi", "it's   fine\n\n then\t x", " lead", "trail ", "new\nline and's", "   z", "á \U0001f600!!", "a\x1c \x1db"]
    rows = [(i, t) for i, (_, t, *_) in enumerate(documents())] + [(1000 + i, t) for i, t in enumerate(odd)]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    for capacity, least in ((1024, 1), (64, 3)):
        pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, capacity, with_ids=True)
        got = packing.pack(pieces, capacity, rank_rows=17).collect()
        docs, places = {}, {}
        for r in got:
            assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            docs.setdefault(r.doc_id, []).append(r)
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for d, own in docs.items():
            own.sort(key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[d])
            assert all(r.length == capacity for r in own[1:])
        assert set(docs) == set(ids)
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(map(len, ids.values()))
        assert len(places) <= math.ceil(total / capacity) + max(least, len(places) // 50)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


def test_exact_complements_come_first():
    rng = random.Random(9)
    for capacity in (64, 200):
        for _ in range(40):
            histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))}
            plan = packing.packing_plan(histogram, capacity)
            used = collections.Counter()
            for pattern, times in plan:
                assert sum(pattern) <= capacity and times > 0
                for x in pattern:
                    used[x] += times
            assert used == histogram
            # An index of all sums, without the order of use, finds a filling where and only where there is one.
            free = np.zeros(capacity + 1, np.int64)
            for x, n in histogram.items():
                free[x] = rng.choice([0, 1, n])
            left, sums = collections.Counter({x: int(n) for x, n in enumerate(free) if n}), packing._Sums(free)
            enough = lambda *p: all(left[x] >= p.count(x) for x in p)
            for gap in rng.sample(range(1, capacity), 30):
                want = left[gap] or any(enough(a, gap - a) for a in range(1, gap)) or any(enough(a, b, gap - a - b) for a in range(1, gap) for b in range(1, gap - a))
                found = sums.filling(gap)
                assert bool(found) == bool(want) and (not found or (sum(found) == gap and enough(*found)))
                for x in found:
                    free[x] -= 1
                    left[x] -= 1
    assert packing.packing_plan({60: 5, 40: 5, 70: 2, 20: 2, 10: 2, 100: 1}, 100) == [((100,), 1), ((70, 20, 10), 2), ((60, 40), 5)]


def brute_statistics(text):
    text = text or ""
    own = [w for w in SPACE.split(text) if w]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(900)]
    rows = []
    for i in range(400):
        text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(2, 9)))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        if i % 10 == 1:
            text += "\n" + "\n".join([text.split("\n")[0]] * 12)
        rows.append((i, text, "en", "s0" if i % 3 else f"s{i % 7}", "q"))
    rows += [(900, None, None, None, "q"), (901, "", "en", None, "q"), (902, "a b c " * 100, "en", "s0", "q"), (903, "one two\n\none two\n \n", "en", "s0", "q"), (5, rows[5][1], "en", "s0", "q")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], DOCS + ", n_words int")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        r, want = by[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    fine = [by[i] for i in range(400) if i % 10 > 1 and not by[i].base_failed]
    assert all(r.kept for r in fine)
    assert not any(by[i].kept for i in range(0, 400, 10))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(docs.limit(0)).collect() == []
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(quality_rules.judge(docs)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan


def brute_fit(x, alpha=0.6):
    """The fits of four starts after ten steps, and which start was the best after two."""
    floors = np.array(list(quality_rules.STATS.values()))
    quartile = lambda share: np.array([(sorted(np.floor(x[:, k] * 128))[math.ceil(share * len(x)) - 1] + 0.5) / 128 for k in range(4)])
    low, middle, high = map(quartile, (0.25, 0.5, 0.75))
    wide = np.maximum(floors, (high - low) / 1.349)
    scale = quality_rules._consistency(alpha)

    def step(centre, factor, _=None):
        z = np.linalg.solve(factor, (x - centre).T)
        bins = np.floor(np.log1p((z**2).sum(0)) * 64)
        inside = x[bins <= sorted(bins)[math.ceil(alpha * len(x)) - 1]]
        factor = np.linalg.cholesky(scale * np.cov(inside.T, bias=True) + np.diag(floors**2))
        return inside.mean(0), factor, 2 * np.log(np.diag(factor)).sum()

    starts = [step(*step(c, np.diag(s))) for c, s in ((middle, floors), (middle, wide), (low, wide), (high, wide))]
    ends = list(starts)
    for _ in range(8):
        ends = [step(*f) for f in ends]
    return ends, int(np.argmin([f[2] for f in starts]))


def test_least_determinant_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal([1.6, 0.1, 0.02, 0.01], [0.05, 0.2, 0.03, 0.02], (500, 4))
    x[:90] += [0.9, 3, 0.5, 0.5]
    # Most of the second group is a dense cluster off the medians of a wide one.
    y = rng.normal([1.6, 2.0, 0.3, 0.3], [0.3, 1.2, 0.2, 0.25], (700, 4))
    y[:440] = rng.normal([3.2, 6.0, 1.5, 1.8], [0.02, 0.1, 0.02, 0.02], (440, 4))
    rows = [(g, *map(float, r)) for g, own in (("g", x), ("h", y)) for r in own]
    frame = spark.createDataFrame(rows, "_group string, " + ", ".join(f"{k} double" for k in quality_rules.STATS)).repartition(3)
    found = {r["_group"]: r for r in quality_rules.robust_fit(frame, Scratch(spark, "mcd-test"), least_fall=-math.inf).collect()}
    for group, own in (("g", x), ("h", y)):
        fits, best = brute_fit(own)
        centre, factor, spread = fits[best]
        assert spread <= min(f[2] for f in fits) + 1e-2
        got = found[group]
        assert [got[f"m_{i}"] for i in range(4)] == pytest.approx(centre.tolist(), rel=1e-4, abs=1e-4)
        assert [got[f"l_{i}_{j}"] for i in range(4) for j in range(i + 1)] == pytest.approx([factor[i, j] for i in range(4) for j in range(i + 1)], rel=1e-3, abs=1e-4)


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """User columns named like the stages' own, or with dots, come through unchanged."""
    import corpus_pipeline

    rng = random.Random(33)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    names = ["_row", "_class", "root", "_doc", "_spans", "kept", "a.b", "row", "class", "doc", "n", "_group", "x_word", "lists", "text2", "`q`"]
    shared, copy = line(60), line(90)
    texts = [(1, line(80)), (2, copy), (3, copy), (4, f"{line(70)} {shared}"), (5, f"{shared} {line(60)}"), (6, line(100)), (6, line(70)), (None, line(70))]
    rows = [(i, t, "en", "s0", len(t), *(f"{k}-{x}" for x in range(len(names)))) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x.replace('`', '``')}` string" for x in names)
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, line(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Scratch(spark, "named").save(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    got = sorted(tuple(r)[5:] for r in now.collect())
    assert got == sorted(r[5:] for r in rows if r[0] != 3)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= 7


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    long, shared = line(150), line(60)
    rows = [
        *documents(3),
        (3000, long, "en", "s0", "one id, first text"), (3000, line(120), "en", "s0", "one id, second text"), (3001, long, "en", "s1", "copy"),
        (3002, f"{line(80)} {shared}", "en", "s0", "passage"), (3002, f"{shared} {line(90)}", "en", "s0", "passage again"),
        (None, line(100), "en", "s0", "no id"), (None, f"{line(70)} {shared}", "en", "s0", "no id, passage"), (None, None, None, None, "nothing"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shown = docs.filter("length(text) > 400 and doc_id < 200").first()
    spark.createDataFrame([(0, " ".join(words(shown.text)[5:40])), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = collections.Counter(r.extra for r in now.collect())
        now = Scratch(spark, "stage").save(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        seen[name] = {r.extra: r for r in now.collect()}
        assert not collections.Counter(r.extra for r in now.collect()) - before
    own = {"one id, first text", "one id, second text", "copy", "passage", "passage again", "no id", "no id, passage"}
    assert own <= set(seen["quality_rules"]) and "nothing" not in seen["quality_rules"]
    assert own - set(seen["jaccard_join"]) == {"copy"}
    cut = {k: len(words(seen["suffix_dedup"][k].text)) for k in own - {"copy"}}
    assert cut["one id, first text"] == 150 and cut["one id, second text"] == 120 and cut["no id"] == 100 and cut["no id, passage"] == 70
    assert sorted((cut["passage"], cut["passage again"])) in ([80, 150], [90, 140])
    left = collections.Counter(r.doc_id for r in now.collect())
    assert shown.doc_id not in left and left[None] == 2 and left[3000] == left[3002] == 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == left
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
