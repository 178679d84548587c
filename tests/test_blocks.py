"""Partners of blocks against all pairs, recogniser forms, and work that follows the number of blocks."""

import random

from pyspark.sql import functions as F

from lurelens.operators import blocks

SCHEMA = "image_id string, block_idx int, bbox array<array<double>>, text string, confidence double, script string"


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def overlap(a, b):
    w = max(0, min(a[2][0], b[2][0]) - max(a[0][0], b[0][0]))
    h = max(0, min(a[2][1], b[2][1]) - max(a[0][1], b[0][1]))
    area = lambda x: (x[2][0] - x[0][0]) * (x[2][1] - x[0][1])
    whole = area(a) + area(b) - w * h
    return w * h / whole if whole else 0.0


def brute(hindi, english):
    out = set()
    for i, hi, a, *_ in hindi:
        near = [(overlap(a, b), -en) for j, en, b, *_ in english if j == i]
        if near and max(near)[0] > 0.5:
            out.add((i, hi, -max(near)[1]))
    return out


def table(rng, script, n):
    out = []
    for i in range(n):
        w, h = rng.choice([(64, 16), (4, 4), (1, 1), (37.5, 12), (300, 40), (0, 10), (15.99, 64.0)])
        x, y = rng.choice([rng.uniform(-40, 400), 64.0 * rng.randrange(5)]), rng.choice([rng.uniform(-40, 300), 16.0 * rng.randrange(9)])
        out.append((f"i{rng.randrange(3)}", i, box(x, y, float(w), float(h)), "t", 0.9, script))
    return out


def test_partners_match_all_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        english = table(rng, "en", 150)
        # Each second Hindi block is an English one, moved and stretched up to the limit.
        hindi = table(rng, "hi", 60)
        for k, (i, _, b, *_) in enumerate(rng.sample(english, 90)):
            (x, y), (z, t) = b[0], b[2]
            s, r, dx, dy = rng.choice([1, 0.51, 0.72, 1.4, 1.96]), rng.choice([1, 0.8, 1.3]), rng.choice([0, 0.1, 0.3, 0.49]), rng.choice([0, 0.2])
            hindi.append((i, 100 + k, box(x + dx * (z - x), y + dy * (t - y), s * (z - x), r * (t - y)), "t", 0.9, "hi"))
        got = blocks.best_partner(spark.createDataFrame(hindi, SCHEMA), spark.createDataFrame(english, SCHEMA)).collect()
        assert {(r.image_id, r.hi, r.en) for r in got} == brute(hindi, english)


def test_candidates_follow_the_number_of_blocks(spark):
    """One image with many words on few lines: pairs that are compared grow with the blocks, not with their square."""
    made = {}
    for n in (2000, 4000):
        rows = spark.range(n).select(F.lit("i").alias("image_id"), F.col("id").cast("int").alias("block_idx"), (F.col("id") % 1000 * 30).alias("x"), (F.floor(F.col("id") / 1000) * 20).alias("y"))
        corner = lambda a, b: F.array((F.col("x") + a).cast("double"), (F.col("y") + b).cast("double"))
        rows = rows.select("image_id", "block_idx", F.array(corner(0, 0), corner(25, 0), corner(25, 12), corner(0, 12)).alias("bbox"))
        seen = []
        compare = blocks.labels.box_overlap
        counter = spark.sparkContext.accumulator(0)

        def watched(a, b, counter=counter, compare=compare):
            return F.udf(lambda v: counter.add(1) or v, "double")(compare(a, b))

        blocks.labels.box_overlap = watched
        try:
            seen = blocks.best_partner(rows, rows).collect()
        finally:
            blocks.labels.box_overlap = compare
        assert len(seen) == n and all(r.hi == r.en for r in seen)
        made[n] = counter.value
    assert made[4000] < 2.5 * made[2000] and made[4000] < 100 * 4000


def test_pairs_of_a_recogniser(spark):
    items = "array<struct<bbox: array<array<int>>, text: string, confidence: double>>"
    good = [[0, 0], [5, 0], [5, 2], [0, 2]]
    rows = spark.createDataFrame([("i", [(good, "a", 0.9), (good[:3], "three corners", 0.9), (good, None, 0.9), (good, "b", None)]), ("j", []), ("k", None)], f"image_id string, items {items}")
    got = blocks.explode_pairs(rows, "en").collect()
    assert [(r.image_id, r.block_idx, r.text, r.confidence, r.script) for r in got] == [("i", 0, "a", 0.9, "en"), ("i", 3, "b", 0.0, "en")]
