"""Jaccard join, suffix dedup and decontamination against brute force."""

import random
import re

from lurelens.llm import decontaminate, jaccard_join, suffix_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra string"


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in SPACE.split(low) if w]


def family(rng, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(len(w) * rng.choice(share))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [None, "", "  \t ", "one two", "One\ttwo", "a b c d", "a b c d e", "A b c d e", "a b c d e", "long " * 3000]
    out += [" ".join(line(rng.randrange(5, 120))) for _ in range(40)]
    out += family(rng, line(150), 40, [0.0, 0.01, 0.02, 0.03, 0.05])
    passage = line(60)
    out += [" ".join(line(rng.randrange(3, 15)) + passage + line(rng.randrange(3, 15))) for _ in range(20)]
    return [(i * 7 % 1009, t, "clash") for i, t in enumerate(out)]


def brute_components(rows, n=5, percent=75):
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, *_) in enumerate(rows))


def linked(df, **options):
    return sorted(tuple(r) for r in jaccard_join.link(df, **options).collect())


def test_components_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_components(rows)
    assert linked(df) == want


def test_long_lists_and_blocks_match_brute_force(spark):
    rows = texts(5)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert linked(df, long_list=4, block=3) == brute_components(rows)


def test_keep_one_and_edges(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "q r s", "z"), (9, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.extra) for r in jaccard_join.keep_one(df).collect())
    assert kept == [(-1, "z"), (2, "y"), (9, None)]
    assert jaccard_join.link(df.limit(0)).collect() == []


def test_keep_one_keeps_each_text_of_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a b c d e f", "copy of 2"), (5, "g h i j k l", "alone"), (2, "a b c d e f", "least"), (7, "m n o p q r", "first"), (7, "s t u v w x", "second"), (7, "", "empty")]
    rows += [(8, "one text on two rows", "same"), (8, "one text on two rows", "same"), (9, long, "near"), (9, f"{long} more", "near"), (None, "m n o p q r", "no id")]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.extra for r in jaccard_join.keep_one(df).collect())
    assert kept == sorted(["alone", "least", "first", "second", "empty", "same", "near", "no id"])


def test_keep_one_carries_columns_of_any_name(spark):
    rows = [(5, "a b c d e f", 7, 1, "x", "u"), (5, "g h i j k l", 8, 2, "y", "v"), (2, "a b c d e f", 9, 3, "z", "w"), (None, "q", 4, 4, "n", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _class long, `a.b` string, root string")
    assert sorted(tuple(r)[1:] for r in jaccard_join.keep_one(df).collect()) == sorted(r[1:] for r in rows[1:])
    # Of rows with equal sets the choice does not depend on their order.
    same = [(1, t, k, k, str(k), "") for k, t in enumerate(["A b c d e f", "a b c d e f", "a B c d e f"])]
    found = {tuple(jaccard_join.keep_one(spark.createDataFrame(rows, df.schema).repartition(3, "_row")).collect()[0]) for rows in (same, same[::-1])}
    assert found == {same[0]}


def test_texts_of_a_template_ask_in_no_long_list(spark):
    """Unlinked texts that share a template make no pairs of each other, so twice the rows are twice the work."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(170)]
    rows = [(i, " ".join([f"u{i}_{k}" for k in range(rng.randrange(36, 44))] + template), "") for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} {i}", "") for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    asked = []
    save = jaccard_join.Scratch.save

    def watched(self, frame, name):
        out = save(self, frame, name)
        asked.extend([out.count()] if name in ("asked", "rooted", "pairs") else [])
        return out

    jaccard_join.Scratch.save = watched
    try:
        assert linked(df, long_list=16) == brute_components(rows)
    finally:
        jaccard_join.Scratch.save = save
    assert max(asked) < 200


def test_passages_in_many_mixes_match_brute_force(spark):
    """Texts put together from frequent passages alone: every shingle is in a long list."""
    rng = random.Random(9)
    passages = [" ".join(f"p{k}_{i}" for i in range(14)) for k in range(12)]
    rows = [(i, " ".join(rng.sample(passages, rng.randrange(5, 11))), "") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for options in ({"long_list": 3, "block": 16}, {"long_list": 20, "block": 1024}):
        assert linked(df, **options) == brute_components(rows)


def brute_windows(rows, n=50):
    seen = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    marked = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marked.setdefault((d, (d, i) == min(places)), set()).update(range(i, i + n))
    return marked


def covered(spans):
    out = {}
    for r in spans:
        out.setdefault((r.doc_id, r.is_first), set()).update(range(r.first_word, r.end_word))
    return out


def passages(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [line(n) for n in (49, 50, 51, 80, 200)]
    out = []
    for i in range(40):
        w = line(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            w += rng.choice(shared) + line(rng.randrange(0, 40))
        out.append((i, " ".join(w)))
    return [*out, (40, "same word " * 60), (41, None), (42, ""), (43, out[0][1]), (44, out[0][1])]


def test_repeats_match_brute_force(spark):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_windows(rows)
    assert covered(suffix_dedup.repeated_spans(df).collect()) == want
    assert covered(suffix_dedup.repeated_spans(df, hot=1).collect()) == want


def test_cut_finds_rows_by_themselves(spark):
    rng = random.Random(7)
    line = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, other = line(60), line(70)
    rows = [
        (1, " ".join(line(5) + shared + line(4)), "a", "t"),
        (1, " ".join(line(90)), "b", "t"),
        (1, " ".join(shared + line(20)), "c", None),
        (None, " ".join(line(8) + shared), "d", "t"),
        (None, " ".join(other), "e", "t"),
        (0, " ".join(other + line(3)), "f", "t"),
        (2, None, "g", "t"),
        (2, "", "h", "t"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, __text string").repartition(3)
    for hot in (20_000, 1):
        got = {r["_row"]: r for r in suffix_dedup.cut_repeats(df, hot=hot).collect()}
        assert sorted(got) == list("abcdefgh") and all((got[r[2]].doc_id, got[r[2]]["__text"]) == (r[0], r[3]) for r in rows)
        left = {k: words(r.text) for k, r in got.items()}
        keeps = [k for k in "ac" if len(left[k]) == len(words(dict((r[2], r[1]) for r in rows)[k]))]
        assert len(keeps) == 1 and left["b"] == words(rows[1][1])
        assert {k: len(left[k]) for k in "ac" if k not in keeps} in ({"a": 9}, {"c": 20})
        assert len(left["d"]) == 8 and left["e"] == [] and left["f"] == words(rows[5][1])
        assert got["g"].text is None and got["h"].text == ""
        spans = suffix_dedup.repeated_spans(df, hot=hot).collect()
        assert sorted((r.doc_id is None, r.is_first) for r in spans) == [(False, False), (False, True), (False, True), (True, False), (True, False)]


def test_cut_keeps_first_occurrence(spark):
    rows = [(i, t, "e") for i, t in passages(2)]
    df = spark.createDataFrame(rows, DOCS)
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(df).collect()}
    later = {d: own for (d, first), own in brute_windows([r[:2] for r in rows]).items() if not first}
    for d, t, _ in rows:
        left = [w for i, w in enumerate(words(t)) if i not in later.get(d, ())]
        assert words(cut[d]) == left
    assert cut[41] is None
    assert suffix_dedup.repeated_spans(df.limit(0)).collect() == []


def test_decontamination(spark):
    rng = random.Random(0)
    vocabulary = [f"v{i}" for i in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [line(40) for _ in range(30)] + [line(6)]
    docs, want = [], set()
    for i in range(120):
        w = line(rng.randrange(0, 80))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            own = list(items[k])
            if i % 2 and len(own) > 6:
                for at in (9, 19, 29):
                    own[at] = "changed"
            w = w[:30] + own + w[30:]
            want.add((i, k))
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w), "z"))
    docs += [(900, None, None), (901, "", "")]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(df, bench).collect()}
    assert found == want
    dealt = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(df, bench, hot_rows=2).collect()}
    assert dealt == want
    kept = {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in want}
    assert decontaminate.find_overlaps(df, bench.limit(0)).collect() == []
    assert decontaminate.find_overlaps(df.limit(0), bench).collect() == []


def test_decontamination_judges_rows_by_their_text(spark):
    rng = random.Random(11)
    line = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    item, short = line(30), line(4)
    leak, part = " ".join(line(9) + item + line(9)), " ".join(line(3) + short + line(5))
    rows = [(1, leak, "a", 0), (1, " ".join(line(40)), "b", 0), (None, leak, "c", None), (None, " ".join(line(40)), "d", 0), (2, part, "e", 0), (3, None, "f", 0), (3, "", "g", 0), (4, leak.upper(), "h", 0), (4, leak, "i", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _name string, _part int").repartition(3)
    bench = spark.createDataFrame([(7, " ".join(item), "z"), (8, " ".join(item), "z"), (None, " ".join(short), "z"), (9, None, "z"), (9, "", "z")], "item_id long, text string, doc_id string")
    for hot_rows in (50_000, 1):
        kept = decontaminate.remove_contaminated(df, bench, hot_rows=hot_rows)
        assert kept.columns == df.columns and sorted(r["_name"] for r in kept.collect()) == list("bdfg")
        found = sorted((str(r.doc_id), str(r.item_id), r.matched_words) for r in decontaminate.find_overlaps(df, bench, hot_rows=hot_rows).collect())
        assert found == sorted([(d, i, 30) for d in ("1", "None", "4", "4") for i in ("7", "8")] + [("2", "None", 4)])


def test_short_items_and_their_edited_copies_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [[f"only{n}x{k}" if n == 1 else w for w in line(n)] for n in range(1, 17) for k in range(2)]
    least = lambda n: n if n < 6 else min(13, -(-n * 4 // 5))
    docs, planted = [], set()
    for k, item in enumerate(items):
        for replaced in range(len(item) - least(len(item)) + 2):
            own = list(item)
            for at in rng.sample(range(len(own)), min(replaced, len(own))):
                own[at] = "changed"
            if len(item) - replaced >= least(len(item)):
                planted.add((len(docs), k))
            docs.append((len(docs), " ".join(line(rng.randrange(0, 20)) + own + line(rng.randrange(0, 20))), "z"))
    want = {}
    for d, text, _ in docs:
        w = words(text)
        for k, item in enumerate(items):
            runs = []
            for shift in range(-len(item), len(w)):
                same = [shift + j for j in range(len(item)) if 0 <= shift + j < len(w) and w[shift + j] == item[j]]
                if len(same) >= least(len(item)):
                    runs.append((len(same), -same[0], same[-1] + 1))
            if runs:
                m, a, z = max(runs)
                want[d, k] = (m, len(item), -a, z)
    assert planted <= set(want)
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.find_overlaps(df, bench).collect()} == want


def test_recall_of_replaced_words(spark):
    """Items of 40 words with a tenth to three in ten replaced: all that the definition calls an overlap are found."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    docs, asked = [], []
    for share in (0.1, 0.2, 0.25, 0.3):
        for i, text in items:
            own = text.split()
            for k in rng.sample(range(40), int(40 * share)):
                own[k] = word()
            place = rng.randrange(30)
            docs.append((len(docs), " ".join([*(word() for _ in range(place)), *own, *(word() for _ in range(20))]), ""))
            asked.append((share, i, own, text.split()))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    wanted = {share: set() for share, *_ in asked}
    for d, (share, i, own, text) in enumerate(asked):
        # The best run of matches, of which each replaced word costs two.
        best = run = matches = 0
        for x, y in zip(own, text, strict=True):
            run, matches = (run + 1, matches + 1) if x == y else (run - 2, matches)
            if run < 0:
                run = matches = 0
            if run > best:
                best, top = run, matches
        if best and top >= decontaminate.LEAST_WORDS:
            wanted[share].add((d, i))
    assert found <= set().union(*wanted.values())
    recall = {share: len(found & own) / len(own) for share, own in wanted.items() if own}
    assert recall[0.1] == recall[0.2] == 1.0 and min(recall.values()) >= 0.97, recall
