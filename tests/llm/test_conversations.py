"""Conversation repair against a search in order of cost."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lurelens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, copies string, first string, name string"
PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repaired(rows):
    """Gaps, faults, cost, audit and hash of rows (turn, role, text) in any order."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, given, kept = heapq.heappop(heap)
        state = (i, given and ("s" if given == "s" else given[-1]))
        if i == len(rows) and PATTERN.fullmatch(given):
            break
        if (state, audit[-1:] == "I") in done:
            continue
        done.add((state, audit[-1:] == "I"))
        for role in ("user", "assistant"):
            if PATTERN.fullmatch(given + role[0]) or PATTERN.fullmatch(given + role[0] + "a"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, given + role[0], (*kept, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, given, kept))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                for edit, as_role, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    now = given + as_role[:1]
                    if as_role and any(PATTERN.fullmatch(now + rest) for rest in ("", "a", "ua")):
                        heapq.heappush(heap, (cost + price + cut, audit + edit, i + 1, now, (*kept, (as_role, text))))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def table(seed, n=60):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "yes", None, "", "  \n", "Ok?\t", "a:b\nc", "Sí!", f"t{turn}.", f"t{turn}", f"u{rng.randrange(99)}."])
            out.append((conv or None, rng.choice([turn, turn, turn + 2, None]), role, text))
    return out + out[:3]


def answers(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("options", [{}, {"piece_rows": 3}, {"all_tables": True}, {"piece_rows": 1, "all_tables": True}])
def test_repair(spark, options):
    rows = table(len(str(options)))
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = answers(conversations.repair(conversations.damage(frame), **options))
    assert got == {c: repaired(damaged([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


def test_hot_conversation(spark):
    """A third of all rows is one conversation, which many tasks share; one text is said a thousand times in it."""
    rng = random.Random(5)
    hot = [(7, t, rng.choice(["user", "assistant"]), "again." if rng.random() < 0.5 else f"n{t}{rng.choice(['.', ''])}") for t in range(2000)]
    rest = [(100 + i, t, ("user", "assistant")[t % 2], f"w{t}.") for i in range(1000) for t in range(4)]
    frame = spark.createDataFrame(hot + rest, "conv_id long, turn long, role string, text string")
    counts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = answers(conversations.repair(conversations.damage(frame), piece_rows=64))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", counts)
    assert got[7] == repaired(damaged(hot))
    assert len(got) == 1001


def test_bounds_hold():
    """No suffix costs less than its bound, and every state's least cost is found."""
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.randrange(2)) for _ in range(rng.randrange(7))]
        bounds = conversations.least_costs(rows)
        for i in range(len(rows) + 1):
            free = [0] * (len(rows) - i + 1)
            found = [conversations.search(rows[i:], state, conversations.ENDS, free) for state in range(4)]
            assert bounds[i] <= min(x[0] for x in found if x)
            assert found == [conversations.search(rows[i:], state, conversations.ENDS, bounds[i:]) for state in range(4)]


def test_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(empty)).count() == 0
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert answers(conversations.repair(conversations.damage(one))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.damage(one).filter(F.col("copies") > 0).isEmpty()
