"""Repair of the turn structure of conversations by depth-first branch-and-bound.

A conversation is repaired when the initials of its roles read ``s?(ua)+`` or it
is empty.  Rows may be kept, given the role that fits, or deleted, and empty
turns may be inserted; each edit has a cost, and of the cheapest repairs that
with the least audit (the edits' initials, in byte order) is the answer.  Blank
rows and repeats of an earlier row must go; a truncated row that stays costs one.

The search goes down one explicit stack.  A node is a row, a state of the
pattern and the edits so far.  A node is left when its cost and the least cost
of the rows behind it (a bound from truncated rows and from disjoint pairs of
neighbours that do not fit) exceed the incumbent, when it equals the
incumbent's cost with a greater audit, or when the dominance table holds a
better way to the same row and state.

Rows are put in order by ranges of conversation, turn, role and text, so a
conversation with a third of all rows is dealt over many tasks.  Each task cuts
a conversation into pieces of at most ``PIECE_ROWS`` rows that need a decision.
One that lies inside a task and has one piece is solved there.  For others each
piece is solved from every state into every state, the pieces' small tables are
put together, and repaired text is hashed in order, piece after piece.

Nulls and edge cases: null roles and texts are one space; null turns come
first; a null id is a conversation of its own; rows of equal turn are taken by
role and a hash of their text, and equal rows stand side by side; conversations
without a row have cost 0 and an empty audit; empty roles and roles with
another initial cannot be kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that need a decision, and characters of their text, in a piece; characters a task gathers before it hands them on.
PIECE_ROWS, PIECE_CHARS, FLUSH_CHARS = 128, 1 << 20, 4 << 20
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and the last may end a conversation.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only role that may be set or inserted in a state.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ENDS = (0, 3)
FITS = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies``: what is left of each row after a fault that its id and turn decide.

    Of 20 rows one is dropped (no copy), one emptied, one loses its full stops,
    one is repeated (two copies) and one becomes the user's; nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def least_costs(rows: list[tuple[str, int]]) -> list[int]:
    """For each suffix a cost that no repair of it falls below.

    Of rows that are disjoint, each pair of neighbours that does not fit and each row
    of an unknown role needs an edit of its own; a row that stays pays for being cut off.
    """
    n = len(rows)
    edits, extra = [0] * (n + 2), 0
    out = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        role, cut = rows[i]
        extra += cut
        edits[i] = edits[i + 1] + (role not in ("s", "u", "a"))
        if i + 1 < n and role + rows[i + 1][0] not in FITS:
            edits[i] = max(edits[i], edits[i + 2] + 1)
        out[i] = extra + 2 * edits[i]
    return out


def search(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...], bounds: list[int]) -> tuple[int, str] | None:
    """The cheapest edits, and of these the least audit, that lead from a state over rows (initial, cut off) into one of ``ends``."""
    n, best = len(rows), None
    dominance: dict[tuple[int, int, bool], tuple[int, str]] = {}
    stack = [(0, start, 0, "", False)]
    while stack:
        i, state, cost, audit, inserted = stack.pop()
        least = cost + bounds[i]
        if best is not None and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)])):
            continue
        key = (i, state, inserted)
        if key in dominance and dominance[key] <= (cost, audit):
            continue
        dominance[key] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        # Inserting before a deletion never gives the least audit, so it is followed by a row that stays or by the end.
        children = [(i, STEP[state, NEXT[state]], cost + INSERT, audit + "I", True)]
        if i < n:
            role, cut = rows[i]
            children.append((i + 1, STEP[state, NEXT[state]], cost + REROLE + cut, audit + "R", False))
            if not inserted:
                children.append((i + 1, state, cost + DELETE, audit + "D", False))
            if (state, role) in STEP:
                children.append((i + 1, STEP[state, role], cost + KEEP + cut, audit + "K", False))
        # The most promising child is looked at first; of equals the one with the lesser audit.
        children.sort(key=lambda c: (c[2] + bounds[c[0]], c[3]), reverse=True)
        stack += children
    return best


Table = dict[tuple[int, int], tuple[int, str]]


def _table(rows: list[tuple[str, int]]) -> Table:
    bounds = least_costs(rows)
    found = {(a, z): search(rows, a, (z,), bounds) for a in range(4) for z in range(4) if not (z < 2 and a > z)}
    return {k: v for k, v in found.items() if v is not None}


def _chained(one: Table, two: Table) -> Table:
    """The table of two runs of rows after one another."""
    out: Table = {}
    for (a, m), (cost, audit) in one.items():
        for (k, z), (more, rest) in two.items():
            if k == m:
                way = (cost + more, audit + rest)
                if (a, z) not in out or way < out[a, z]:
                    out[a, z] = way
    return out


def _woven(audit: str, runs: list[int]) -> str:
    """The audit with the rows that had to go: ``runs[i]`` of them stand before row i, the last entry behind all rows."""
    out, i = ["D" * runs[0]], 0
    for x in audit:
        out.append(x)
        if x != "I":
            i += 1
            out.append("D" * runs[i])
    return "".join(out)


def apply_edits(audit: str, roles: list[str], texts: list[str], place: int, opening: bool) -> list[tuple[str, str]]:
    """The repaired rows (role, text) of a run.

    ``place`` rows were given before it; ``opening`` says whether the conversation begins with a system turn.
    """
    out, i = [], 0
    for x in audit:
        fits = ROLES["ua"[(place + len(out) - opening) % 2]]
        if x == "I":
            out.append((fits, ""))
            continue
        if x != "D":
            out.append((roles[i] if x == "K" else fits, texts[i]))
        i += 1
    return out


def _opening(audit: str) -> bool:
    """The user's and the assistant's turns are even in number, so an odd number has a system turn in front."""
    return (len(audit) - audit.count("D")) % 2 == 1


class _Piece:
    """Rows of one conversation, with what a table of pieces has to know about them."""

    def __init__(self, number: int):
        self.number = number
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.chars = 0
        self.low = self.high = self.last = self.first_role = self.last_role = None
        self.rows: list[tuple[str, int]] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.runs = [0]

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        if not copies:
            return
        self.n += copies
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in FITS
        else:
            self.first_role = initial
        self.illegal += copies - 1
        self.last_role = initial
        bare = text.rstrip(SPACE)
        if not bare:
            self.blank += copies
        else:
            self.duplicate += copies - first
            if first:
                cut = bare[-1] not in ".!?"
                self.truncated += cut
                self.rows.append((initial, int(cut)))
                self.roles.append(role)
                self.texts.append(text)
                self.runs.append(0)
                self.chars += len(text)
                copies -= 1
        self.runs[-1] += copies

    def full(self, piece_rows: int) -> bool:
        return len(self.rows) >= piece_rows or self.chars >= PIECE_CHARS


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _whole(piece: _Piece) -> dict:
    """The answer for a conversation of one piece."""
    cost, audit = search(piece.rows, 0, ENDS, least_costs(piece.rows))
    repaired = apply_edits(audit, piece.roles, piece.texts, 0, _opening(audit))
    text = "\n".join(f"{role}:{text}" for role, text in repaired)
    return {
        "gaps": 0 if piece.low is None else piece.high - piece.low + 1 - piece.turns,
        **{k: getattr(piece, k) for k in _COUNTS[1:]},
        "cost": cost + DELETE * sum(piece.runs),
        "audit": _woven(audit, piece.runs),
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def _pieces(schema: pa.Schema, piece_rows: int, all_tables: bool):
    """Rows in order become pieces; conversations of one piece that the task holds whole become answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, chars = TaskContext.get().partitionId(), [], 0
        now, conv, border = None, None, True

        def closed(end: bool) -> dict:
            row = {"conv_id": conv, "part": part, "piece": now.number, "whole": end and not border and not now.number and not all_tables}
            if row["whole"]:
                return row | _whole(now)
            table = sorted((a, z, *v) for (a, z), v in _table(now.rows).items())
            names = ("start", "end", "cost", "audit")
            own = {k: getattr(now, k) for k in ("low", "high", "turns", "first_role", "last_role", "roles", "texts", "runs", *_COUNTS)}
            return row | own | {"table": [dict(zip(names, x, strict=True)) for x in table]}

        for batch in batches:
            for c, turn, role, text, copies, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out.append(closed(True))
                        border = False
                    now, conv = _Piece(0), c
                elif now.full(piece_rows):
                    out.append(closed(False))
                    now = _Piece(now.number + 1)
                now.add(turn, role, text, copies, first)
                chars += len(text)
                if out and (chars >= FLUSH_CHARS or len(out) >= 4096):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
        if now is not None:
            # The next task may go on with this conversation.
            border = True
            out.append(closed(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _joined(table: pa.Table) -> pa.Table:
    """The pieces of a conversation: edits of each piece, and on the first the totals."""
    pieces = sorted(table.to_pylist(), key=lambda x: (x["part"], x["piece"]))
    tables = [{(x["start"], x["end"]): (x["cost"], x["audit"]) for x in p["table"]} for p in pieces]
    while len(tables) > 1:
        tables = [_chained(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    cost, audit = min(tables[0][0, z] for z in ENDS if (0, z) in tables[0])
    out, at, place, woven = [], 0, 0, []
    for k, p in enumerate(pieces):
        end, left = at, len(p["runs"]) - 1
        while end < len(audit) and left:
            left -= audit[end] != "I"
            end += 1
        end = len(audit) if k == len(pieces) - 1 else end
        own = audit[at:end]
        woven.append(_woven(own, p["runs"]))
        out.append({"conv_id": p["conv_id"], "part": p["part"], "piece": p["piece"], "edits": own, "place": place, "opening": _opening(audit)})
        at, place = end, place + len(own) - own.count("D")
    turned = [p for p in pieces if p["turns"]]
    seen = [p for p in pieces if p["n"]]
    turns = sum(p["turns"] for p in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
    totals = {k: sum(p[k] for p in pieces) for k in _COUNTS[1:]}
    totals["illegal"] += sum(a["last_role"] + b["first_role"] not in FITS for a, b in zip(seen, seen[1:], strict=False))
    totals["gaps"] = turned[-1]["high"] - turned[0]["low"] + 1 - turns if turned else 0
    out[0] |= totals | {"cost": cost + DELETE * sum(sum(p["runs"]) for p in pieces), "audit": "".join(woven)}
    kinds = {"part": pa.int32(), "piece": pa.int32(), "edits": pa.string(), "place": pa.int64(), "opening": pa.bool_(), **{k: pa.int64() for k in ("gaps", *_COUNTS[1:], "cost")}, "audit": pa.string()}
    return pa.Table.from_pylist(out, pa.schema([table.schema.field("conv_id"), *kinds.items()]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired text of pieces."""
    for batch in batches:
        blobs = []
        for edits, place, opening, roles, texts in zip(*(batch.column(k).to_pylist() for k in ("edits", "place", "opening", "roles", "texts")), strict=True):
            rows = apply_edits(edits, roles, texts, place, opening)
            text = "\n".join(f"{role}:{text}" for role, text in rows).encode()
            blobs.append(b"\n" * bool(rows and place) + text)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv_id", "part", "piece")), pa.array(blobs, pa.binary())], ["conv_id", "part", "piece", "blob"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for the blobs of each conversation, which come in order; only one blob is looked at at a time."""
    now, conv, kind = None, None, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for c, blob in zip(batch.column("conv_id").to_pylist(), batch.column("blob"), strict=True):
            if now is None or c != conv:
                out += [] if now is None else [(conv, now.hexdigest())]
                now, conv = hashlib.sha256(), c
            now.update(blob.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out], pa.string())], ["conv_id", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS, all_tables: bool = False) -> DataFrame:
    """A row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    ``turns`` holds conv_id, turn, role, text and copies; rows without a copy
    only keep their conversation in the result.  ``all_tables`` sends every
    conversation by way of pieces, as long ones go.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    kind = turns.schema["conv_id"].dataType
    # Equal rows are one from here on, so no key is left that ranges could not deal out.
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumn("name", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # Where a role and text come first: a turn, or null if that is one of them.
    spoken = rows.filter("copies > 0").groupBy("conv_id", "name").agg(F.bool_or(F.col("turn").isNull()).alias("bare"), F.min("turn").alias("turn"))
    firsts = spoken.select(F.col("conv_id").alias("c"), F.col("name").alias("m"), F.when(~F.col("bare"), F.col("turn")).alias("t"))
    same = rows["conv_id"].eqNullSafe(firsts["c"]) & (rows["name"] == firsts["m"]) & rows["turn"].eqNullSafe(firsts["t"])
    marked = rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", F.col("m").isNotNull().alias("first"), "name")
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("name")]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("name")

    name = kind.simpleString()
    fields = f"conv_id {name}, part int, piece int, whole boolean, {_TOTALS}, repaired_sha256 string, n long, low long, high long, turns long, first_role string, last_role string, runs array<long>, table array<struct<start:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
    empty = turns.sparkSession.createDataFrame([], fields)
    pieces = scratch.save(ordered.mapInArrow(_pieces(_arrow(empty), piece_rows, all_tables), fields), "pieces")
    answers = pieces.filter("whole").select("conv_id", *(x.split()[0] for x in _TOTALS.split(", ")), "repaired_sha256")

    parts = pieces.filter("NOT whole")
    bare = parts.select("conv_id", "part", "piece", "low", "high", "turns", "first_role", "last_role", *_COUNTS, "runs", "table")
    edits = bare.groupBy("conv_id").applyInArrow(_joined, f"conv_id {name}, part int, piece int, edits string, place long, opening boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    edits = scratch.save(edits, "edits")
    mine = edits.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("piece").alias("k"), "edits", "place", "opening")
    both = parts["conv_id"].eqNullSafe(mine["c"]) & (parts["part"] == mine["p"]) & (parts["piece"] == mine["k"])
    blobs = parts.select("conv_id", "part", "piece", "roles", "texts").join(mine, both).drop("c", "p", "k").mapInArrow(_texts, f"conv_id {name}, part int, piece int, blob binary")
    hashes = blobs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_digests, f"conv_id {name}, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "c")
    totals = edits.filter("audit IS NOT NULL")
    long = totals.join(hashes, totals["conv_id"].eqNullSafe(hashes["c"])).select(*answers.columns)
    return answers.unionByName(long)


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)
