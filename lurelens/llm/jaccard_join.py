"""Exact Jaccard join of word-shingle sets by T-occurrence search.

Equal sets are one class from the start.  Shingles have one global order, rare
ones first, and an inverted list each.  For a set of n shingles and a
similarity s, a partner shares at least T of them, so it is enough to merge the
lists of the first n - ceil(s n) + 1 shingles (DivideSkip's short lists): a
partner occurs in them at least T minus the number of lists left out.  The
lists left out, which are the long ones, are only probed: the sets that
reached the bound are compared by binary search.

Lists are merged in hash ranges, each a bounded number of entries.  Which
shingles are frequent is counted first, over all texts; bit tables of a fixed
size tell the tasks.  A list longer than ``long_list``, such as that of a passage
in a large group of copies, is never turned into all its pairs.  Pairs that
share a short list are counted there, and long lists only add to what they may
reach.  Pairs that share long lists alone meet in one where the smaller set holds
the shingle among its first n - ceil(2 s n / (1 + s)) + 1: fewer would not do for a
partner that is no smaller.  Only such members ask in a long list, so texts
that share a passage and are not alike, whose rare shingles come first, ask in
none.  Members are first compared with the member that has most such lists;
of the rest, those that ask merge their long lists within blocks of ``block``
members, and only pairs in different components that meet the occurrence bound
are made.

Nulls and edge cases: texts with fewer words than a shingle have their whole
sequence as one; null, empty and blank texts have no shingles, link with
nothing and have their own id as component; a null id is carried and never
becomes a component's id unless the component has no other (then it is null);
repeated rows are equal sets; an empty table gives no rows; other columns are
ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .text import BitTable, Words, mix, quoted, shingle_sets, slices

#: Entries a hash range holds at most, about; entries a task gathers before it hands them on.
RANGE_ENTRIES, FLUSH_ENTRIES, FLUSH_COUNTS = 400_000, 500_000, 2_000_000
#: Texts beyond which a shingle is frequent, and very frequent. They only order lists; any choice gives the same result.
FREQUENT, VERY_FREQUENT = 32, 1024


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(own + np.uint64(0x51ED27)).sum() + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def _sets(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    words = Words(part.column(1))
    return list(shingle_sets(words, words.hashes(), shingle))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal keys, with the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _size_and_class(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = _sets(part, shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_class_of(x) if len(x) else 0 for x in sets], pa.int64())], ["doc_id", "n", "class"])

    return run


def _ranged(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The hash range of keys of so many bits."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _shortened(shingle: int, bits: int, ranges: int):
    """All shingles of a task's different sets, shortened to ``bits``, sorted and packed as differences by hash range."""

    def pack(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(sets) >> np.uint64(64 - bits))
        place = _ranged(keys, bits, ranges)
        borders = _runs(place)
        blobs = []
        for a, z in zip(borders[:-1], borders[1:], strict=True):
            steps = np.diff(keys[a:z])
            kind = "<u2" if steps.max(initial=0) < 2**16 else "<u4" if steps.max() < 2**32 else "<u8"
            blobs.append(keys[a : a + 1].tobytes() + kind[-1].encode() + steps.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(place[borders[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["range", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        entries = 0
        for batch in batches:
            for part in slices(batch):
                for own in _sets(part, shingle):
                    if len(own) and (name := _class_of(own)) not in held:
                        held[name] = own
                        entries += len(own)
                if entries >= FLUSH_COUNTS:
                    yield pack(list(held.values()))
                    held, entries = {}, 0
        if held:
            yield pack(list(held.values()))

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """Shortened shingles of a hash range that more than ``FREQUENT`` sets hold, with their level."""
    parts = []
    for x in table.column("keys").to_pylist():
        steps = np.frombuffer(x, f"<u{x[8:9].decode()}", offset=9).astype(np.uint64)
        parts.append(np.cumsum(np.append(np.frombuffer(x, "<u8", 1), steps), dtype=np.uint64))
    keys = np.sort(np.concatenate(parts))
    borders = _runs(keys)
    counts = np.diff(borders)
    often = np.flatnonzero(counts > FREQUENT)
    return pa.Table.from_arrays([pa.array(keys[borders[often]].astype(np.int64)), pa.array(np.where(counts[often] > VERY_FREQUENT, 2, 1).astype(np.int32))], ["key", "level"])


def _entries(shingle: int, percent: int, ranges: int, bits: int, tables):
    """Entries of the short lists, packed by hash range: twice the size of a set, and one more where it asks."""

    def pack(sets: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x, _ in sets.values()], np.int64)
        keys = np.concatenate([x for x, _ in sets.values()])
        names = np.repeat(np.fromiter(sets, np.int64, len(sets)), sizes)
        whole = np.repeat(np.array([n for _, n in sets.values()], np.int64), sizes)
        place_in = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        asks = place_in < whole + (-2 * percent * whole) // (100 + percent) + 1
        wholes = (2 * whole + asks).astype(np.int32)
        place = _ranged(keys, 64, ranges)
        order = np.argsort(place, kind="stable")
        borders = _runs(place[order])
        cut = lambda x: pa.array([x[order[a:z]].tobytes() for a, z in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(place[order][borders[:-1]].astype(np.int32)), cut(keys), cut(names), cut(wholes)], ["range", "keys", "classes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, very = tables.value
        held: dict[int, tuple[np.ndarray, int]] = {}
        entries = 0
        for batch in batches:
            for part in slices(batch):
                for own in _sets(part, shingle):
                    name = _class_of(own) if len(own) else 0
                    if not len(own) or name in held:
                        continue
                    short = len(own) - -(-percent * len(own) // 100) + 1
                    cut = own >> np.uint64(64 - bits)
                    order = np.argsort(frequent.holds(cut).astype(np.int8) + very.holds(cut), kind="stable")
                    held[name] = (own[order[:short]], len(own))
                    entries += short
                if entries >= FLUSH_ENTRIES:
                    yield pack(held)
                    held, entries = {}, 0
        if held:
            yield pack(held)

    return run


def _merge(percent: int, long_list: int):
    """Within a hash range: pairs of classes with their occurrences in short lists (kind 0), and members of long lists (kind 1: a the list, b the class, c whether it asks)."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        keys, names, sizes = join("keys", np.uint64), join("classes", np.int64), join("sizes", np.int32)
        order = np.lexsort((names, keys))
        keys, names, sizes = keys[order], names[order], sizes[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
        keys, names, sizes, asks = keys[once], names[once], sizes[once].astype(np.int64) // 2, sizes[once] % 2
        borders = _runs(keys)
        length = np.diff(borders)
        of = np.repeat(length, length)
        inside = np.flatnonzero((of > 1) & (of <= long_list))
        left = inside - np.repeat(borders[:-1], length)[inside]
        found = []
        for step in range(1, int(min(long_list, length.max(initial=0)))):
            i = inside[left + step < of[inside]]
            i = i[100 * np.minimum(sizes[i], sizes[i + step]) >= percent * np.maximum(sizes[i], sizes[i + step])]
            found.append(np.stack([names[i], names[i + step], sizes[i], sizes[i + step]], 1))
        pairs = np.concatenate([np.zeros((0, 4), np.int64), *found])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)) if len(pairs) else np.zeros(0, bool)
        counts = np.diff(np.append(np.flatnonzero(new), len(pairs)))
        pairs = pairs[new]
        long = np.flatnonzero(of > long_list)
        kinds = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(long)])
        cols = [np.append(pairs[:, 0], keys[long].view(np.int64)), np.append(pairs[:, 1], names[long]), np.append(pairs[:, 2], of[long]), np.append(pairs[:, 3], sizes[long]), np.append(counts, asks[long])]
        return pa.Table.from_arrays([pa.array(kinds), *(pa.array(c.astype(np.int64)) for c in cols)], ["kind", "a", "b", "na", "nb", "c"])

    return run


def _members(percent: int):
    """Pairs of a long list (or of two blocks of it) in different components that meet the bound by their common long lists.

    The smaller set asks and merges its lists over the members here.  It tells a
    partner only where the smallest list is looked at in which it asks for both.
    """

    def run(table: pa.Table) -> pa.Table:
        here = table.column("list")[0].as_py()
        names, sizes, roots, blocks = (table.column(c).to_numpy() for c in ("class", "n", "root", "block"))
        lists = table.column("lists").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        offsets = np.asarray(lists.offsets)
        held = np.asarray(lists.values)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        order = np.argsort(held, kind="stable")
        known, of = held[order], np.repeat(np.arange(len(names)), np.diff(offsets))[order]
        two = bool((blocks != blocks.min()).any())
        rest = -(-percent * sizes // 100) - 1
        found: list[np.ndarray] = []
        for i in np.flatnonzero(table.column("asks").to_numpy() > 0):
            good = (roots != roots[i]) & (sizes >= sizes[i]) & (100 * sizes[i] >= percent * sizes)
            if two:
                good &= blocks != blocks[i]
            if not good.any():
                continue
            own = np.sort(held[offsets[i] : offsets[i + 1]])
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            at = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange((high - low).sum())
            counts = np.bincount(of[at], minlength=len(names))
            asked = np.repeat(np.isin(own, table.column("asked")[i].values.to_numpy()), high - low)
            # Lists come in order, so the first of a partner is the smallest.
            partner, first = np.unique(of[at][asked], return_index=True)
            least = -(-percent * (sizes + sizes[i]) // (100 + percent)) - np.maximum(rest, rest[i])
            j = partner[(np.repeat(own, high - low)[asked][first] == here) & good[partner] & (counts[partner] >= np.maximum(least[partner], 1))]
            found.append(np.stack([np.minimum(names[j], names[i]), np.maximum(names[j], names[i])], 1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _fetch(shingle: int, wanted):
    """The sets whose class may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            for part in slices(batch):
                named = {_class_of(x): x for x in _sets(part, shingle) if len(x)}
                hit = table.holds(np.fromiter(named, np.int64, len(named)).view(np.uint64))
                sets = {k: x for (k, x), h in zip(named.items(), hit, strict=True) if h}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([x.tobytes() for x in sets.values()], pa.binary())], ["class", "keys"])

    return run


def _probe(percent: int):
    """Pairs that reach the similarity, by binary search of the smaller set's shingles in the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), key=len)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bound(percent: int, na: Column, nb: Column) -> Column:
    """Occurrences that a pair needs in short lists: the overlap, less the longer of the two parts left out."""
    rest = lambda n: F.ceil(n * percent / 100) - 1
    return F.ceil((na + nb) * percent / (100 + percent)) - F.greatest(rest(na), rest(nb))


def link(docs: DataFrame, shingle: int = 5, percent: int = 75, long_list: int = 64, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, for every row.

    Two texts link when 100 * intersection >= ``percent`` * union.
    """
    return _linked(docs, shingle, percent, long_list, block, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, shingle: int = 5, percent: int = 75, long_list: int = 64, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``link``, ``class``, which rows with equal sets share, and ``root``, which a component shares; root is null for empty sets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sized = scratch.save(frame.mapInArrow(_size_and_class(shingle), "doc_id long, n long, class long"), "sized")
    short = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    total = sized.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.coalesce(F.sum(short), F.lit(0)).alias("entries")).first()

    bits = min(64, max(33, int(total["shingles"]).bit_length() + 6))
    ranges = max(8, -(-int(total["shingles"]) // (4 * RANGE_ENTRIES)))
    shortened = frame.mapInArrow(_shortened(shingle, bits, ranges), "range int, keys binary")
    frequent = scratch.save(shortened.groupBy("range").applyInArrow(_frequent, "key long, level int"), "frequent")
    very = frequent.filter("level = 2")
    tables = spark.sparkContext.broadcast((BitTable(frequent, "key", frequent.count()), BitTable(very, "key", very.count())))

    ranges = max(8, -(-int(total["entries"]) // RANGE_ENTRIES))
    entries = frame.mapInArrow(_entries(shingle, percent, ranges, bits, tables), "range int, keys binary, classes binary, sizes binary")
    merged = entries.groupBy("range").applyInArrow(_merge(percent, long_list), "kind int, a long, b long, na long, nb long, c long")
    merged = scratch.save(merged, "merged")

    long = merged.filter("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("class"), F.col("nb").alias("n"), F.col("c").alias("asks"))
    lists_of = scratch.save(long.groupBy("class").agg(F.count(F.lit(1)).alias("lists")), "lists")
    pairs = merged.filter("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    for side in ("a", "b"):
        pairs = pairs.join(lists_of.select(F.col("class").alias(side), F.col("lists").alias(f"l{side}")), side, "left")
    reached = F.col("c") + F.least(*(F.coalesce(f"l{s}", F.lit(0)) for s in "ab")) >= _bound(percent, F.col("na"), F.col("nb"))
    pairs = scratch.save(pairs.filter(reached).select("a", "b", "na", "nb", "c"), "pairs")

    # First the most promising partner of each class, and the hub of each long list.
    sides = pairs.select("a", "b", "c").union(pairs.select("b", "a", "c"))
    best = sides.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    # In a list where no member asks, no pair is met that short lists do not hold.
    asked = scratch.save(long.filter("asks > 0").select("list").distinct(), "asked")
    members = long.join(asked, "list", "left_semi").join(lists_of, "class")
    hubs = members.groupBy("list").agg(F.max(F.struct("lists", "class", "n")).alias("hub")).select("list", F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n"))
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    spokes = members.join(hubs, "list").filter(alike & (F.col("hub") != F.col("class"))).select(F.col("hub").alias("a"), F.col("class").alias("b"))
    ordered = lambda x: x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    trial = scratch.save(ordered(best.union(spokes)), "trial")

    wanted = scratch.save(sides.select(F.col("a").alias("class")).union(members.select("class")).distinct(), "wanted")
    table = spark.sparkContext.broadcast(BitTable(wanted, "class", wanted.count()))
    sets = frame.mapInArrow(_fetch(shingle, table), "class long, keys binary")
    sets = scratch.save(sets.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("keys").alias("keys")), "sets")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        side = lambda s: sets.select(F.col("class").alias(s), F.col("keys").alias(f"keys_{s}"))
        met = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "keys_a", "keys_b")
        return scratch.save(met.mapInArrow(_probe(percent), "a long, b long"), name)

    links = verified(trial, "links")
    roots = scratch.save(components(links, scratch, "trial-components"), "trial-roots")
    named = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = pairs.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left").filter(apart).select("a", "b")
    rooted = members.join(roots, members["class"] == roots["node"], "left").select("list", "class", "n", "asks", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high")
    rooted = scratch.save(rooted.join(mixed.select("list", "size"), "list"), "rooted")
    # A class has at most as many long lists as its text is long.
    here = rooted.select("class").distinct()
    of_class = long.join(here, "class", "left_semi").groupBy("class").agg(F.collect_list("list").alias("lists"), F.collect_list(F.when(F.col("asks") > 0, F.col("list"))).alias("asked"))
    # Lists of more than a block are dealt out as pairs of blocks, each a group of its own.
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    dealt = rooted.join(of_class, "class").select("list", "class", "n", "asks", "root", "lists", "asked", own.alias("block"), F.explode(others).alias("part"))
    across = dealt.groupBy("list", "part").applyInArrow(_members(percent), "a long, b long")
    rest = ordered(rest.union(across)).join(trial, ["a", "b"], "left_anti")
    links = links.union(verified(rest, "more-links"))
    roots = components(links, scratch, "components")

    classes = sized.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(roots, F.col("class") == F.col("node"), "left")
    classes = scratch.save(classes.select("class", "least", F.coalesce("root", "class").alias("root")), "classes")
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(lowest, "root").select("class", "component_id", "root")
    empty = sized.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "class", F.lit(None).cast("long").alias("root"))
    return sized.filter("n > 0").join(ids, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class", "root").union(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, **options) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns; rows without an id stay.

    Where an id is on several rows, only those with equal sets or in one component fall together;
    of rows with equal sets that with the least text, then the least hash of all columns, stays.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-kept")
    # Columns travel inside a struct, so none can clash with the names used here.
    own = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.struct(*map(quoted, docs.columns)).alias("row"))
    linked = _linked(own, shingle, **options).filter("doc_id IS NOT NULL")
    linked = scratch.save(linked.select("doc_id", "component_id", "class", "root"), "linked")
    kept = linked.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("class").alias("class"))
    kept = scratch.save(kept.select("doc_id", "class").distinct(), "kept")
    shared = scratch.save(linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "shared")
    # Only rows that may go, or share an id, are shuffled: a bit table of their ids tells the others apart.
    asked = scratch.save(linked.filter("doc_id <> component_id").select("doc_id").union(shared).distinct(), "asked-ids")
    table = docs.sparkSession.sparkContext.broadcast(BitTable(asked, "doc_id", asked.count()))
    may = F.arrow_udf(lambda ids: pa.array(table.value.holds(np.asarray(ids.fill_null(0)).view(np.uint64))), "boolean")
    own = own.withColumn("may", F.col("doc_id").isNotNull() & may("doc_id"))
    stay = own.filter("may").join(kept, "doc_id", "left_semi")
    if shared.isEmpty():
        unique = stay.select("row")
    else:
        # Only these rows need their class beside their columns.
        rows = scratch.save(stay.join(shared, "doc_id", "left_semi").withColumn("nr", F.monotonically_increasing_id()), "rows")
        classes = rows.select("nr", "text").mapInArrow(_size_and_class(shingle), "nr long, n long, class long").drop("n")
        first = F.min_by("row", F.struct(F.coalesce("text", F.lit("")), F.sha2(F.to_json("row"), 256)))
        texts = rows.join(classes, "nr").groupBy("doc_id", "class").agg(first.alias("row")).join(kept, ["doc_id", "class"], "left_semi")
        unique = stay.join(shared, "doc_id", "left_anti").select("row").union(texts.select("row"))
    return unique.union(own.filter("NOT may").select("row")).select("row.*")
