"""Phrases whose words stand together more often than their parts let expect.

Counts of n-grams are held in weighted acyclic automata.  A path of an automaton
is a language and then words; each arc carries the number of times the path up
to it was seen (0 where it only leads on), and the arc of a language alone the
number of all its words.  A task builds a trie from each shard of its text, level by
level from sorted n-grams, unites its shards, cuts the result into ranges of
prefixes and hands each on as a minimal automaton: from the ends to the root,
states with the same arcs are one.  A range unites what all tasks sent, sums
the weights and keeps paths seen ``least`` times.  The parts of a candidate are
looked up by composition: a range asks for each different part once, as an
automaton, which is composed with the automaton of the range that holds it.

A range is an interval of positions of hashed two-word prefixes; longer n-grams are
dealt from there over a 64th of all ranges, so no prefix, however frequent, owns
a range's worth of continuations alone, and an n-gram costs one path a task.

A phrase is no more frequent than its words and pairs of words, so only those
n-grams are built whose words and pairs reach ``least``.  This is told by a bit
table of bounded size, made of counts of shortened hashes.  It may let rarer
ones pass, which the sums then drop, but holds none back.

Of candidates inside a longer one only those of one word less have to be looked
at: if a longer one is as frequent, so is each phrase in between.

Nulls and edge cases: a null text is empty; a null language is ``und``; words end
at spaces and tabs, phrases also at full stops, commas and the like; words may
hold any other character; repeated rows and ids count each time; ties are broken
down to the phrase, so ranks are fixed; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .text import BitTable, Words, mix, slices

LEAST, TOP, LONGEST, ABSORB_PERCENT = 100, 2000, 5, 100
#: Words of a shard; n-grams a task unites before it hands them on; keys a task counts at once; keys and n-grams of a range.
SHARD_WORDS, FLUSH_GRAMS, FLUSH_KEYS, RANGE_KEYS, RANGE_GRAMS = 2_000_000, 1_500_000, 2_000_000, 1_600_000, 4_000_000
#: Longer n-grams of a prefix are dealt over this share of all ranges.
SPREAD = 64
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_STOPS
_INSIDE[[ord(" "), ord("\t")]] = False
_STEP = np.uint64(0x9FB21C651E98DF25)
_AUTOMATON = "words array<string>, first array<int>, label array<int>, target array<int>, weight array<long>"
_FIELDS = ["words", "first", "label", "target", "weight"]

#: A trie: for each level the parent (place in the level before), the label (place among the words) and the weight, sorted by parent and label.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words as they are found in texts."""
    return Words(pa.array(words, pa.string()), _INSIDE).hashes()


def split_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of a text column, and whether the next word goes on in the same piece."""
    words = Words(column, _INSIDE)
    stops = np.append(0, np.cumsum(_STOPS[words.bytes]))
    on = np.zeros(len(words), bool)
    on[:-1] = stops[words.starts[1:]] == stops[words.ends[:-1]]
    on[words.rows[1:][words.rows[1:] > 0] - 1] = False
    return words, on


def _keys(hashes: np.ndarray, langs: np.ndarray, on: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortened names of all words, and of the pairs that each word begins (those without a next word have no meaning)."""
    cut = np.uint64(64 - bits)
    one = mix(langs + hashes * _STEP)
    two = mix(one + np.append(hashes[1:], np.uint64(0))[: len(one)] * _STEP)
    return one >> cut, two >> cut


def _langs(part: pa.RecordBatch) -> pa.DictionaryArray:
    return part.column(part.schema.names.index("lang")).dictionary_encode()


def _count_keys(bits: int, ranges: int, least: int):
    """Counts of shortened words and pairs, up to ``least``, sorted and packed as differences by hash range."""

    def pack(keys: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.minimum(np.diff(np.append(at, len(keys))), least).astype("<u1" if least < 256 else "<u4")
        keys = keys[at]
        place = ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)
        borders = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(keys))
        blobs = []
        for a, z in zip(borders[:-1], borders[1:], strict=True):
            steps = np.diff(keys[a:z])
            kind = "<u2" if steps.max(initial=0) < 2**16 else "<u4" if steps.max() < 2**32 else "<u8"
            blobs.append(keys[a : a + 1].tobytes() + kind[-1].encode() + steps.astype(kind).tobytes())
        sums = [counts[a:z].tobytes() for a, z in zip(borders[:-1], borders[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(place[borders[:-1]].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(sums, pa.binary())], ["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch):
                words, on = split_words(part.column(part.schema.names.index("text")))
                if not len(words):
                    continue
                langs = _langs(part)
                of = _lang_hashes(langs.dictionary.to_pylist())[np.asarray(langs.indices)]
                one, two = _keys(words.hashes(), np.repeat(of, np.diff(words.rows)), on, bits)
                held += [one, two[on]]
                if sum(map(len, held)) > FLUSH_KEYS:
                    yield pack(np.concatenate(held))
                    held = []
        if held:
            yield pack(np.concatenate(held))

    return run


def _frequent(least: int):
    """Keys of a hash range that occur ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        keys = []
        for x in table.column("keys").to_pylist():
            steps = np.frombuffer(x, f"<u{x[8:9].decode()}", offset=9).astype(np.uint64)
            keys.append(np.cumsum(np.append(np.frombuffer(x, "<u8", 1), steps), dtype=np.uint64))
        every = np.concatenate(keys)
        counts = np.concatenate([np.frombuffer(x, "<u1" if least < 256 else "<u4") for x in table.column("counts").to_pylist()])
        order = np.argsort(every)
        every = every[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        sums = np.add.reduceat(counts[order].astype(np.int64), at)
        return pa.Table.from_arrays([pa.array(every[at][sums >= least].astype(np.int64))], ["key"])

    return run


def _grown(parents: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[Level, np.ndarray]:
    """A level of a trie from arcs in any order, equal ones summed (each counts once without weights), and the place of each."""
    keys, back, counts = np.unique(parents.astype(np.uint64) << np.uint64(32) | labels.astype(np.uint64), return_inverse=True, return_counts=True)
    if weights is not None:
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, back, weights)
    return ((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts.astype(np.int64)), back


def shard_trie(langs: np.ndarray, words: np.ndarray, frequent: np.ndarray, pairs: np.ndarray, longest: int) -> list[Level]:
    """The trie of a shard: a language per word; words that are frequent and pairs that go on from a word to a frequent pair."""
    level, node = _grown(np.zeros(len(langs)), langs)
    out, at = [level], np.flatnonzero(frequent)
    node = node[at]
    for k in range(longest):
        if k:
            on = pairs[at + k - 1]
            at, node = at[on], node[on]
        level, node = _grown(node, words[at + k])
        out.append(level)
    return out


def united(tries: list[tuple[list[str], list[Level]]]) -> tuple[list[str], list[Level]]:
    """The trie of all paths of some tries, weights summed; its words are sorted."""
    words = sorted({w for own, _ in tries for w in own}, key=str.encode)
    place = {w: i for i, w in enumerate(words)}
    names = [np.array([place[w] for w in own], np.int64) for own, _ in tries]
    maps = [np.zeros(1, np.int64)] * len(tries)
    out = []
    for k in range(max(len(levels) for _, levels in tries)):
        have = [i for i, (_, levels) in enumerate(tries) if k < len(levels)]
        arcs = [tries[i][1][k] for i in have]
        level, back = _grown(
            np.concatenate([maps[i][p] for i, (p, _, _) in zip(have, arcs, strict=True)]),
            np.concatenate([names[i][x] for i, (_, x, _) in zip(have, arcs, strict=True)]),
            np.concatenate([w for _, _, w in arcs]),
        )
        out.append(level)
        ends = np.cumsum([0, *(len(p) for p, _, _ in arcs)])
        for i, a, z in zip(have, ends[:-1], ends[1:], strict=True):
            maps[i] = back[a:z]
    return words, out


def minimal(levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The minimal automaton of a trie: each state's first arc, and the arcs' labels, targets and weights; the last state is the root.

    State 0 has no arcs.  A register tells which states are there already.
    """
    register: dict[bytes, int] = {}
    arcs: list[np.ndarray] = []
    target = np.zeros(len(levels[-1][0]), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        parents, labels, weights = levels[k]
        rows = np.ascontiguousarray(np.stack([labels, target, weights], 1))
        above = len(levels[k - 1][0]) if k else 1
        target = np.zeros(above, np.int64)
        borders = np.append(np.flatnonzero(np.append(True, parents[1:] != parents[:-1])[: len(parents)]), len(parents))
        for a, z, parent in zip(borders[:-1], borders[1:], parents[borders[:-1]], strict=True):
            name = rows[a:z].tobytes()
            # The root is a state of its own.
            if k == 0 or (state := register.get(name)) is None:
                state = register[name] = len(arcs) + 1
                arcs.append(rows[a:z])
            target[parent] = state
    first = np.cumsum([0, 0, *(len(x) for x in arcs)])
    every = np.concatenate(arcs) if arcs else np.zeros((0, 3), np.int64)
    return first, every[:, 0], every[:, 1], every[:, 2]


def unfolded(first: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[Level]:
    """The trie of an automaton, in order of its paths."""
    out, states = [], np.array([len(first) - 2])
    while True:
        counts = first[states + 1] - first[states]
        if not counts.any():
            return out
        parents = np.repeat(np.arange(len(states)), counts)
        arcs = np.arange(len(parents)) - np.repeat(np.cumsum(counts) - counts, counts) + first[states][parents]
        out.append((parents, label[arcs].astype(np.int64), weight[arcs].astype(np.int64)))
        states = target[arcs]


def composed(asked: list[Level], asked_words: list[str], words: list[str], first: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The weight that an automaton gives each path of a trie, 0 where it has none."""
    place = {w: i for i, w in enumerate(words)}
    names = np.array([place.get(w, -1) for w in asked_words], np.int64)
    n = len(words) + 1
    keys = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.int64) * n + label
    out, states = [], np.array([len(first) - 2])
    for parents, labels, _ in asked:
        before, own = states[parents], names[labels]
        wanted = before * n + own
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = (before > 0) & (own >= 0) & (keys[at] == wanted if len(keys) else False)
        out.append(np.where(found, weight[at] if len(keys) else 0, 0))
        states = np.where(found, target[at] if len(keys) else 0, 0)
    return out


def _ranges(levels: list[Level], langs: np.ndarray, words: np.ndarray, ranges: int) -> list[np.ndarray]:
    """The range of each path of a trie, from hashes of the labels as languages and as words."""
    out, base, rest = [], np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    half, spread = np.uint64(32), np.uint64(max(1, ranges // SPREAD))
    for k, (parents, labels, _) in enumerate(levels):
        if k == 0:
            base = mix(langs[labels])
        else:
            base = base[parents] if k > 2 else mix(base[parents] + words[labels] * _STEP)
            rest = mix(rest[parents] + words[labels] * _STEP) if k > 2 else np.zeros(len(parents), np.uint64)
        place = (base >> half) * np.uint64(ranges) >> half
        if k > 2:
            place = (place + ((rest >> half) * spread >> half)) % np.uint64(ranges)
        out.append(place.astype(np.int64))
        rest = np.zeros(len(parents), np.uint64) if k == 0 else rest
    return out


def _cut(words: list[str], levels: list[Level], of: list[np.ndarray]) -> Iterator[tuple[int, list[str], tuple[np.ndarray, ...]]]:
    """The minimal automaton of each range, with the words that it needs."""
    # Paths of a range, and as ways to these the paths before them, as (range, place) from the longest to the shortest.
    width = np.int64(max(len(p) for p, _, _ in levels) + 1)
    pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * len(levels)
    led = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        parents, _, weights = levels[k]
        own = np.flatnonzero(weights > 0)
        pairs[k] = np.unique(np.append(of[k][own] * width + own, led))
        led = pairs[k] // width * width + parents[pairs[k] % width]
    for r in np.unique(pairs[0] // width):
        slices_, before = [], np.zeros(1, np.int64)
        for k, (parents, labels, weights) in enumerate(levels):
            a, z = np.searchsorted(pairs[k], (r * width, (r + 1) * width))
            if a == z:
                break
            at = pairs[k][a:z] % width
            slices_.append((np.searchsorted(before, parents[at]), labels[at], np.where(of[k][at] == r, weights[at], 0)))
            before = at
        used = np.unique(np.concatenate([x for _, x, _ in slices_]))
        small = [(p, np.searchsorted(used, x), w) for p, x, w in slices_]
        yield int(r), [words[i] for i in used], minimal(small)


def _row_batch(rows: list[tuple[int, int, list[str], tuple[np.ndarray, ...]]], keys: tuple[str, ...]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(keys))]
    columns.append(pa.array([r[2] for r in rows], pa.list_(pa.string())))
    for j, kind in enumerate((np.int32, np.int32, np.int32, np.int64)):
        values = [r[3][j] for r in rows]
        offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind))))
    return pa.RecordBatch.from_arrays(columns, [*keys, *_FIELDS])


def _automata(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in zip(*(table.column(c) for c in _FIELDS), strict=True):
        yield row[0].as_py(), *(x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in row[1:])


def _shards(bits: int, table, ranges: int, longest: int):
    """Automata of a task's n-grams, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        tries: list[tuple[list[str], list[Level]]] = []
        names: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []

        def shard() -> None:
            """What was gathered becomes a trie."""
            langs, words, frequent, pairs = (np.concatenate(x) for x in zip(*parts, strict=True))
            tries.append((list(names), shard_trie(langs, words, frequent, pairs, longest)))
            parts.clear()
            names.clear()

        def handed_on() -> Iterator[pa.RecordBatch]:
            words, levels = united(tries)
            tries.clear()
            of = _ranges(levels, _lang_hashes(words), _any_hashes(words), ranges)
            rows: list[tuple[int, int, list[str], tuple[np.ndarray, ...]]] = []
            for r, own, automaton in _cut(words, levels, of):
                rows.append((r, 0, own, automaton))
                if len(rows) == 64:
                    yield _row_batch(rows, ("range",))
                    rows = []
            if rows:
                yield _row_batch(rows, ("range",))

        for batch in batches:
            for part in slices(batch):
                words, on = split_words(part.column(part.schema.names.index("text")))
                if not len(words):
                    continue
                own = _langs(part)
                spelled = own.dictionary.to_pylist()
                codes = np.repeat(np.asarray(own.indices), np.diff(words.rows))
                hashes = words.hashes()
                one, two = _keys(hashes, _lang_hashes(spelled)[codes], on, bits)
                frequent = known.holds(one)
                both = np.flatnonzero(frequent & on & np.append(frequent[1:], False))
                pairs = np.zeros(len(words), bool)
                pairs[both] = known.holds(two[both])
                place = np.flatnonzero(frequent)
                _, index, back = np.unique(hashes[place], return_index=True, return_inverse=True)
                raw = words.bytes.tobytes()
                found = [raw[words.starts[i] : words.ends[i]].lower().decode() for i in place[index]]
                ids = np.zeros(len(words), np.int64)
                ids[place] = np.array([names.setdefault(x, len(names)) for x in found], np.int64)[back]
                parts.append((np.array([names.setdefault(x, len(names)) for x in spelled], np.int64)[codes], ids, frequent, pairs))
                if sum(len(x[0]) for x in parts) >= SHARD_WORDS:
                    shard()
                    if sum(len(x[0]) for _, levels in tries for x in levels) >= FLUSH_GRAMS:
                        yield from handed_on()
        if parts:
            shard()
        if tries:
            yield from handed_on()

    return run


def _any_hashes(labels: list[str]) -> np.ndarray:
    """Hashes of labels as words; those that are no word (names of languages) get 0."""
    found = Words(pa.array(labels, pa.string()), _INSIDE)
    hashes, out = found.hashes(), np.zeros(len(labels), np.uint64)
    alone = np.flatnonzero(np.diff(found.rows) == 1)
    out[alone] = hashes[found.rows[:-1][alone]]
    return out


def _summed(least: int):
    """What all tasks sent to a range as one automaton of the paths seen ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        words, levels = united([(own, unfolded(*rest)) for own, *rest in _automata(table)])
        levels = [(p, x, np.where(w >= least, w, 0)) for p, x, w in levels]
        r = table.column("range")[0].as_py()
        rows = [(r, 0, own, automaton) for _, own, automaton in _cut(words, levels, [np.full(len(p), r) for p, _, _ in levels])]
        return pa.Table.from_batches([_row_batch(rows, ("range",))])

    return run


def _paths(levels: list[Level]) -> list[np.ndarray]:
    """The labels of each path, without the language."""
    out = [np.zeros((len(levels[0][0]), 0), np.int64)]
    for parents, labels, _ in levels[1:]:
        out.append(np.column_stack([out[-1][parents], labels]))
    return out


def _langs_of(levels: list[Level]) -> list[np.ndarray]:
    out = [levels[0][1]]
    for parents, _, _ in levels[1:]:
        out.append(out[-1][parents])
    return out


def _parts(levels: list[Level]) -> tuple[list[Level], list[tuple[int, list[np.ndarray], list[np.ndarray]]]]:
    """A trie of the languages and all parts of candidates, and for each length the candidates' parts in it.

    For candidates of k words: the places of the first j words and of the others, for j from 1 to k - 1.
    """
    paths, langs = _paths(levels), _langs_of(levels)
    wanted: dict[int, list[np.ndarray]] = {0: [langs[0][:, None]]}
    cuts = []
    for k in range(2, len(levels)):
        at = np.flatnonzero(levels[k][2] > 0)
        rows, own = paths[k][at], langs[k][at, None]
        for j in range(1, k):
            wanted.setdefault(j, []).append(np.column_stack([own, rows[:, :j]]))
            wanted.setdefault(k - j, []).append(np.column_stack([own, rows[:, j:]]))
        cuts.append((k, at, own, rows))
    longest = max(wanted)
    whole = {m: np.concatenate(x) for m, x in wanted.items()}
    trie: list[Level] = []
    node = {m: np.zeros(len(x), np.int64) for m, x in whole.items()}
    for depth in range(longest + 1):
        have = [m for m in whole if m >= depth]
        labels = np.concatenate([whole[m][:, depth] for m in have])
        asked = np.concatenate([np.full(len(whole[m]), int(m == depth)) for m in have])
        level, back = _grown(np.concatenate([node[m] for m in have]), labels, asked)
        trie.append(level)
        ends = np.cumsum([0, *(len(whole[m]) for m in have)])
        for m, a, z in zip(have, ends[:-1], ends[1:], strict=True):
            node[m] = back[a:z]
    used = dict.fromkeys(whole, 0)
    used[0] = len(wanted[0][0])
    found = []
    for k, at, _, _ in cuts:
        heads, tails = [], []
        for j in range(1, k):
            for m, side in ((j, heads), (k - j, tails)):
                side.append(node[m][used[m] : used[m] + len(at)])
                used[m] += len(at)
        found.append((k, heads, tails))
    return trie, found


def _asks(ranges: int):
    """For each range the parts that its candidates have elsewhere, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asker, (words, *automaton) in zip(batch.column("range").to_pylist(), _automata(batch), strict=True):
                levels = unfolded(*automaton)
                if len(levels) < 3 or not any((w > 0).any() for _, _, w in levels[2:]):
                    continue
                trie, _ = _parts(levels)
                of = _ranges(trie, _lang_hashes(words), _any_hashes(words), ranges)
                rows = [(r, asker, own, found) for r, own, found in _cut(words, trie, of)]
                for i in range(0, len(rows), 256):
                    yield _row_batch(rows[i : i + 256], ("range", "asker"))

    return run


def _answers(table: pa.Table) -> pa.Table:
    """What a range knows about the parts it is asked for."""
    askers = table.column("asker").to_pylist()
    every = list(_automata(table))
    known = next((x for a, x in zip(askers, every, strict=True) if a < 0), None)
    rows = []
    for asker, (words, *automaton) in zip(askers, every, strict=True):
        if asker >= 0 and known is not None:
            levels = unfolded(*automaton)
            weights = composed(levels, words, *known)
            found = [(p, x, np.where(asked > 0, w, 0)) for (p, x, asked), w in zip(levels, weights, strict=True)]
            rows.append((asker, 0, words, minimal(found)))
    return pa.Table.from_batches([_row_batch(rows, ("asker",))])


def _scored(absorb: int):
    """Candidates of a range with their lowest-scoring cut (kind 0), and phrases that a longer candidate stands for (kind 1)."""
    names = ["kind", "lang", "phrase", "a", "l", "r", "n", "score"]

    def run(table: pa.Table) -> pa.Table:
        told = table.column("told").to_pylist()
        every = list(_automata(table))
        words, *automaton = next(x for t, x in zip(told, every, strict=True) if not t)
        levels = unfolded(*automaton)
        trie, cuts = _parts(levels)
        known_words, known = united([(own, unfolded(*rest)) for t, (own, *rest) in zip(told, every, strict=True) if t])
        weights = composed(trie, words, known_words, *minimal(known))
        paths, langs = _paths(levels), _langs_of(levels)
        out: list[tuple] = []
        spelled = np.array(words, object)
        totals = dict(zip(trie[0][1].tolist(), weights[0].tolist(), strict=True))
        for k, heads, tails in cuts:
            at = np.flatnonzero(levels[k][2] > 0)
            if not len(at):
                continue
            # Whole numbers without a bound.
            a = levels[k][2][at].astype(object)
            n = np.array([totals[x] for x in langs[k][at].tolist()], object)
            best = l_best = r_best = None
            for j, (head, tail) in enumerate(zip(heads, tails, strict=True), 1):
                left, right = weights[j][head].astype(object), weights[k - j][tail].astype(object)
                score = 1000 * a * n // (left * right)
                less = np.ones(len(at), bool) if best is None else (score < best).astype(bool)
                best, l_best, r_best = (now if old is None else np.where(less, now, old) for now, old in ((score, best), (left, l_best), (right, r_best)))
            rows = spelled[paths[k][at]]
            phrases = [" ".join(x) for x in rows]
            own = spelled[langs[k][at]].tolist()
            out += zip([0] * len(at), own, phrases, a, l_best, r_best, n, best, strict=True)
            if k > 2:
                for x, counts in ((rows[:, :-1], weights[k - 1][heads[-1]]), (rows[:, 1:], weights[k - 1][tails[0]])):
                    for i in np.flatnonzero(100 * levels[k][2][at] >= absorb * counts):
                        out.append((1, own[i], " ".join(x[i]), 0, 0, 0, 0, 0))
        kinds = (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return run


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, absorb: int = ABSORB_PERCENT, ranges: int | None = None) -> DataFrame:
    """The ``top`` phrases of each language of docs (text, lang): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    A phrase of 2 to ``longest`` words seen ``a >= least`` times is left out if a longer candidate
    with 100 * its count >= ``absorb`` * a holds it; ``ranges`` are derived from the bytes of text unless given.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A word takes two bytes at least, about six as a rule.
    bits = min(62, max(34, int(size).bit_length() + 3))
    key_ranges = max(8, -(-int(size) // (3 * RANGE_KEYS)))
    ranges = ranges or max(8, -(-int(size) // (8 * RANGE_GRAMS)))
    counted = own.mapInArrow(_count_keys(bits, key_ranges, least), "range int, keys binary, counts binary")
    frequent = scratch.save(counted.groupBy("range").applyInArrow(_frequent(least), "key long"), "frequent")
    table = spark.sparkContext.broadcast(BitTable(frequent, "key", frequent.count(), most_bits=29))

    sent = own.mapInArrow(_shards(bits, table, ranges, longest), f"range int, {_AUTOMATON}")
    counts = scratch.save(sent.groupBy("range").applyInArrow(_summed(least), f"range int, {_AUTOMATON}"), "counts")
    asks = counts.mapInArrow(_asks(ranges), f"range int, asker int, {_AUTOMATON}")
    asks = scratch.save(asks, "asks")
    met = counts.select("range", F.lit(-1).alias("asker"), *_FIELDS).unionByName(asks)
    answers = met.groupBy("range").applyInArrow(_answers, f"asker int, {_AUTOMATON}")
    askers = asks.select(F.col("asker").alias("range")).distinct()
    mine = counts.join(askers, "range", "left_semi").select("range", F.lit(False).alias("told"), *_FIELDS)
    told = answers.select(F.col("asker").alias("range"), F.lit(True).alias("told"), *_FIELDS)
    scored = mine.unionByName(told).groupBy("range").applyInArrow(_scored(absorb), "kind int, lang string, phrase string, a long, l long, r long, n long, score long")
    scored = scratch.save(scored, "scored")
    inside = scored.filter("kind = 1").select("lang", "phrase").distinct()
    left = scored.filter("kind = 0").join(inside, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranks = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranks.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
