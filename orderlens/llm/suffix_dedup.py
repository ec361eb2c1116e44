"""Exact removal of long repeated byte strings by a logarithmic family of suffix arrays.

Only some suffixes are kept: of each run of ``length`` bytes the one whose first ``GRAM`` bytes hash least,
leftmost on ties. Equal runs keep the suffix at the same place, so nothing is missed. Successive
runs with one kept suffix form a stretch; a stretch is known by the key of its suffix and a hash of all its bytes.

Documents come in batches. The suffix array of a batch is its kept suffixes by their first ``GRAM`` bytes, in the
order of these bytes, divided into ranges whose borders all arrays of a family share. A new array is merged with every
existing level, range by range; neighbours in the merged order whose longest common prefix reaches ``GRAM``
are matches, within the batch and across. Then the array joins the family, where two levels of one size
merge into the next. Suffixes matched anywhere are all that long matches can have.

An exact check follows. Equal stretches are repeats as a whole. Where stretches of one key differ,
one of each kind asks how often each of its runs occurs (``blocks.py``); every run found twice is a repeat.
So copies are never compared as pairs, and a string that starts in a third of all documents is a sum.

Passages of many words that stand in several documents can be told too, however few bytes they have. Of each run of so many
words the first ``WORD_GRAM`` words that hash least are kept; blocks ask in how many documents each of these stands,
and runs around one that stands in several ask the same in the exact check.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.blocks import BLOCK, distinct_keys, from_planes, planes, questions, shard_cuts, shard_groups, totals
from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, sliced_rows, utf8
from orderlens.llm.sieve import Sieve, sieve_of
from orderlens.session import Scratch

LENGTH, GRAM, BATCHES = 400, 32, 4
#: Runs that are looked at together: a longer text is taken piece by piece.
PIECE = 1 << 20
#: Suffixes of a range of an array; suffixes that a task holds before it sends them; bytes of texts on which borders are chosen.
RANGE, HELD, SAMPLED = 1 << 18, 1 << 21, 16 << 20
#: A passage has more words; words that are looked up together to find one.
PASSAGE, WORD_GRAM = 50, 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_SPACE, _SPACES = re.compile(rb"[\x09-\x0D\x20]"), np.isin(np.arange(256), [*range(9, 14), 32])
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_SHIFT, _PLACE = np.uint64(24), np.uint64((1 << 24) - 1)
# Powers of an odd number and of its inverse modulo 2^64, and a value for each byte, for run fingerprints.
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

STRETCHES = "kind int, doc long, th long, key long, stretch long, first long, runs int, repeated boolean"
PARTS = "range int, prefixes binary, counts binary"
ARRAYS = "kind int, range int, prefixes binary, counts binary"
PLACED = "kind int, block long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, " \
         "n_passages long, passage_words long, payload binary"
RESULT = "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, " \
         "n_passages long, passage_words long"
SAMPLED_WORDS = "kind int, shard int, block long, keys binary, counts binary, payload binary"
ASKED, TOLD, WORDED = "shard int, block long, keys binary, counts binary", "block long, shard int, twice binary", "doc long, th long, worded binary"


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every place."""
    words = np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))
    n = len(text) - GRAM + 1
    return _mixed([words[k:k + n] for k in range(0, GRAM, 8)])


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    h = words[0] * _MIX[0]
    for word, mix in zip(words[1:], _MIX[1:]):
        h = (h ^ (h >> np.uint64(29))) * mix + word
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def _kept(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every ``width`` hashes in a row the place of the least, leftmost on ties: (first run, number of runs, place) of
    successive runs with one place."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, n = 1, len(hashes) - width + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    place = (np.minimum(least[:n], least[width - span:width - span + n]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.diff(first, append=n), place[first]


def stretches(text: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(first run, number of runs, place of the kept suffix, key) of every stretch of a text."""
    found = []
    for at in range(0, len(text) - length + 1, PIECE):
        part = text[at:at + PIECE + length - 1]
        hashes = _gram_hashes(part)
        first, runs, kept = _kept(hashes, length - GRAM + 1)
        found += zip((first + at).tolist(), runs.tolist(), (kept + at).tolist(), hashes[kept].view(np.int64).tolist())
    return found


_powers_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers_held or len(_powers_held[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers_held[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                           for b in (_BASE, inverse)]
    return _powers_held[0], _powers_held[1]


def run_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of every run of ``length`` bytes."""
    return _rolled(_BYTE[text], length)


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    up, down = _powers(len(values) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * down[:len(values)], dtype=np.uint64)])
    h = (sums[length:] - sums[:-length]) * up[:len(values) - length + 1]
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def _word_hashes(piece: bytes) -> np.ndarray:
    text = np.frombuffer(piece, np.uint8)
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACES[text]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * down[:len(text)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * up[starts]
    h = (h ^ (h >> np.uint64(32))) * _MIX[2]
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(piece[starts[i]:ends[i]])
    return h


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word between white space. Long texts are taken piece by piece; a word that
    is longer than a piece ends one and goes alone."""
    found, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        border = _SPACE.search(data, at + PIECE)
        end = last = border.start() if border else len(data)
        if end - at > 2 * max(PIECE, LONG_WORD):
            last = max(at, *(data.rfind(bytes([c]), at, at + PIECE) + 1 for c in np.flatnonzero(_SPACES).tolist()))
        found.append(_word_hashes(data[at:last]))
        if last < end:
            found.append(np.array([xxhash.xxh3_64_intdigest(data[last:end])], np.uint64))
        at = end
    return np.concatenate(found)


def word_stretches(words: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run, number of runs, key) of every stretch of runs of ``run`` words."""
    gram, found = min(WORD_GRAM, run // 2 + 1), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for at in range(0, len(words) - run + 1, PIECE):
        hashes = _rolled(words[at:at + PIECE + run - 1], gram)
        first, runs, kept = _kept(hashes, run - gram + 1)
        found.append((first + at, runs, hashes[kept]))
    first, runs, keys = (np.concatenate(x) for x in zip(*found))
    return first, runs, keys


def _stretches_of_each(words: list[np.ndarray], run: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``word_stretches`` of each of several texts, found together; only runs within one text stay."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    first, runs, keys = word_stretches(np.concatenate(words), run)
    text = np.searchsorted(end, first, side="right")
    # Successive runs of one stretch that lie within a text lie within one: that of the first or the next.
    found = []
    for own in (text, np.minimum(np.searchsorted(end, first + runs - 1, side="right"), len(end) - 1)):
        s, e = np.maximum(first, (end - size)[own]), np.minimum(first + runs, end[own] - run + 1)
        found.append((own, s, e, e > s))
    (own, s, e, good), (other, s2, e2, good2) = found
    good2 &= other != own
    own, s, e, keys = (np.concatenate([a[good], b[good2]]) for a, b in ((own, other), (s, s2), (e, e2), (keys, keys)))
    order = np.lexsort((s, own))
    own, s, e, keys = own[order], s[order], e[order], keys[order]
    cuts = np.searchsorted(own, np.arange(len(words) + 1)).tolist()
    return [(s[x:y] - at, e[x:y] - s[x:y], keys[x:y]) for x, y, at in zip(cuts, cuts[1:], (end - size).tolist())]


def _word_runs(words: np.ndarray, run: int, stretches_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) of the runs of ``run`` words that the (first run, number of runs) hold."""
    first, runs = stretches_of
    new = np.flatnonzero(np.append(True, first[1:] != first[:-1] + runs[:-1]))
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for s, n in zip(first[new].tolist(), np.add.reduceat(runs, new).tolist()):
        for at in range(s, s + n, PIECE):
            some = min(PIECE, s + n - at)
            places.append(np.arange(at, at + some))
            found.append(_rolled(words[at:at + some + run - 1], run))
    return np.concatenate(places), np.concatenate(found)


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under any of the spans."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), reach[np.append(at[1:], len(reach)) - 1].tolist()))


def _prefixes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first ``GRAM`` bytes of suffixes."""
    return np.lib.stride_tricks.sliding_window_view(text, GRAM)[places].view(f"S{GRAM}").ravel()


def _bytes_of(prefixes: np.ndarray) -> np.ndarray:
    return prefixes.view(np.uint8).reshape(-1, GRAM)


def _packed(prefixes: np.ndarray) -> bytes:
    """All first bytes together, then all second ones, and so on."""
    return _bytes_of(prefixes).T.tobytes()


def _unpacked_prefixes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(GRAM, -1).T).view(f"S{GRAM}").ravel()


def _keys(prefixes: np.ndarray) -> np.ndarray:
    """The hash of each prefix by which its stretches know it."""
    words = _bytes_of(prefixes).view("<u8").reshape(-1, GRAM // 8)
    return _mixed([words[:, k] for k in range(GRAM // 8)])


def common_prefixes(ordered: np.ndarray) -> np.ndarray:
    """Bytes that each suffix but the first has in common with the one before, ``GRAM`` at most."""
    differ = _bytes_of(ordered)[1:] != _bytes_of(ordered)[:-1]
    return np.where(differ.any(1), differ.argmax(1), GRAM)


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """Kind 0: one row per stretch kind of a document. Kind 1: spans that repeat within a document."""
    def work(batches):
        def rows(b):
            for doc, th, data in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("text")):
                data = data.as_py()
                if len(data) < length:
                    continue
                text, seen, again = np.frombuffer(data, np.uint8), {}, []
                for first, runs, _, key in stretches(text, length):
                    name = xxhash.xxh3_64_intdigest(data[first:first + runs + length - 1])
                    known = seen.get((key, name))
                    if known is None:
                        seen[key, name] = [first, runs, False]
                    else:
                        again += [(first, runs), (known[0], known[1])] if not known[2] else [(first, runs)]
                        known[2] = True
                for (key, name), (first, runs, repeated) in seen.items():
                    yield 0, doc, th, key, name - (1 << 63), first, runs, repeated
                if again:
                    starts, runs = (np.array(x, np.int64) for x in zip(*again))
                    for s, e in _spans(starts, starts + runs + length - 1):
                        yield 1, doc, th, 0, 0, s, e - s - length + 1, True
        for b in batches:
            yield from sliced_rows(rows(b), arrow_schema(STRETCHES), 1 << 15)

    return map_arrow(docs, work, STRETCHES)


def array_parts(docs: DataFrame, length: int, borders: np.ndarray) -> DataFrame:
    """(range, prefixes, counts): the kept suffixes of documents in order, in parts of each task and range between the borders."""
    def work(batches):
        held: list[np.ndarray] = []

        def sent():
            if held:
                ordered, counts = np.unique(np.concatenate(held), return_counts=True)
                at = [0, *np.searchsorted(ordered, borders).tolist(), len(ordered)]
                for r, (s, e) in enumerate(zip(at, at[1:])):
                    if e > s:
                        yield r, _packed(ordered[s:e]), planes(counts[s:e].astype(np.uint32))
            held.clear()

        for b in batches:
            for data in b.column("text"):
                text = np.frombuffer(data.as_py(), np.uint8)
                if len(text) >= length:
                    held.append(_prefixes(text, np.array([place for _, _, place, _ in stretches(text, length)])))
            if sum(map(len, held)) >= HELD:
                yield from sliced_rows(sent(), arrow_schema(PARTS))
        yield from sliced_rows(sent(), arrow_schema(PARTS))

    return map_arrow(docs.select("text"), work, PARTS)


def range_borders(docs: DataFrame, length: int) -> np.ndarray:
    """First suffixes of all ranges but the first, chosen on texts of about ``SAMPLED`` bytes, 64 suffixes of each
    at most, so that a range has about ``RANGE`` suffixes. Any borders give the same result."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = total * 2 // max(1, length - GRAM) // RANGE + 1
    part = docs if total <= SAMPLED else docs.where(F.pmod(F.xxhash64("th"), F.lit(1 << 30)) < int((1 << 30) * SAMPLED / total))

    def work(batches):
        for b in batches:
            found = []
            for data in b.column("text"):
                text = np.frombuffer(data.as_py()[:PIECE], np.uint8)
                if len(text) >= length:
                    place = np.array([p for _, _, p, _ in stretches(text, length)])
                    found += _prefixes(text, place[::-(-len(place) // 64)]).tolist()
            # Trailing zero bytes fall away in the list.
            yield batch(arrow_schema("prefix binary"), [[p.ljust(GRAM, bytes(1)) for p in found]])

    if ranges == 1:
        return np.empty(0, f"S{GRAM}")
    chosen = np.unique(np.array([bytes(r.prefix) for r in map_arrow(part, work, "prefix binary").toLocalIterator()], f"S{GRAM}"))
    return np.unique(chosen[np.arange(1, ranges) * len(chosen) // ranges]) if len(chosen) else chosen


class IndexFamily:
    """Suffix arrays of geometrically growing sizes; each is a table in the shared folder, in order within its ranges."""

    def __init__(self, scratch: Scratch, partitions: int):
        self.scratch, self.partitions = scratch, partitions
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeated: list[DataFrame] = []

    def _merging(self) -> int:
        """How many of the last levels merge now, as two of one size do."""
        n, size = min(1, len(self.levels)), self.levels[-1][0] if self.levels else 0
        while n < len(self.levels) and self.levels[-1 - n][0] == size:
            n, size = n + 1, size + 1
        return n

    def add(self, arrays: DataFrame, last: bool = False) -> None:
        """Merge-scan a batch (range, prefixes, counts) against itself and every level. Levels of one size, which the scan
        before has left, merge on the way: one pass for each batch. The ``last`` one is scanned and not kept."""
        merging = self._merging()
        stay = len(self.levels) - merging if merging > 1 else len(self.levels)
        parts = arrays.select("range", F.lit(-1).alias("level"), "prefixes", "counts")
        for i, (_, level) in enumerate(self.levels):
            parts = parts.union(level.select("range", F.lit(i).alias("level"), "prefixes", F.lit(None).cast("binary")))

        def work(batches):
            out = arrow_schema(ARRAYS)
            for group in shard_groups(batches, ("range",)):
                own = [r for r in group if r["level"] == -1]
                levels = {r["level"]: _unpacked_prefixes(r["prefixes"]) for r in group if r["level"] >= 0}
                place = group[0]["range"]
                if own:
                    every = np.concatenate([_unpacked_prefixes(r["prefixes"]) for r in own])
                    often = np.concatenate([from_planes(r["counts"], np.uint32) for r in own])
                    order = np.argsort(every, kind="stable")
                    every, often = every[order], often[order]
                    same = common_prefixes(every) >= GRAM if len(every) else np.empty(0, bool)
                    first = np.flatnonzero(np.append(True, ~same))
                    twice = np.add.reduceat(often, first, dtype=np.int64) > 1
                    new = every[first]
                    found = [new[twice]]
                    for level in levels.values():
                        merged = np.sort(np.concatenate([level, new]), kind="stable")
                        found.append(merged[1:][common_prefixes(merged) >= GRAM])
                    keys = np.unique(_keys(np.concatenate(found)))
                    if not last:
                        yield batch(out, [[0], [place], [_packed(new)], [None]])
                    if len(keys):
                        yield batch(out, [[2], [place], [planes(keys)], [None]])
                joined = [v for k, v in levels.items() if k >= stay]
                if joined and not last:
                    yield batch(out, [[1], [place], [_packed(np.unique(np.concatenate(joined)))], [None]])

        dealt = parts.repartition(self.partitions, "range").sortWithinPartitions("range", "level")
        kept = self.scratch.keep(map_arrow(dealt, work, ARRAYS), "scan", ("kind",))
        self.repeated.append(kept.where("kind = 2").select("prefixes"))
        if last:
            return
        if merging > 1:
            size = self.levels[-1][0] + merging - 1
            self.levels[stay:] = [(size, kept.where("kind = 1"))]
        self.levels.append((0, kept.where("kind = 0")))

    def repeated_keys(self) -> DataFrame:
        """(key) of every suffix that was matched."""
        found = self.repeated[0]
        for more in self.repeated[1:]:
            found = found.union(more)

        def work(batches):
            for b in batches:
                for keys in b.column(0):
                    yield batch(arrow_schema("key long"), [from_planes(keys.as_py(), np.uint64).view(np.int64)])

        return self.scratch.keep(map_arrow(found, work, "key long").distinct(), "keys")


class _Places:
    """What is known of a document's stretches: (first run, runs, repeated, asks), and the (first run, runs) of words that ask."""

    def __init__(self, first, runs, repeated, asks, worded=b""):
        self.first, self.runs = np.asarray(first, np.int64), np.asarray(runs, np.int64)
        self.repeated, self.asks, self.worded = np.asarray(repeated, bool), np.asarray(asks, bool), worded


def _answers(asked: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """(block, shard, twice): a bit for each key that a block asks for, set if all counts of the key are over one."""
    def add(batches_in):
        def rows():
            for group in shard_groups(batches_in, ("shard",)):
                _, _, own = totals([(r["keys"], r["counts"]) for r in group])
                for r, sums in zip(group, own):  # a last bit ends the list
                    yield r["block"], r["shard"], np.packbits(np.concatenate([sums > 1, [True]])).tobytes()
        yield from sliced_rows(rows(), arrow_schema(TOLD))

    dealt = asked.repartition(partitions, "shard").sortWithinPartitions("shard")
    return scratch.keep(map_arrow(dealt, add, TOLD), "answers")


def _meeting(answers: DataFrame, blocks: DataFrame, partitions: int) -> DataFrame:
    """(twice, payload): the answers to every block in order of their shards, then the block itself."""
    return (answers.withColumn("payload", F.lit(None).cast("binary"))
            .union(blocks.select("block", F.lit(partitions * 2).alias("shard"), F.lit(None).cast("binary"), "payload"))
            .repartitionByRange(partitions, "block").sortWithinPartitions("block", "shard").select("twice", "payload"))


def _answered(batches_in) -> Iterator[tuple[bytes, np.ndarray]]:
    """Every block with the bits of its keys."""
    held: list[np.ndarray] = []
    for b in batches_in:
        for twice, payload in zip(b.column("twice"), b.column("payload")):
            if twice.as_py() is not None:
                bits = np.unpackbits(np.frombuffer(twice.as_py(), np.uint8))
                held.append(bits[:len(bits) - 1 - int(np.argmax(bits[::-1]))].astype(bool))
                continue
            yield payload.as_py(), np.concatenate(held) if held else np.empty(0, bool)
            held = []


def shared_words(source: DataFrame, scratch: Scratch, run: int, partitions: int) -> DataFrame:
    """(doc, th, worded): stretches of runs of ``run`` words whose kept words stand in several documents."""
    cuts = shard_cuts(partitions * 2)

    def sample(batches_in):
        from pyspark import TaskContext
        number, held, weight = TaskContext.get().partitionId() << 24, [], 0
        out = arrow_schema(SAMPLED_WORDS)

        def packed():
            once = np.concatenate([np.unique(x[4]) for x in held])
            keys, counts = distinct_keys(once, np.ones(len(once), np.uint32))
            first, runs, own = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
            head = [np.array(x, np.int64) for x in zip(*[(doc, th, len(f)) for doc, th, f, _, _ in held])]
            numbers = [np.array([len(held)], np.int64), *head, first, runs, np.searchsorted(keys, own).astype(np.int64)]
            yield 1, None, number, None, None, b"".join(a.tobytes() for a in numbers)
            for shard, k, c in questions(keys, counts, cuts):
                yield 0, shard, number, k, c, None

        for b in batches_in:
            hashed = [(doc, th, w) for doc, th, text in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("text"))
                      if len(w := word_hashes(text.as_py())) >= run]
            if hashed:
                found = _stretches_of_each([w for _, _, w in hashed], run)
                held += [(doc, th, *f) for (doc, th, _), f in zip(hashed, found)]
                weight += sum(8 * len(w) for _, _, w in hashed)
            if held and weight >= BLOCK:
                yield from sliced_rows(packed(), out)
                number, held, weight = number + 1, [], 0
        if held:
            yield from sliced_rows(packed(), out)

    def tell(batches_in):
        def rows():
            for payload, twice in _answered(batches_in):
                numbers = np.frombuffer(payload, np.int64)
                n = int(numbers[0])
                doc, th, size = numbers[1:3 * n + 1].reshape(3, n)
                first, runs, own = numbers[3 * n + 1:].reshape(3, -1)
                hit, end = twice[own], np.cumsum(size)
                for i, (s, e) in enumerate(zip((end - size).tolist(), end.tolist())):
                    if hit[s:e].any():
                        yield int(doc[i]), int(th[i]), np.stack([first[s:e][hit[s:e]], runs[s:e][hit[s:e]]]).tobytes()
        yield from sliced_rows(rows(), arrow_schema(WORDED))

    made = scratch.keep(map_arrow(source.select("doc", "th", "text"), sample, SAMPLED_WORDS), "words", ("kind",))
    answers = _answers(made.where("kind = 0").select("shard", "block", "keys", "counts"), scratch, partitions)
    return map_arrow(_meeting(answers, made.where("kind = 1"), partitions), tell, WORDED)


def _result(data: bytes, spans: list[tuple[int, int]], with_text: bool, words: int = 0) -> tuple:
    spans = [(s, e) for s, e in spans if not words or len(data[s:e].split()) > words]
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    rest = b"".join([*kept, data[at:]])
    return (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(),
            (_whole_characters(data, spans) if with_text and spans else None))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The rest of a text with every character kept of which a byte is kept."""
    kept, at = [], 0
    for s, e in spans:
        while s < len(data) and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            kept.append(data[at:s])
            at = e
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, batches: int = BATCHES,
                   with_text: bool = False, words: int = 0, passages: int = 0) -> DataFrame:
    """(doc_id, th, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passages, passage_words) of every row.

    Removed is every byte under a string of ``length`` bytes that starts anywhere else too, in this or another
    document; strings are judged on the input. With ``words``, only maximal runs of such bytes with more words are removed. Null texts are empty. Repeated rows are documents of their own, so
    their long strings repeat. Null ids stay. ``th`` is the hash of the text that, with the id, tells rows apart;
    ``kept`` is the rest of a text that lost something, cut at whole characters, if ``with_text``.
    With ``passages``, ``n_passages`` counts the maximal runs of more than so many words that stand in another document too,
    in whatever number of bytes and whatever white space between; ``passage_words`` are their words. They change nothing of
    what is removed. A word ends at ASCII white space. Without ``passages`` both are null.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    nobody = F.lit(-1 << 63).cast("long")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), nobody).alias("doc"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), utf8().alias("text"))
    made = scratch.keep(suffixes(source, length), "suffixes", ("kind",))
    entries, borders = made.where("kind = 0"), range_borders(source, length)
    family = IndexFamily(scratch, partitions)
    for number in range(batches):
        dealt = source.where(F.pmod(F.hash("doc", "th"), F.lit(batches)) == number)
        family.add(array_parts(dealt, length, borders), number == batches - 1)
    keys = family.repeated_keys()
    sieve = spark.sparkContext.broadcast(sieve_of(keys, keys.count()))

    def sifted(batches_in):
        known = Sieve(sieve.value)
        for b in batches_in:
            yield b.filter(pa.array(known.may(b.column("key").to_numpy().view(np.uint64))))

    columns = ("doc", "th", "key", "stretch", "first", "runs", "repeated")
    slim = entries.select(*columns)
    matched = map_arrow(slim, sifted, slim.schema).join(keys, "key", "left_semi").select(*columns)
    matched = scratch.keep(matched, "matched")
    kinds = scratch.keep(matched.groupBy("key", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "th", "first")).alias("asker")), "kinds")
    several = scratch.keep(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "counts")
    kinds = scratch.keep(kinds.join(several, "key"), "several")
    known = (matched.join(kinds, ["key", "stretch"])
             .select("doc", "th", "first", "runs", ((F.col("n") > 1) | F.col("repeated")).alias("repeated"),
                     ((F.col("kinds") > 1) & (F.col("asker") == F.struct("doc", "th", "first"))).alias("asks"))
             .where("repeated OR asks"))
    known = known.union(made.where("kind = 1").select("doc", "th", "first", "runs", "repeated", F.lit(False).alias("asks")))
    known = known.withColumn("worded", F.lit(None).cast("binary"))
    columns, run = ("first", "runs", "repeated", "asks"), passages + 1
    if passages:
        worded = shared_words(source, scratch, run, partitions)
        known = known.unionByName(worded, allowMissingColumns=True)
    places = scratch.keep(known.groupBy("doc", "th").agg(
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct(*columns)))).alias("p"), F.max("worded").alias("worded"))
        .select("doc", "th", *[F.col(f"p.{c}").alias(c) for c in columns], "worded"), "places")
    none = (0, 0) if passages else (None, None)

    def place(batches_in):
        from pyspark import TaskContext
        number, held, weight = TaskContext.get().partitionId() << 24, [], 0
        out = arrow_schema(PLACED)

        def packed():
            head = [np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)]
            sizes = [np.array(n, np.int64) for n in zip(*[(len(x[2]), len(x[3].first), len(x[3].worded)) for x in held])]
            flat = [np.concatenate([getattr(x[3], c).astype(np.int64) for x in held]) for c in ("first", "runs", "repeated", "asks")]
            text = b"".join([*(x[3].worded for x in held), *(x[2] for x in held)])
            body = b"".join(a.tobytes() for a in (np.array([len(held), len(flat[0])], np.int64), *head, *sizes, *flat)) + text
            return batch(out, [[1], [number], *[[None]] * 8, [body]])

        for b in batches_in:
            ready = []
            for doc, th, text, first, runs, repeated, asks, worded in zip(*(b.column(c) for c in ("doc", "th", "text", *columns, "worded"))):
                data, doc, th, first = text.as_py(), doc.as_py(), th.as_py(), first.as_py()
                p = _Places(first or [], runs.as_py() or [], repeated.as_py() or [], asks.as_py() or [], worded.as_py() or b"")
                if p.asks.any() or p.worded:
                    held.append((doc, th, data, p))
                    weight += len(data)
                else:
                    n, removed, spans, digest, kept = _result(data, _spans(p.first, p.first + p.runs + length - 1), with_text, words)
                    ready.append((0, th, None if doc == -1 << 63 else doc, n, removed, spans, digest, kept, *none, None))
                if weight >= BLOCK // 2:
                    yield packed()
                    number, held, weight = number + 1, [], 0
            yield from sliced_rows(ready, out)
        if held:
            yield packed()

    # Most documents have no such place and stay where they are; only those that may have one are joined.
    touched = spark.sparkContext.broadcast(sieve_of(places.select(F.xxhash64("doc", "th").alias("key")), places.count()))
    keyed = source.select("doc", "th", "text", F.xxhash64("doc", "th").alias("key"))

    def may_be(b):
        return Sieve(touched.value).may(b.column("key").to_numpy().view(np.uint64))

    def touched_rows(batches_in):
        for b in batches_in:
            yield b.filter(pa.array(may_be(b)))

    def untouched(batches_in):
        for b in batches_in:
            b = b.filter(pa.array(~may_be(b)))

            def rows():
                for doc, th, text in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("text")):
                    yield None if doc == -1 << 63 else doc, th, *_result(text.as_py(), [], with_text), *none
            yield from sliced_rows(rows(), arrow_schema(RESULT))

    joined = map_arrow(keyed, touched_rows, keyed.schema).drop("key").join(places, ["doc", "th"], "left")
    placed = scratch.keep(map_arrow(joined, place, PLACED), "placed", ("kind",))
    blocks = placed.where("kind = 1").select("block", "payload")
    cuts = shard_cuts(partitions * 2)

    def ask(batches_in):
        def rows():
            for b in batches_in:
                for block, payload in zip(b.column("block"), b.column("payload")):
                    asked = [_all_asked(d, length, run) for d in _unpacked(payload.as_py())]
                    # Runs of words are counted by documents.
                    keys = np.concatenate([k for own, _, shared in asked for k in (*own, np.unique(shared))])
                    for shard, k, c in questions(*distinct_keys(keys, np.ones(len(keys), np.uint32)), cuts):
                        yield shard, block.as_py(), k, c
        yield from sliced_rows(rows(), arrow_schema(ASKED))

    answers = _answers(map_arrow(blocks, ask, ASKED), scratch, partitions)

    def finish(batches_in):
        for payload, found in _answered(batches_in):
            documents = _unpacked(payload)
            asked = [_all_asked(d, length, run) for d in documents]
            keys = np.unique(np.concatenate([k for own, _, shared in asked for k in (*own, shared)]))
            rows = []
            for (doc, th, data, p), (own, at, shared) in zip(documents, asked):
                starts, ends = [p.first[p.repeated]], [(p.first + p.runs + length - 1)[p.repeated]]
                for first, h in zip(p.first[p.asks].tolist(), own):
                    hit = np.flatnonzero(found[np.searchsorted(keys, h)]) + first
                    starts.append(hit), ends.append(hit + length)
                result = _result(data, _spans(np.concatenate(starts), np.concatenate(ends)), with_text, words)
                hit = at[found[np.searchsorted(keys, shared)]]
                spans = _spans(hit, hit + run)
                told = (len(spans), sum(e - s for s, e in spans)) if p.worded else none
                rows.append((None if doc == -1 << 63 else doc, th, *result, *told))
            yield from sliced_rows(rows, arrow_schema(RESULT))

    ready = placed.where("kind = 0").select("doc_id", F.col("block").alias("th"), *RESULT_COLUMNS)
    return ready.union(map_arrow(_meeting(answers, blocks, partitions), finish, RESULT)).union(map_arrow(keyed, untouched, RESULT))


RESULT_COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages", "passage_words")


def _unpacked(payload: bytes) -> list[tuple[int, int, bytes, _Places]]:
    """The documents of a block."""
    n, m = np.frombuffer(payload, np.int64, 2).tolist()
    numbers = np.frombuffer(payload, np.int64, 5 * n + 4 * m, 16)
    doc, th, size, count, worded = (numbers[i * n:(i + 1) * n].tolist() for i in range(5))
    flat = [numbers[5 * n + i * m:5 * n + (i + 1) * m] for i in range(4)]
    found, asked, place = [], 16 + 8 * (5 * n + 4 * m), 0
    at = asked + sum(worded)
    for i in range(n):
        places = _Places(*(x[place:place + count[i]] for x in flat), payload[asked:asked + worded[i]])
        found.append((doc[i], th[i], payload[at:at + size[i]], places))
        at, place, asked = at + size[i], place + count[i], asked + worded[i]
    return found


def _asked(document: tuple, length: int) -> list[np.ndarray]:
    """Fingerprints of the runs of each asking stretch."""
    _, _, data, p = document
    text = np.frombuffer(data, np.uint8)
    return [run_hashes(text[f:f + r + length - 1], length) for f, r in zip(p.first[p.asks].tolist(), p.runs[p.asks].tolist())]


def _all_asked(document: tuple, length: int, run: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The fingerprints of ``_asked``, then (place, fingerprint) of the runs of words that ask."""
    _, _, data, p = document
    shared = (np.empty(0, np.int64), np.empty(0, np.uint64))
    if p.worded:
        shared = _word_runs(word_hashes(data), run, np.frombuffer(p.worded, np.int64).reshape(2, -1))
    return _asked(document, length), *shared
