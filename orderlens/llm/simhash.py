"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint of 64 bits is the majority of the hashes of a text's word shingles. Two
fingerprints that differ in at most ``radius`` bits agree, after leaving out one of the
``radius - 1 + (radius + 1) % 2`` zones of the bits that holds most of their differences, up
to a smaller even radius; so each fingerprint emits, for each zone left out, every variant
within *half* of that radius, and linked fingerprints meet in a common variant. With radius 3
there are three zones, a rest radius of 2, and 1 + 42 or 43 variants for each zone: about
131 rows a fingerprint, whose 42 to 43 bits keep chance meetings rare up to billions of texts.

Equal fingerprints are one class before any variant is emitted, so copies never meet as pairs.
Meeting fingerprints are verified by their full distance inside the task; only a spanning
forest of the links leaves it.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_schema, batch, bounds, forest, map_arrow, runs, shuffle_partitions, utf8
from orderlens.llm.components import components
from orderlens.session import Scratch

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 14
#: Rows of a meeting group that are compared with the rest at once.
BLOCK = 256


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by blanks; of all words if they are fewer."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends[:-size]]
    return np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[size - 1:])),
                       np.uint64, len(starts))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at:at + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(id, th, fp): the hash of the text, and its fingerprint as a signed long. Null texts are empty."""
    kind = dict(docs.dtypes)[id_column]
    schema = "id long, th long, fp long"

    def work(batches):
        out = arrow_schema(schema)
        for b in batches:
            values = [fingerprint(t.as_py(), size) for t in b.column("text")]
            yield batch(out, [b.column("id"), b.column("th"), np.array(values, np.uint64).view(np.int64)])

    source = docs.select(F.col(id_column).cast("long").alias("id"),
                         F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("th"), utf8(text_column).alias("text"))
    assert kind in ("bigint", "int"), f"{id_column} must be a whole number"
    return map_arrow(source, work, schema)


def zones(radius: int) -> tuple[list[np.uint64], int]:
    """Bit masks that are left out one at a time, and the radius on what remains.

    Leaving out the zone with most differences leaves at most ``radius - ceil(radius / n)``
    of them; n is the least number of zones for which that is even.
    """
    if radius % 2 == 0:
        return [np.uint64(0)], radius
    cuts = [64 * i // 3 for i in range(4)]
    rest = radius - -(-radius // 3)
    return [np.uint64(sum(1 << i for i in range(a, b))) for a, b in zip(cuts, cuts[1:])], rest + rest % 2


def variants(fps: np.ndarray, left_out: np.uint64, half: int) -> np.ndarray:
    """All variants of each fingerprint within ``half`` flips outside a zone: rows x variants."""
    bits = [np.uint64(1 << i) for i in range(64) if not (int(left_out) >> i) & 1]
    flips = [np.uint64(0)]
    level = [(np.uint64(0), -1)]
    for _ in range(half):
        level = [(m | b, i) for m, last in level for i, b in enumerate(bits) if i > last]
        flips += [m for m, _ in level]
    # The lowest bit of the zone tells the zones' keys apart.
    mark = left_out & (~left_out + np.uint64(1))
    return ((fps & ~left_out) | mark)[:, None] ^ np.array(flips, np.uint64)[None, :]


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(left ^ right).sum(-1, dtype=np.int64)


def _linked(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one meeting group, as row numbers: search from block to block over what is not
    reached yet."""
    a, b = [], []
    waiting, front = np.arange(len(words)), np.empty(0, np.int64)
    while len(waiting):
        if not len(front):
            front, waiting = waiting[:1], waiting[1:]
        block, front = front[:BLOCK], front[BLOCK:]
        near = np.zeros((len(block), len(waiting)), np.int64)
        for w in range(words.shape[1]):
            near += np.bitwise_count(words[block, w][:, None] ^ words[waiting, w][None, :])
        near = near <= radius
        hit = near.any(0)
        a.append(block[near.argmax(0)[hit]])
        b.append(waiting[hit])
        front, waiting = np.concatenate([front, waiting[hit]]), waiting[~hit]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(classes: DataFrame, masks: list[np.uint64], half: int, words: tuple[str, ...], radius: int) -> DataFrame:
    """Links (a, b) between nodes: a spanning forest of all pairs that meet and differ in at most ``radius`` bits.

    ``classes`` has the column ``node``, the column ``fp`` whose variants within ``half`` flips outside each
    mask are emitted, and the columns ``words`` that are compared.
    """
    carried = ("node", *words)
    schema = ", ".join(f"{c} long" for c in ("key", *carried))

    def emit(batches):
        out = arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                for mask in masks:
                    keys = variants(part.column("fp").to_numpy().view(np.uint64), mask, half)
                    yield batch(out, [keys.ravel().view(np.int64),
                                      *[np.repeat(part.column(c).to_numpy(), keys.shape[1]) for c in carried]])

    def meet(batches):
        out = arrow_schema("a long, b long")
        for t in runs(batches, ("key",)):
            keys, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            bits = np.stack([t.column(c).to_numpy().view(np.uint64) for c in words], 1)
            edges = bounds([keys])
            size = np.diff(edges)
            small, a, b = np.repeat(size <= 8, size), [], []
            for step in range(1, 8):  # small groups side by side
                at = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]))
                if not len(at):
                    break
                at = at[_apart(bits[at], bits[at + step]) <= radius]
                a.append(node[at])
                b.append(node[at + step])
            for i in np.flatnonzero(size > 8):
                x, y = _linked(bits[edges[i]:edges[i + 1]], radius)
                a.append(node[edges[i] + x])
                b.append(node[edges[i] + y])
            if any(map(len, a)):
                yield batch(out, forest(np.concatenate(a), np.concatenate(b)))

    keyed = map_arrow(classes.select(*dict.fromkeys(("fp", *carried))), emit, schema)
    dealt = keyed.repartition(shuffle_partitions(classes.sparkSession), "key").sortWithinPartitions("key")
    return map_arrow(dealt, meet, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, radius: int = RADIUS,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, th, fp, component_id, component) for every row: the hash of its text, its fingerprint, the least id reachable by
    links and the least fingerprint reachable, which tells groups apart where ids repeat.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows
    stay and share a component. Null ids are kept and never name a component, unless a
    component has no other. An empty table gives an empty result; other columns are not read.
    """
    marked = scratch.keep(fingerprints(docs, size, id_column, text_column), "fingerprints")
    classes = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    left_out, rest = zones(radius)
    found = links(classes.withColumn("node", F.col("fp")), left_out, rest // 2, ("fp",), radius)
    groups = components(found, scratch).withColumnRenamed("node", "fp")
    placed = scratch.keep(classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")),
                          "placed")
    # Written first, so that the join shuffles both sides and a hot component can be split.
    least = scratch.keep(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = scratch.keep(placed.join(least, "component").select("fp", "component_id", "component"), "named")
    return marked.join(named, "fp").select("id", "th", "fp", "component_id", "component")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
