"""Packing documents into sequences by a grouping genetic algorithm on islands.

A document is its token ids and an end id. Only longer ones than a sequence are cut: the first piece
takes what is left over, the others fill a sequence each. What does not fill a sequence is dealt to
shards of about ``SHARD`` pieces. In a shard, an individual is a set of bins; crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold a
document twice, and places the displaced documents by best fit. ``ISLANDS`` populations of a
shard evolve on their own, each in a row that Spark deals out; after each epoch the best of every island
migrates to the next. A shard whose best individual needs no more bins than its
tokens at least fill is done at once, as nothing can be better.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bpe import splitter
from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, sliced_rows, utf8
from orderlens.session import Scratch

LENGTH, END_ID, SHARD = 2048, 0, 20_000
ISLANDS, POPULATION, GENERATIONS, EPOCHS, INJECTED = 3, 3, 4, 2, 0.3


def encoding_of(path: str, pattern: str):
    """The byte-level BPE of a tokenizer file, with its special tokens, as the faster of two libraries runs it.

    The file's ids are in the order of its merges, so they serve as ranks. Its vocabulary writes bytes
    as printable characters: those that are printable in Latin-1 as themselves, the others, in order, from U+0100 on.
    """
    import tiktoken
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: Characters from which a text is cut into pre-tokens outside tiktoken, whose matcher raises where a million of white
#: space follow each other.
WHOLE_CHARACTERS = 500_000


def encoder(path: str, pattern: str):
    """Gives the ids of a text of any length, as the tokenizer file's own library does."""
    encoding, split = encoding_of(path, pattern), splitter(pattern)
    special = {t: encoding.encode_single_token(t) for t in encoding.special_tokens_set}
    parts_of = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})").split if special else lambda t: [t]
    # One pre-token at a time, by merges alone.
    merged = encoding._core_bpe.encode_single_piece

    def encode(text: str) -> np.ndarray:
        if len(text) < WHOLE_CHARACTERS:
            return np.array(encoding.encode(text, allowed_special="all"), "<u4")
        ids = array("I")
        for part in parts_of(text):
            if part in special:
                ids.append(special[part])
            else:
                for word in split(part):
                    ids.extend(merged(word.encode()))
        return np.frombuffer(ids, np.uint32).astype("<u4")

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null texts are empty and hold the end id alone."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def work(batches):
        encode = encoder(tokenizer_path, pattern)

        def rows(b):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(encode(text.as_py().decode("utf-8", "replace")), np.array([end_id], "<u4")).tobytes()
                count = len(ids) // 4
                cuts = [0, *range(count % length or length, count + 1, length)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    yield doc, k, s, e - s, zlib.crc32(ids[4 * s:4 * e])
        for b in batches:
            yield from sliced_rows(rows(b), arrow_schema(schema), 1 << 16)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), work, schema)


class BestFit:
    """Open bins by free space; a mask of bits finds the tightest that fits."""

    def __init__(self, length: int):
        self.length, self.mask, self.free = length, 0, [[] for _ in range(length + 1)]

    def open(self, bin_no: int, space: int) -> None:
        if space:
            self.free[space].append(bin_no)
            self.mask |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin with room for ``size``, and its space."""
        above = self.mask >> size
        if not above:
            return None
        space = size + (above & -above).bit_length() - 1
        found = self.free[space].pop()
        if not self.free[space]:
            self.mask &= ~(1 << space)
        return found, space


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, used: list[int], length: int) -> list[int]:
    """Place ``items`` in the given order into ``bins`` (the bin of each item, -1 before); ``used`` is filled so far."""
    fit = BestFit(length)
    for b, u in enumerate(used):
        fit.open(b, length - u)
    used = list(used)
    for i, size in zip(items.tolist(), sizes[items].tolist()):
        if found := fit.take(size):
            b, space = found
        else:
            b, space = len(used), length
            used.append(0)
        bins[i] = b
        used[b] += size
        fit.open(b, space - size)
    return used


def decreasing(sizes: np.ndarray, items: np.ndarray, random: np.random.Generator | None = None) -> np.ndarray:
    """Items from long to short; with ``random``, neighbours in length are shuffled a little."""
    key = sizes[items].astype(float)
    if random is not None:
        key *= random.uniform(0.9, 1.0, len(items))
    return items[np.argsort(-key, kind="stable")]


def crossover(sizes, left: np.ndarray, right: np.ndarray, length: int, random, share: float = INJECTED) -> np.ndarray:
    """Inject the best-filled bins of ``right`` into ``left``."""
    fill = np.bincount(right, sizes, minlength=int(right.max()) + 1)
    order = np.argsort(-(fill + random.uniform(0, length * 0.02, len(fill))))
    injected = np.zeros(len(fill), bool)
    injected[order[:max(1, int(len(order) * share * random.uniform(0.5, 1.5)))]] = True
    taken = injected[right]
    broken = np.zeros(int(left.max()) + 1, bool)
    broken[left[taken]] = True  # these hold an injected document as well
    kept = ~broken[left] & ~taken
    _, new = np.unique(left[kept], return_inverse=True)
    child = np.full(len(sizes), -1, np.int64)
    child[kept] = new
    count = int(new.max()) + 1 if len(new) else 0
    _, moved = np.unique(right[taken], return_inverse=True)
    child[taken] = moved + count
    used = np.bincount(child[child >= 0], sizes[child >= 0]).astype(int).tolist()
    best_fit(sizes, decreasing(sizes, np.flatnonzero(child < 0), random), child, used, length)
    return child


def fitness(sizes: np.ndarray, bins: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(bins, sizes) / length
    return -len(fill), float((fill * fill).mean())


def evolve(sizes: np.ndarray, population: list[np.ndarray], length: int, random,
           generations: int = GENERATIONS, count: int = POPULATION) -> list[np.ndarray]:
    """A few generations of one island, best individual first."""
    least = -(-int(sizes.sum()) // length)
    every = np.arange(len(sizes))
    while len(population) < count:
        bins = np.full(len(sizes), -1, np.int64)
        best_fit(sizes, decreasing(sizes, every, random if population else None), bins, [], length)
        population.append(bins)
        if int(bins.max()) + 1 <= least:
            return [bins]
    ranked = sorted(population, key=lambda x: fitness(sizes, x, length), reverse=True)
    for _ in range(generations):
        if int(ranked[0].max()) + 1 <= least:
            break
        a, b = random.choice(min(len(ranked), count), 2, replace=False) if len(ranked) > 1 else (0, 0)
        ranked.append(crossover(sizes, ranked[a], ranked[b], length, random))
        ranked = sorted(ranked, key=lambda x: fitness(sizes, x, length), reverse=True)[:count]
    return ranked


def _packed(individuals: list[np.ndarray]) -> bytes:
    return np.stack(individuals).astype("<i4").tobytes()


def _unpacked(data: bytes | None, items: int) -> list[np.ndarray]:
    return list(np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, items)) if data else []


def pack(piece_table: DataFrame, scratch: Scratch, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """The pieces with (sequence_id, offset).

    ``piece_table`` must be stored, as it is read more than once. Pieces that fill a sequence have their
    own; repeated rows are pieces of their own. An empty table gives an empty result.
    """
    spark = piece_table.sparkSession
    part = piece_table.where(F.col("length") < length)
    shards = max(1, round(part.count() / shard))
    # A piece's shard follows from its content alone, so a task that is run again deals as before.
    dealt = piece_table.withColumn("shard", F.when(F.col("length") < length, F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))).otherwise(F.lit(-1)).cast("int"))
    numbered = scratch.keep(
        dealt.where("shard >= 0").repartition(shuffle_partitions(spark), "shard")
        .sortWithinPartitions("shard", "doc_id", "piece", "start", "ids_crc32"), "pieces")
    sizes = (numbered.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "start", "ids_crc32", "length")))
                                           .alias("items")).select("shard", F.col("items.length").cast("array<int>").alias("sizes")))
    sizes = scratch.keep(sizes, "sizes")
    state = sizes.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).select(
        "shard", "island", "sizes", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("guest"))
    schema = "shard int, island int, sizes array<int>, population binary, best binary, bins int, least int"

    def step(epoch):
        def work(batches):
            kinds = arrow_schema(schema)
            for b in batches:
                for r in b.to_pylist():
                    s = np.array(r["sizes"], np.int64)
                    random = np.random.default_rng((r["shard"], r["island"], epoch))
                    # The first island starts with plain best fit of decreasing lengths.
                    own = _unpacked(r["population"], len(s)) + _unpacked(r["guest"], len(s))
                    if not own and r["island"]:
                        own = [np.full(len(s), -1, np.int64)]
                        best_fit(s, decreasing(s, np.arange(len(s)), random), own[0], [], length)
                    own = evolve(s, own, length, random)
                    yield batch(kinds, [[r["shard"]], [r["island"]], [r["sizes"]], [_packed(own)], [_packed(own[:1])],
                                        [int(own[0].max()) + 1], [-(-int(s.sum()) // length)]])
        return work

    for epoch in range(EPOCHS):
        evolved = scratch.keep(map_arrow(state.repartition(shuffle_partitions(spark), "shard", "island"), step(epoch), schema),
                               f"epoch{epoch}")
        if evolved.groupBy("shard").agg(F.min("bins").alias("bins"), F.min("least").alias("least")).where("bins > least").isEmpty():
            break
        elite = evolved.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("guest"))
        state = evolved.drop("best", "bins", "least").join(elite, ["shard", "island"])
    won = evolved.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("bins"))
    schema_out = "shard int, item int, bin int"

    def spread(batches):
        for b in batches:
            for r in b.to_pylist():
                bins = np.frombuffer(r["bins"], "<i4")
                for at in range(0, len(bins), 1 << 16):
                    yield batch(arrow_schema(schema_out), [np.full(len(bins[at:at + (1 << 16)]), r["shard"], np.int32),
                                np.arange(at, min(len(bins), at + (1 << 16)), dtype=np.int32), bins[at:at + (1 << 16)]])

    order = F.row_number().over(_window("shard", "doc_id", "piece", "start", "ids_crc32", "length")) - 1
    placed = numbered.withColumn("item", order).join(map_arrow(won, spread, schema_out), ["shard", "item"])
    # Bins of a shard get numbers of their own: shard and bin in one long.
    inside = F.sum("length").over(_window(("shard", "bin"), "item")) - F.col("length")
    partly = placed.withColumn("offset", inside).withColumn(
        "sequence_id", F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin"))
    full = dealt.where("shard < 0").withColumn("offset", F.lit(0).cast("long")).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id())
    columns = [*piece_table.columns, "sequence_id", "offset"]
    return partly.select(columns).union(full.select(columns))


def _window(by, *order):
    from pyspark.sql import Window
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
