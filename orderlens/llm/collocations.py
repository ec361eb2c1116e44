"""Phrase collocations by partitioning (the SON algorithm).

A shard is the part of one language that one block of documents holds, as word numbers. Length by length, every shard
is mined completely at its lowered support: ``support * tokens of the shard / tokens of the language``, rounded up. A
phrase that is frequent overall reaches that in one shard at least, for otherwise its counts would add up to less than
the support. A locally frequent phrase is a candidate if it can reach the support overall: a shard that has not sent it has
at most one less than its lowered support of it. Then every shard counts the candidates that it has not counted yet, and the
sums are exact. Only phrases whose parts are frequent overall go on to the next length.

Phrases travel as sorted 64-bit keys of word sequences, packed by key range. Which phrases may be candidates is
told to the shards by a sieve of the candidate keys of at most ``sieve.SIEVE_BYTES``; a sieve that is too small for
its keys lets more through, which the sum per key then leaves out. A second sieve names, for each frequent phrase,
the one shard that writes its words down.

With more than ``support`` shards of one language the lowered support is one: a shard then sends each of its distinct phrases
of frequent parts once, and nothing is left for the second count. Small input partitions are put together so that this comes late.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.blocks import Block, from_planes, planes, questions, shard_cuts, shard_groups
from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, sliced_rows, utf8
from orderlens.llm.sieve import PARTS, Sieve, joined, sieve_of
from orderlens.session import Scratch

SUPPORT, LONGEST, SCALE, PERCENT, TOP = 100, 5, 1000, 100, 2000
#: Bytes of text of a shard's block; keys of a range of keys.
SHARD_BYTES, RANGE_KEYS = 16 << 20, 4 << 20
#: Parts of a language whose first phrases are taken before they are ranked together.
SALTS = 256

#: What no UTF-8 text holds stands for the end of a piece.
BREAK = b"\xff"
_CLEAN = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in bytes(range(256)).lower())

SHARDS = "shard long, lang string, tokens long, words binary, numbers binary"
SENT = "range int, shard long, unsent long, base long, keys binary, counts binary"
CANDIDATES = "range int, keys binary, counts binary, shards binary, found long"
FREQUENT = "key long, f long, shard long"
WRITTEN = "key long, lang string, phrase string, lefts array<long>, rights array<long>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text with a break after each piece."""
    return (text.translate(_CLEAN) + BREAK).replace(BREAK, b" \xff ").split()


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per block and language: its words, and the texts as word numbers, zero at the end of a piece."""
    def packed(number: int, lang: str, held: Block):
        words = list(held.words)[1:]
        numbers = np.concatenate(held.numbers)
        return (number, lang, int(np.count_nonzero(numbers)), b"\n".join(words), planes(numbers))

    def work(batches):
        number, held, weight = TaskContext.get().partitionId() << 32, {}, 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                data = text.as_py()
                if lang not in held:
                    held[lang] = Block()
                    held[lang].words[BREAK]
                held[lang].add((), words_of(data), len(data))
                weight += len(data)
                if weight >= shard_bytes:
                    for part in held.items():
                        yield from sliced_rows([packed(number, *part)], arrow_schema(SHARDS))
                        number += 1
                    held, weight = {}, 0
        for part in held.items():
            yield from sliced_rows([packed(number, *part)], arrow_schema(SHARDS))
            number += 1

    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8().alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return map_arrow(source.coalesce(max(1, math.ceil(size / shard_bytes))), work, SHARDS)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Keys with their bits mixed, in place."""
    for _ in range(2):
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return keys


def _written_by(keys: np.ndarray, shards_of: np.ndarray) -> np.ndarray:
    """Keys of (phrase, shard)."""
    return _mixed(keys + (shards_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Shard:
    """The phrases of one shard."""

    def __init__(self, row: dict):
        self.id, self.lang = row["shard"], row["lang"]
        self.words = row["words"].split(b"\n") if row["words"] else []
        self.numbers = from_planes(row["numbers"], np.uint32)
        lang = np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), 11))
        named = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.keys = np.concatenate([np.zeros(1, np.uint64), _mixed(named + lang)])

    def phrases(self, keep, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first positions, keys) of the kept phrases, size after size.

        ``keep(size, keys)`` says which phrases go on; a phrase needs both of its parts that are one word shorter.
        """
        position = np.flatnonzero(self.numbers).astype(np.int32)
        keys = self.keys[self.numbers[position]]
        for size in range(1, longest + 1):
            if size > 1:
                both = np.flatnonzero(position[1:] == position[:-1] + 1)
                keys, position = keys[both], position[both]
                del both
                keys *= np.uint64(0x9E3779B97F4A7C15)
                keys += self.keys[self.numbers[position + (size - 1)]]
                _mixed(keys)
            stays = keep(size, keys)
            if stays is not None:
                keys, position = keys[stays], position[stays]
            yield size, position, keys


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.uint32)


def lowered(support: int, tokens: int, total: int) -> int:
    """The support of a shard: its share of the support, rounded up."""
    return max(1, -(-support * tokens // total))


def _sent(row: dict, least: int, keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
    for r, k, c in questions(keys, counts, cuts):
        yield r, row["shard"], least - 1, row["base"], k, c


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _of_length(shard: Shard, length: int, sieves: list) -> np.ndarray:
    """The keys of the shard's phrases of one length; the shorter ones go through their sieves."""
    keys = shard.keys[:0]
    for _, _, keys in shard.phrases(lambda size, keys: Sieve(sieves[size - 1].value).may(keys) if size < length else None, length):
        pass
    return keys


def unsent(stored: DataFrame, totals: DataFrame, support: int) -> DataFrame:
    """(lang, total, base): all tokens of each language, and how many of a phrase its shards can have together without
    sending it, one less than the lowered support each."""
    most = F.greatest(F.expr(f"({support} * tokens + total - 1) div total"), F.lit(1)) - 1
    return stored.select("lang", "tokens").join(totals.where("total > 0"), "lang").groupBy("lang", "total").agg(F.sum(most).alias("base"))


def mined(shards_of: DataFrame, sieves: list, support: int, length: int, ranges: int) -> DataFrame:
    """The locally frequent phrases of one length of every shard, with their counts there.

    ``sieves`` are those of the shorter phrases that are frequent overall, by length.
    """
    cuts = shard_cuts(ranges)

    def work(batches):
        for row in _rows(batches):
            least = lowered(support, row["tokens"], row["total"])
            keys, counts = _counted(_of_length(Shard(row), length, sieves))
            often = counts >= least
            yield from sliced_rows(_sent(row, least, keys[often], counts[often], cuts), arrow_schema(SENT))

    return map_arrow(shards_of, work, SENT)


def recounted(shards_of: DataFrame, sieves: list, sieve, support: int, length: int, ranges: int) -> DataFrame:
    """The counts of phrases of one length that may be candidates, in the shards in which they are not locally frequent."""
    cuts = shard_cuts(ranges)

    def work(batches):
        for row in _rows(batches):
            least = lowered(support, row["tokens"], row["total"])
            if least == 1:  # all has been sent
                continue
            keys = _of_length(Shard(row), length, sieves)
            keys, counts = _counted(keys[Sieve(sieve.value).may(keys)])
            seldom = counts < least
            yield from sliced_rows(_sent(row, least, keys[seldom], counts[seldom], cuts), arrow_schema(SENT))

    return map_arrow(shards_of, work, SENT)


def _by_range(sent: DataFrame) -> DataFrame:
    return sent.repartition(shuffle_partitions(sent.sparkSession), "range").sortWithinPartitions("range")


def _merged(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of packed ones, the order of all, and where each begins in it."""
    every = np.concatenate([np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in keys])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], order, first


def possible(sent: DataFrame, support: int) -> DataFrame:
    """The candidates of every range: keys, what has been counted of them, and the least shard in which each is locally frequent."""
    def work(batches):
        for asked in shard_groups(batches, ("range",)):
            every, order, first = _merged([r["keys"] for r in asked])
            counts = [from_planes(r["counts"], np.uint32).astype(np.int64) for r in asked]
            size = [len(c) for c in counts]
            sums = np.add.reduceat(np.concatenate(counts)[order], first)
            unsent = np.add.reduceat(np.repeat(np.array([r["unsent"] for r in asked]), size)[order], first)
            # All senders of a phrase are shards of its language.
            base = np.repeat(np.array([r["base"] for r in asked]), size)[order[first]]
            hit = sums + base - unsent >= support
            least = np.minimum.reduceat(np.repeat(np.array([r["shard"] for r in asked]), size)[order], first)
            yield batch(arrow_schema(CANDIDATES), [
                [asked[0]["range"]], [planes(np.diff(every[hit], prepend=np.uint64(0)))], [planes(sums[hit])],
                [planes(least[hit])], [int(hit.sum())]])

    return map_arrow(_by_range(sent), work, CANDIDATES)


def sieve_parts(candidates: DataFrame, size: int) -> DataFrame:
    """The sieve of all candidates, in parts of each task."""
    def work(batches):
        held = Sieve.empty(size)
        for b in batches:
            for keys in b.column("keys"):
                held.add(np.cumsum(from_planes(keys.as_py(), np.uint64), dtype=np.uint64))
        yield from sliced_rows(held.parts(), arrow_schema(PARTS))

    return map_arrow(candidates.select("keys"), work, PARTS)


def frequent(candidates: DataFrame, again: DataFrame, support: int) -> DataFrame:
    """(key, f, shard) of every candidate with the support, and the least shard in which it is locally frequent."""
    def work(batches):
        for told in shard_groups(batches, ("range",)):
            every, order, first = _merged([r["keys"] for r in told])
            counts = [from_planes(r["counts"], np.uint32 if r["shards"] is None else np.int64) for r in told]
            # A shard that only counted again can neither make a candidate nor write it down.
            shard = [np.full(len(c), np.iinfo(np.int64).max) if r["shards"] is None else from_planes(r["shards"], np.int64)
                     for r, c in zip(told, counts)]
            sums = np.add.reduceat(np.concatenate(counts)[order], first, dtype=np.int64)
            least = np.minimum.reduceat(np.concatenate(shard)[order], first)
            hit = np.flatnonzero((sums >= support) & (least < np.iinfo(np.int64).max))
            for at in range(0, len(hit), 1 << 16):
                part = hit[at:at + (1 << 16)]
                yield batch(arrow_schema(FREQUENT), [every[part].view(np.int64), sums[part], least[part]])

    columns = ("range", "keys", "counts", "shards")
    rest = again.select("range", "keys", "counts", F.lit(None).cast("binary").alias("shards"))
    return map_arrow(_by_range(candidates.where("found > 0").select(*columns).union(rest)), work, FREQUENT)


def nominated(found: DataFrame) -> DataFrame:
    """The key of (phrase, shard that writes it down) for each frequent phrase."""
    def work(batches):
        for b in batches:
            keys = _written_by(b.column("key").to_numpy().view(np.uint64), b.column("shard").to_numpy())
            yield batch(arrow_schema("key long"), [keys.view(np.int64)])

    return map_arrow(found, work, "key long")


def frequent_by_length(shards_of: DataFrame, scratch: Scratch, support: int, longest: int, ranges: int) -> tuple[DataFrame, list]:
    """(key, f, shard) of all frequent phrases, and their broadcast sieves by length; lengths end where nothing is frequent."""
    context, found, sieves = shards_of.sparkSession.sparkContext, [], []
    for length in range(1, longest + 1):
        candidates = scratch.keep(possible(mined(shards_of, sieves, support, length, ranges), support), "candidates")
        size = Sieve.size(candidates.agg(F.sum("found")).first()[0] or 0)
        sieve = context.broadcast(joined(sieve_parts(candidates, size), size))
        again = recounted(shards_of, sieves, sieve, support, length, ranges)
        found.append(scratch.keep(frequent(candidates, again, support), "frequent"))
        scratch.remove(candidates)
        sieve.unpersist()
        count = found[-1].count()
        sieves = [*sieves, context.broadcast(sieve_of(found[-1], count))]
        if not count:
            break
    return reduce(DataFrame.union, found), sieves


def written(stored: DataFrame, sieves: list, writers) -> DataFrame:
    """The words of frequent phrases of two words and more, and the keys of both parts of every cut, by the shards that
    are named; now and then by another one too."""
    def work(batches):
        for row in _rows(batches):
            shard, often, mine = Shard(row), [Sieve(x.value) for x in sieves], Sieve(writers.value)

            def rows():
                held = []
                for size, position, keys in shard.phrases(lambda size, keys: often[size - 1].may(keys), len(often)):
                    held.append((position, keys))
                    if size == 1:
                        continue
                    every, at = np.unique(keys, return_index=True)
                    here = mine.may(_written_by(every, np.full(len(every), shard.id)))
                    every, place = every[here].view(np.int64), position[at[here]]

                    def part(length, shift):
                        positions, own = held[length - 1]
                        return own[np.searchsorted(positions, place + shift)].view(np.int64)

                    lefts = np.stack([part(k, 0) for k in range(1, size)], 1).tolist()
                    rights = np.stack([part(size - k, k) for k in range(1, size)], 1).tolist()
                    for key, p, left, right in zip(every.tolist(), place.tolist(), lefts, rights):
                        text = b" ".join(shard.words[n - 1] for n in shard.numbers[p:p + size].tolist())
                        yield key, shard.lang, text.decode(), left, right
            yield from sliced_rows(rows(), arrow_schema(WRITTEN))

    return map_arrow(stored, work, WRITTEN)


def score(a: str, n: str, left: str, right: str, scale: int = SCALE):
    """``floor(scale * a * n / (left * right))`` in decimals of 38 digits."""
    wide = "CAST({} AS DECIMAL(18, 0))".format
    return F.expr(f"CAST({scale} AS DECIMAL(1{len(str(scale))}, 0)) * {wide(a)} * {wide(n)} div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, scratch: Scratch, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP,
                 percent: int = PERCENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. A phrase of 2 to
    ``longest`` words counts ``a`` times, overlaps included; ``l`` and ``r`` are the counts of the parts of its
    lowest-scoring cut, ``n`` all words of the language. Phrases below the support, and those in a longer one that counts
    ``percent`` of their own count at least, are left out.

    Null languages are ``und``, null texts empty; repeated rows count. Ties rank by count, then by the bytes of the phrase.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    stored = scratch.keep(shards(docs, shard_bytes), "shards")
    totals = scratch.keep(stored.groupBy("lang").agg(F.sum("tokens").alias("total")), "totals")
    tokens = totals.agg(F.sum("total")).first()[0] or 0
    ranges = max(1, math.ceil(tokens / RANGE_KEYS))
    placed = stored.join(scratch.keep(unsent(stored, totals, support), "unsent"), "lang")
    found, sieves = frequent_by_length(placed, scratch, support, longest, ranges)
    writers = spark.sparkContext.broadcast(sieve_of(nominated(found), found.count()))
    counts = found.select("key", "f")
    phrases = scratch.keep(written(stored, sieves, writers).join(counts.withColumnRenamed("f", "a"), "key")
                           .dropDuplicates(["key"]), "phrases")

    # A longer phrase covers a shorter one if one that is a word longer does, for counts only fall.
    inner = phrases.where(F.size("lefts") > 1).select(
        F.explode(F.array(F.element_at("lefts", -1), F.element_at("rights", 1))).alias("key"), "a")
    covered = inner.groupBy("key").agg(F.max("a").alias("longer"))
    stays = scratch.keep(phrases.join(covered, "key", "left").where(
        F.expr(f"longer IS NULL OR 100 * longer < {percent} * a")).drop("longer"), "not-covered")
    cut = stays.select("key", "lang", "phrase", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut"))
    cut = cut.select("key", "lang", "phrase", "a", "k", F.col("cut.lefts").alias("left"), F.col("cut.rights").alias("right"))
    sides = (cut.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
             .join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
             .join(totals.withColumnRenamed("total", "n"), "lang"))
    scored = scratch.keep(sides.select("key", "lang", "phrase", "a", "n", F.struct(
        score("a", "n", "l", "r").alias("score"), "k", "l", "r").alias("cut")), "cuts")
    least = scored.groupBy("key").agg(*[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")], F.min("cut").alias("cut"))
    return ranked(least.select("lang", "phrase", "a", "n", "cut.*"), top)


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first phrases of every language: first of parts of each, then of these together."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[
        F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
