"""Log-probabilities of texts by a weighted backoff automaton.

States are the contexts that the training text has seen: the empty one, every word and every pair of words after which
something came (the start of a text is a word too). A seen n-gram is an arc from the state of all its words but the last to
the state of its longest seen ending. Every other word takes the failure arc to the state with one word less, once or
twice, until some arc fits; the weights of arcs and failure arcs make the probabilities of a state add up to one:

    arc      (c(h w) + K p(w | h')) / (c(h) + K)
    failure  K / (c(h) + K)

with h' the context without its first word, the base measure at the empty one, and a K for each length of context. One
traversal from left to right carries the state and adds up weights. Long texts are traversed as lanes side by side: what was
seen before a lane tells its first state, as every ending of a seen n-gram is seen too.

Counting and looking up are one exchange: blocks (``blocks.py``) send the hashes of their distinct words, pairs and
triples with their own training counts, split by range; every shard adds them up and answers each
block with the totals in the order of the question.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.blocks import blocks, from_planes, planes, questions, shard_cuts, shard_groups, totals
from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, utf8
from orderlens.session import Scratch

FOLDS, HELD_OUT = 5, 1
#: Words of the longest n-grams; K of the formula above for contexts of one word and of two, chosen on another fold of the training
#: texts of sf0.1 (id remainder 2, learnt from the other three).
LONGEST, STRENGTHS = 3, (3000.0, 5.0)
#: Positions of a lane.
LANE = 512
#: Shards for each shuffle partition: a task adds up one shard at a time.
SHARDS = 4

# What no word can be: it has a blank.
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")

STORED = "block long, documents int, ids binary, held binary, lengths binary, numbers binary, hashes binary"
ASKED = "shard int, size int, block long, keys binary, counts binary"
ANSWER = "shard int, size int, block long, counts binary, total long, distinct long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of word hashes."""
    x = second + np.uint64(0x7F4A7C159E3779B9)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= first * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def held_out(id_column: str = "doc_id", remainder: int = HELD_OUT):
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS)) == remainder, F.lit(False))


def stored_blocks(docs: DataFrame, remainder: int = HELD_OUT) -> DataFrame:
    def work(batches):
        for number, held in blocks(batches, lambda data: data.lower().split(), ("doc_id", "held")):
            def by_count(words, counts):
                new = np.empty(len(words), np.int64)
                new[np.argsort(-counts, kind="stable")] = np.arange(len(words))
                return new

            words, new, numbers = held.ranked(by_count)
            hashes = np.empty(len(words), np.uint64)
            hashes[new] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            ids = np.array([-1 << 63 if x is None else x for x, _ in held.ids], np.int64)
            yield batch(arrow_schema(STORED), [
                [number], [len(ids)], [planes(ids)], [np.array([h for _, h in held.ids], np.uint8).tobytes()],
                [planes(held.lengths())], [planes(numbers)], [hashes.tobytes()]])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), held_out(remainder=remainder).alias("held"))
    return map_arrow(source, work, STORED)


class Positions:
    """The positions of a block's texts: a word or the end each. Keys of longer n-grams are made when they are asked for."""

    def __init__(self, word: np.ndarray, lengths: np.ndarray, training: np.ndarray):
        self.word, self.lengths = word, lengths
        self.ends = np.cumsum(lengths)
        self.first = np.zeros(len(word), bool)
        self.first[self.ends - lengths] = True
        self.training = np.repeat(training, lengths)
        self.starts = training

    @classmethod
    def of(cls, row: dict) -> Positions:
        lengths = from_planes(row["lengths"], np.uint32).astype(np.int64) + 1
        inner = np.ones(int(lengths.sum()), bool)
        inner[np.cumsum(lengths) - 1] = False
        word = np.full(len(inner), END, np.uint64)
        word[inner] = np.frombuffer(row["hashes"], np.uint64)[from_planes(row["numbers"], np.uint32)]
        return cls(word, lengths, ~np.frombuffer(row["held"], np.uint8).astype(bool))

    def keys(self, size: int) -> np.ndarray:
        """The n-gram that ends at each position; the first of a text ends none of three words. With the words, the start of
        every text comes last."""
        if size == 1:
            return np.concatenate([self.word, np.full(len(self.starts), START, np.uint64)])
        before = np.concatenate([np.array([START], np.uint64), self.word[:-1]])
        before[self.first] = START
        pair = pair_keys(before, self.word)
        if size == 2:
            return pair
        del before
        inner = ~self.first
        return pair_keys(pair[:-1][inner[1:]], self.word[inner])

    def ranked(self, size: int) -> tuple[int, np.ndarray]:
        """How many distinct keys there are, and the place in their order of each n-gram."""
        _, order, new = self._sorted(size)
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        return int(np.count_nonzero(new)), place

    def _sorted(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, the place each has come from, and whether it differs from the one before."""
        keys = self.keys(size)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return keys, order, new

    def questions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often this block's training texts have them.
        The start of texts is asked for with the words."""
        keys, order, new = self._sorted(size)
        counted = self.training[~self.first] if size == 3 else self.training
        if size == 1:
            counted = np.concatenate([counted, self.starts])
        counted = counted[order]
        del order
        first = np.flatnonzero(new)
        return keys[first], np.add.reduceat(counted, first, dtype=np.uint32) if len(first) else np.empty(0, np.uint32)


def counted(stored: DataFrame, shards: int) -> DataFrame:
    """Answers to the questions of all blocks, and the totals of every shard (block -1)."""
    cuts = shard_cuts(shards)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                here = Positions.of(row)
                for size in range(1, LONGEST + 1):
                    for shard, keys, counts in questions(*here.questions(size), cuts):
                        yield batch(arrow_schema(ASKED), [[shard], [size], [row["block"]], [keys], [counts]])

    def add(batches):
        for asked in shard_groups(batches, ("shard", "size")):
            every, sums, own = totals([(r["keys"], r["counts"]) for r in asked])
            shard, size = asked[0]["shard"], asked[0]["size"]
            for r, counts in zip(asked, own):
                yield batch(arrow_schema(ANSWER), [[shard], [size], [r["block"]], [planes(counts)], [0], [0]])
            if size == 1:
                tokens = sums[every != np.uint64(START)]
                yield batch(arrow_schema(ANSWER), [[shard], [size], [-1], [b""], [int(tokens.sum())], [int((tokens > 0).sum())]])

    dealt = map_arrow(stored, ask, ASKED).repartition(shuffle_partitions(stored.sparkSession), "shard") \
        .sortWithinPartitions("shard", "size")
    return map_arrow(dealt, add, ANSWER)


class Automaton:
    """States, arcs and failure arcs that a block's texts can meet: state 0 is the empty context, then come those of one word,
    then those of two."""

    def __init__(self, here: Positions, counts: list[np.ndarray], total: int, distinct: int,
                 strengths: tuple[float, ...] = STRENGTHS):
        """``counts`` are the totals of the distinct words, pairs and triples of ``here``, in order."""
        self.here = here
        # Where each position's n-grams stand in the lists of distinct ones, and the start of texts, if there is any.
        (words, word), (pairs, self.pair), (triples, triple) = (here.ranked(size) for size in (1, 2, 3))
        self.words, self.seen_words, self.seen_pairs, self.seen_triples = words, *(c > 0 for c in counts)
        self.word, start = word[:len(here.word)], int(word[-1]) if len(word) else 0
        before = np.concatenate([np.array([start], np.int32), self.word[:-1]])
        before[here.first] = start
        inner = ~here.first
        self.triple = np.zeros(len(here.word), np.int32)
        self.triple[inner] = triple

        self.root = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
        self.start = 1 + start if words and self.seen_words[start] else 0

        def of_each(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros(n, values.dtype)
            out[where] = values
            return out

        def weighed(counts, strength, shorter, context):
            """log10((counts + strength * 10 ** shorter) / (context + strength)), with few arrays at a time."""
            out = np.power(10.0, shorter)
            out *= strength
            out += counts
            out /= context + strength
            return np.log10(out, out=out)

        first, last = of_each(self.pair, before, pairs), of_each(self.pair, self.word, pairs)
        del before
        self.shorter = np.concatenate([np.zeros(1 + words, np.int32), np.where(self.seen_words[last], 1 + last, np.int32(0))])
        root, context = self.root[last], counts[0][first]
        del first, last
        self.pair_weight = weighed(counts[1], strengths[0], root, context)
        # What a pair weighs in the state of its first word, seen or not.
        whole = np.where(context > 0, self.pair_weight, root)
        del root, context
        context = counts[1][of_each(triple, self.pair[:-1][inner[1:]], triples)]
        whole = whole[of_each(triple, self.pair[inner], triples)]
        self.triple_weight = weighed(counts[2], strengths[1], whole, context)
        del whole, context
        self.failure = np.concatenate([[0.0], np.log10(strengths[0] / (counts[0] + strengths[0])),
                                       np.log10(strengths[1] / (counts[1] + strengths[1]))])

    def ending(self, at: np.ndarray) -> np.ndarray:
        """The state after positions: that of their longest seen ending."""
        word = np.where(self.seen_words[self.word[at]], 1 + self.word[at], 0)
        return np.where(self.seen_pairs[self.pair[at]], 1 + self.words + self.pair[at], word)

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, new states) of reading the words at some positions, each in its state."""
        weight = np.zeros(len(at))
        taken = (state > self.words) & self.seen_triples[self.triple[at]] if len(self.seen_triples) else np.zeros(len(at), bool)
        weight[taken] = self.triple_weight[self.triple[at[taken]]]
        failed = (state > self.words) & ~taken
        weight += np.where(failed, self.failure[state], 0.0)
        state = np.where(failed, self.shorter[state], state)
        single = (state > 0) & ~taken & self.seen_pairs[self.pair[at]]
        weight[single] += self.pair_weight[self.pair[at[single]]]
        failed = (state > 0) & ~taken & ~single
        weight += np.where(failed, self.failure[state], 0.0)
        empty = ~taken & ~single
        weight[empty] += self.root[self.word[at[empty]]]
        onward = np.where(self.seen_words[self.word[at]], 1 + self.word[at], 0)
        return weight, np.where(empty, onward, 1 + self.words + self.pair[at])

    def traverse(self, lane: int = LANE) -> np.ndarray:
        """The weight of every position."""
        here, n = self.here, len(self.here.word)
        begin = np.arange(0, n, lane)
        state = np.append(0, self.ending(begin[1:] - 1))
        out = np.empty(n)
        for t in range(min(lane, n)):
            at = begin + t
            if at[-1] >= n:
                at, begin, state = at[:-1], begin[:-1], state[:-1]
            state = np.where(here.first[at], self.start, state)
            out[at], state = self.step(state, at)
        return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


def score(docs: DataFrame, scratch: Scratch, strengths: tuple[float, ...] = STRENGTHS, remainder: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows
    that are not held out, those whose id has the ``remainder``.

    Null texts are empty and consist of their end. Null ids are in no fold, so they train. Repeated rows
    count and are scored each. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    stored = scratch.keep(stored_blocks(docs, remainder), "blocks")
    answers = scratch.keep(counted(stored, partitions * SHARDS), "answers")
    sums = answers.where("block = -1").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = sums.total or 0, sums.distinct or 0
    own = stored.select("block", F.lit(LONGEST + 1).alias("size"), F.lit(0).alias("shard"), F.lit(None).cast("binary").alias("counts"),
                        *stored.columns[1:])
    told = answers.where("block >= 0").select("block", "size", "shard", "counts", *[
        F.lit(None).cast(t).alias(c) for c, t in stored.dtypes[1:]])
    dealt = told.union(own).repartitionByRange(partitions, "block").sortWithinPartitions("block", "size", "shard")

    def work(batches):
        held: dict[int, list] = {size: [] for size in range(1, LONGEST + 1)}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["size"] <= LONGEST:
                    held[row["size"]].append(_narrow(from_planes(row["counts"], np.int64)))
                    continue
                here, ids = Positions.of(row), from_planes(row["ids"], np.int64).tolist()
                del row
                counts = [np.concatenate([np.empty(0, np.uint32), *held.pop(size)]) for size in sorted(held)]
                held = {size: [] for size in range(1, LONGEST + 1)}
                automaton = Automaton(here, counts, total, distinct, strengths)
                del counts
                first = here.ends - here.lengths
                score = np.add.reduceat(automaton.traverse(), first)
                base = np.add.reduceat(automaton.root[automaton.word], first)
                known = np.add.reduceat(automaton.seen_words[automaton.word], first, dtype=np.int64)
                yield batch(arrow_schema(RESULT), [
                    [None if x == -1 << 63 else x for x in ids], ~here.starts, here.lengths, known,
                    np.full(len(ids), total, np.int64), base, score])
                del here, automaton

    return map_arrow(dealt, work, RESULT)
