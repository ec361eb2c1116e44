"""Sieves: sets of 64-bit keys of bounded size that may hold more than they were given, never less."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from orderlens.llm.blocks import shard_groups
from orderlens.llm.common import arrow_schema, map_arrow, shuffle_partitions, sliced_rows

#: Most bytes of a sieve, and words that travel together.
SIEVE_BYTES, PART = 16 << 20, 4096
#: Keys that are looked up at once.
AT_ONCE = 1 << 18
#: Words of a sieve that comes to the driver at once; those of a larger one come part after part.
SMALL = 1 << 18
PARTS = "part int, words binary"


class Sieve:
    """Four bits of each key in the 64-bit word that the key's upper bits name. A sieve that is too small for its keys
    lets more through."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - int(len(words)).bit_length() + 1)

    @staticmethod
    def size(keys: int, most: int = SIEVE_BYTES) -> int:
        """Words for so many keys, a power of two: 16 bits a key, as far as ``most`` bytes allow."""
        return 1 << max(1, min((most // 8).bit_length() - 1, math.ceil(math.log2(max(1, keys) / 4 + 1))))

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(keys), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
        return mask

    @classmethod
    def empty(cls, size: int) -> Sieve:
        return cls(np.zeros(size, np.uint64))

    def add(self, keys: np.ndarray) -> Sieve:
        for at in range(0, len(keys), AT_ONCE):
            part = keys[at:at + AT_ONCE]
            np.bitwise_or.at(self.words, (part >> self.shift).astype(np.int64), self._bits(part))
        return self

    def may(self, keys: np.ndarray) -> np.ndarray:
        found = np.empty(len(keys), bool)
        for at in range(0, len(keys), AT_ONCE):
            part = keys[at:at + AT_ONCE]
            mask = self._bits(part)
            found[at:at + AT_ONCE] = (self.words[(part >> self.shift).astype(np.int64)] & mask) == mask
        return found

    def parts(self):
        """(part, words) of all parts that are not empty."""
        for at in range(0, len(self.words), PART):
            part = self.words[at:at + PART]
            if part.any():
                yield at // PART, part.tobytes()


def joined(parts: DataFrame, size: int) -> np.ndarray:
    """The words of a sieve of tasks' partial ones; a whole sieve has at most ``SIEVE_BYTES``."""
    def work(batches):
        def rows():
            for group in shard_groups(batches, ("part",)):
                held = np.frombuffer(group[0]["words"], np.uint64).copy()
                for r in group[1:]:
                    held |= np.frombuffer(r["words"], np.uint64)
                yield group[0]["part"], held.tobytes()
        yield from sliced_rows(rows(), arrow_schema(PARTS))

    dealt = parts.repartition(shuffle_partitions(parts.sparkSession), "part").sortWithinPartitions("part")
    words = np.zeros(size, np.uint64)
    merged = map_arrow(dealt, work, PARTS)
    for row in merged.collect() if size <= SMALL else merged.toLocalIterator():
        part = np.frombuffer(bytes(row.words), np.uint64)
        words[row.part * PART:row.part * PART + len(part)] = part
    return words


def sieve_of(keys: DataFrame, count: int, column: str = "key") -> np.ndarray:
    """The words of the sieve of a column of longs, of which there are ``count``."""
    size = Sieve.size(count)

    def work(batches):
        held = Sieve.empty(size)
        for b in batches:
            held.add(b.column(0).to_numpy().view(np.uint64))
        yield from sliced_rows(held.parts(), arrow_schema(PARTS))

    return joined(map_arrow(keys.select(column), work, PARTS), size)
