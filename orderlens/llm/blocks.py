"""Documents as blocks of word numbers, and questions about words that blocks ask in shards.

A block holds whole documents of one task, about ``BLOCK`` bytes of text, as numbers into its own list of
distinct words. It asks for what it needs to know about each distinct word (or pair of words) once,
packed by shard: one row for each block and shard, whose values lie together. Answers come back in the order of the
questions. So rows cross the network for distinct words of a block, not for every position,
and a word that makes up a third of all text is one question of each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import TaskContext

BLOCK = 16 << 20


def planes(values: np.ndarray) -> bytes:
    """Little-endian numbers with all their first bytes together, then all second ones, and so on."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


class Block:
    """Word numbers of documents, in order of first appearance until they are ranked."""

    def __init__(self):
        self.words: dict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids, self.numbers, self.weight = [], [], 0

    def add(self, key: tuple, words: list, weight: int) -> None:
        self.ids.append(key)
        self.numbers.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.weight += weight

    def ranked(self, order: Callable[[list, np.ndarray], np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
        """(words, new number of each old one, all numbers); ``order`` numbers the words anew."""
        words = list(self.words)
        every = np.concatenate(self.numbers) if self.numbers else np.empty(0, np.uint32)
        new = order(words, np.bincount(every, minlength=len(words))).astype(np.uint32)
        return words, new, new[every] if len(every) else every

    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.numbers], np.uint32)


def blocks(batches: Iterable, words_of: Callable[[bytes], list], keys: tuple[str, ...] = ("doc_id",),
           most: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """Number and content of each block of one task, from batches of ``keys`` and text; a document is
    known by the tuple of its keys."""
    number, held = TaskContext.get().partitionId() << 24, Block()
    for b in batches:
        for key, text in zip(zip(*(b.column(k).to_pylist() for k in keys)), b.column("text")):
            data = text.as_py()
            held.add(key, words_of(data), len(data))
            if held.weight >= most:
                yield number, held
                number, held = number + 1, Block()
    if held.ids:
        yield number, held


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else starts
    return values[np.arange(total) + shift] if total else values[:0]


def shard_cuts(shards: int) -> np.ndarray:
    """The least 64-bit key of every shard but the first."""
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


def distinct_keys(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights."""
    if not len(keys):
        return keys, np.empty(0, np.uint32)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first, dtype=np.uint32)


def questions(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, packed keys, packed counts) for distinct keys in order."""
    at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    for shard, (x, y) in enumerate(zip(at, at[1:])):
        if y > x:
            yield shard, planes(np.diff(keys[x:y], prepend=np.uint64(0))), planes(counts[x:y])


def totals(asked: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys of one shard's questions, their summed counts, and the sums in the order of each question."""
    keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k, _ in asked]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.concatenate([from_planes(c, np.uint32) for _, c in asked])[order]
    sums, every = np.add.reduceat(counts, first, dtype=np.int64), every[first]
    return every, sums, [sums[np.searchsorted(every, k)] for k in keys]


def shard_groups(batches: Iterable, keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of one shard after the other, from batches sorted by integer ``keys``."""
    held: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            if held and any(held[-1][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held
