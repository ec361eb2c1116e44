"""Spelling variants by k-d trees over letter-count vectors.

A word is the vector of how often it has each letter. One inserted or deleted letter moves that vector by one, a replaced
one by two (one letter less, another more), so words that are one edit apart lie within an L1 distance of two.
The words of each length lie in the boxes of a k-d tree. A word searches the tree of its own length for distance two
and the tree of the next length for distance one; a box is left out if it is farther away than that. What a box
holds is searched in the task by a k-d tree of its own down to boxes of ``SMALL`` words, whose vectors are compared,
and pairs at the very distance are verified by the order of their letters.

The cuts of a length's tree are chosen on at most ``SAMPLE`` words of all, so that a box holds about ``BOX``
words; every word lies in a box whatever the cuts. A box of more than ``CHUNK`` words is divided into chunks
by word, and who searches the box searches each. Tasks return, per word, how many near words a box has and the most
frequent of them, never pairs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, utf8
from orderlens.session import Scratch

LETTERS, COUNT, RATIO, DROP = 6, 5, 5, 199
SAMPLE, BOX, CHUNK, SMALL = 200_000, 4096, 16_384, 32
#: Searching words that are compared with a chunk at once.
SEARCHING = 8192
#: Distinct words that a task holds before it sends their counts.
HELD = 1 << 20

# Latin-1 bytes of the letters U+0041 to U+005A, U+0061 to U+007A and U+00C0 to U+00FF, A-Z lower-cased; all others blank.
_CLEAN = bytes(c if c >= 0xC0 or 0x61 <= c <= 0x7A else 0x20 for c in bytes(range(256)).lower())


def runs_of(text: bytes) -> list[bytes]:
    """The runs of letters of a text in UTF-8, as Latin-1."""
    return text.decode().encode("latin-1", "replace").translate(_CLEAN).split()


def altered(doc_id: str, runs: list[bytes], drop: int = DROP) -> list[tuple[bytes, bytes]]:
    """The distinct runs of a document that lose a letter, and what is left of them."""
    prefix = zlib.crc32(doc_id.encode() + b":")
    hashes = map(zlib.crc32, b"\n".join(runs).decode("latin-1").encode().split(b"\n"), repeat(prefix))
    return [(w, w[:h % len(w)] + w[h % len(w) + 1:]) for w, h in zip(runs, hashes) if h % drop == 0]


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = COUNT, drop: int = DROP) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur ``least`` times."""
    def work(batches):
        held: Counter = Counter()

        def sent():
            words = list(held)
            for at in range(0, len(words), 1 << 16):
                part = words[at:at + (1 << 16)]
                yield batch(arrow_schema("word string, n long"),
                            [b"\n".join(part).decode("latin-1").split("\n"), [held[w] for w in part]])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                # A shorter run stays too short, whether it loses a letter or not.
                runs = [w for w in runs_of(text.as_py()) if len(w) >= letters]
                if not runs:
                    continue
                held.update(runs)
                for word, rest in altered(doc_id, list(set(runs)), drop):
                    n = runs.count(word)
                    held[word] -= n
                    if not held[word]:
                        del held[word]
                    if len(rest) >= letters:
                        held[rest] += n
                if len(held) >= HELD:
                    yield from sent()
                    held.clear()
        yield from sent()

    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), utf8().alias("text"))
    counted = map_arrow(source, work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def vectors(words: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length (rows of Latin-1 bytes): 26 letters a-z, then U+00C0 to U+00FF."""
    places = np.where(words >= 0xC0, words.astype(np.int64) - (0xC0 - 26), words.astype(np.int64) - 0x61)
    flat = (np.arange(len(words))[:, None] * 90 + places).ravel()
    return np.bincount(flat, minlength=len(words) * 90).reshape(len(words), 90).astype(np.int16)


def matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def widest_cut(v: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) that divides vectors most evenly: those with at most that count lie low."""
    low = v.min(0)
    best = None
    for d in np.flatnonzero(v.max(0) > low):
        at = np.bincount(v[:, d]).cumsum()
        cut = int(np.abs(2 * at[:-1] - len(v)).argmin())
        badness = abs(2 * int(at[cut]) - len(v))
        if best is None or badness < best[0]:
            best = badness, int(d), cut
    return best and best[1:]


class Boxes:
    """The cuts of one length's k-d tree: nested (letter, count, low, high), or the number of a box."""

    def __init__(self, sample: np.ndarray, share: float, box: int = BOX):
        self.size = 0

        def divided(v):
            cut = widest_cut(v) if len(v) * share > box and len(v) > 1 else None
            if not cut:
                self.size += 1
                return self.size - 1
            low = v[:, cut[0]] <= cut[1]
            return (*cut, divided(v[low]), divided(v[~low]))

        self.root = divided(sample)

    def reached(self, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) of every box that vectors within an L1 distance can lie in."""
        rows, boxes = [], []

        def away(at, letter, bounds):
            low, high = bounds.get(letter, (0, np.iinfo(np.int16).max))
            x = v[at, letter].astype(np.int64)
            return np.maximum(low - x, 0) + np.maximum(x - high, 0)

        def down(node, at, spent, bounds):
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at), boxes.append(np.full(len(at), node))
                return
            letter, cut, *sides = node
            low, high = bounds.get(letter, (0, np.iinfo(np.int16).max))
            before = away(at, letter, bounds)
            for side, narrower in zip(sides, ((low, min(high, cut)), (max(low, cut + 1), high))):
                inner = {**bounds, letter: narrower}
                cost = spent - before + away(at, letter, inner)
                near = cost <= radius
                down(side, at[near], cost[near], inner)

        down(self.root, np.arange(len(v)), np.zeros(len(v), np.int64), {})
        none = np.empty(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *boxes])


def close(stored: np.ndarray, searching: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(stored row, searching row) of all vectors at the L1 distance ``radius``, by a k-d tree with boxes that fit."""
    found = []

    def down(rows, at):
        v = stored[rows]
        low, high = v.min(0), v.max(0)
        q = searching[at]
        away = (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(1)
        at = at[away <= radius]
        if not len(at):
            return
        cut = widest_cut(v) if len(rows) > SMALL else None
        if cut:
            side = v[:, cut[0]] <= cut[1]
            down(rows[side], at)
            down(rows[~side], at)
            return
        used = np.flatnonzero(high > 0)
        q = searching[at]
        # Letters that no vector here has count whole.
        rest = q.sum(1) - q[:, used].sum(1)
        q = np.ascontiguousarray(q[:, used])
        kinds, own = np.unique(v[:, used], axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        start = np.append(0, np.bincount(own.ravel(), minlength=len(kinds)).cumsum())
        for i, kind in enumerate(kinds):  # words of one vector are compared once
            hit = at[np.abs(q - kind).sum(1) + rest == radius]
            same = rows[order[start[i]:start[i + 1]]]
            if len(hit):
                found.append((same, hit))

    if len(stored) and len(searching):
        down(np.arange(len(stored)), np.arange(len(searching)))
    return found


def verified(stored: np.ndarray, searching: np.ndarray, same: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words whose vectors fit, the pairs that are one edit apart. Searching words are as long, or one letter shorter."""
    length = searching.shape[1]
    x, y = [], []
    for at in range(0, len(hit), max(1, (1 << 18) // len(same))):
        part = hit[at:at + max(1, (1 << 18) // len(same))]
        a, b = np.repeat(same, len(part)), np.tile(part, len(same))
        if stored.shape[1] == length:
            near = (stored[a] != searching[b]).sum(1) == 1
        else:
            front = np.cumprod(stored[a, :length] == searching[b], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
            back = np.cumprod((stored[a, 1:] == searching[b])[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
            near = front + back >= length
        x.append(a[near]), y.append(b[near])
    return np.concatenate(x), np.concatenate(y)


class Near:
    """Near words of some words: how many, and the most frequent one, ties to the first in code-point order."""

    def __init__(self, words: list[str]):
        self.words = words
        self.count = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, rows: np.ndarray, n: np.ndarray, words: list[str]) -> None:
        np.add.at(self.count, rows, 1)
        for row, number, word in zip(rows.tolist(), (-n).tolist(), words):
            known = self.best.get(row)
            if known is None or (number, word) < known:
                self.best[row] = number, word

    def rows(self):
        at = sorted(self.best)
        if at:
            yield batch(arrow_schema("word string, near long, best_n long, best string"),
                        [[self.words[i] for i in at], self.count[at], [-self.best[i][0] for i in at], [self.best[i][1] for i in at]])


def _groups(batches, keys):
    """(key values, batches of rows with them) of batches sorted by whole numbers."""
    held, key = [], None
    for b in batches:
        columns = [b.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)])) if b.num_rows else []
        for s, e in zip(change, [*change[1:], b.num_rows]):
            own = tuple(int(c[s]) for c in columns)
            if key is not None and own != key:
                yield key, held
                held = []
            key = own
            held.append(b.slice(s, e - s))
    if held:
        yield key, held


def near_words(words: DataFrame, scratch: Scratch, sample: int = SAMPLE, box: int = BOX, chunk: int = CHUNK) -> DataFrame:
    """(word, near, best_n, best): for each word with near ones, how many, and the most frequent.

    ``words`` has distinct words (Latin-1 letters) and counts n.
    """
    spark = words.sparkSession
    total = words.count()
    part = words if total <= sample else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    sampled: dict[int, list[str]] = {}
    for row in part.select("word").toLocalIterator():
        sampled.setdefault(len(row.word), []).append(row.word)
    share = max(1.0, total / max(1, sum(map(len, sampled.values()))))
    trees = {length: Boxes(vectors(matrix(w, length)), share, box) for length, w in sampled.items() if len(w) * share > box}
    schema = "length int, box int, role int, word string, n long"

    def dealt(batches):
        out = arrow_schema(schema)
        for b in batches:
            word, n = b.column("word"), b.column("n").to_numpy()
            lengths = np.array([len(w) for w in word.to_pylist()])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                m = vectors(matrix(word.take(pa.array(at)).to_pylist(), length))
                # Role 0 lies in the box; 1 searches words as long, 2 searches words of one letter more.
                for role, radius in ((0, 0), (1, 2), (2, 1)):
                    tree = trees.get(length + (role == 2))
                    rows, boxes = tree.reached(m, radius) if tree else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    for s in range(0, len(rows), 1 << 14):
                        r = rows[s:s + (1 << 14)]
                        yield batch(out, [np.full(len(r), length + (role == 2), np.int32), boxes[s:s + (1 << 14)].astype(np.int32),
                                          np.full(len(r), role, np.int32), word.take(pa.array(at[r])), n[at[r]]])

    slim = words.select("word", "n")
    placed = map_arrow(slim, dealt, schema)
    many = scratch.keep(placed.where("role = 0").groupBy("length", "box").count().where(F.col("count") > chunk).select(
        "length", "box", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "chunks")
    chunked = placed.join(many, ["length", "box"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    chunked = chunked.withColumn("chunk", F.explode(F.when(F.col("role") == 0, own).otherwise(
        F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("chunks")
    keys = ("length", "box", "chunk")
    # A box and its neighbours' searching words are spread by number: few keys would be dealt unevenly by their hash.
    cells = chunked.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "role")

    def search(batches):
        for (length, _, _), group in _groups(batches, keys):
            table = pa.Table.from_batches(group)
            role = table.column("role").to_numpy()
            first = int(np.searchsorted(role, 1))
            if first in (0, len(role)):
                continue
            words_here, n = table.column("word").slice(0, first).to_pylist(), table.column("n").to_numpy()
            stored = matrix(words_here, length)
            counts, here = vectors(stored), Near(words_here)
            for s in range(first, len(role), SEARCHING):
                for r in (1, 2):
                    e = min(s + SEARCHING, len(role))
                    x, y = s + int(np.searchsorted(role[s:e], r)), s + int(np.searchsorted(role[s:e], r + 1))
                    if x == y:
                        continue
                    asking, asking_n = table.column("word").slice(x, y - x).to_pylist(), n[x:y]
                    m, there = matrix(asking, length - r + 1), Near(asking)
                    for same, hit in close(counts, vectors(m), 3 - r):
                        a, b = verified(stored, m, same, hit)
                        there.add(b, n[a], [words_here[i] for i in a.tolist()])
                        if r == 2:  # those of one letter more are near to them in turn
                            here.add(a, asking_n[b], [asking[i] for i in b.tolist()])
                    yield from there.rows()
            yield from here.rows()

    found = map_arrow(cells, search, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("o"), "best")).alias("b")).select(
        "word", "near", (-F.col("b.o")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow word -> form to the end. Counts grow by a factor at every step, so chains are short and never closed."""
    hooks = scratch.keep(forms, "forms")
    while True:
        onward = hooks.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hooks = scratch.keep(hooks.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if hooks.where("moved").isEmpty():
            return hooks.select("word", "root")
        hooks = hooks.select("word", "root")


def spelling_variants(docs: DataFrame, scratch: Scratch, ratio: int = RATIO, letters: int = LETTERS, least: int = COUNT,
                      drop: int = DROP, **search: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    Words are runs of letters of U+0041 to U+005A, U+0061 to U+007A and U+00C0 to U+00FF, A-Z lower-cased; one in ``drop``
    runs of a document, by the hash of id and run, loses a letter. A word is near another if one letter is inserted,
    deleted or replaced. Its form is the near word that occurs most, if that is ``ratio`` times as often.

    Null texts have no words; a null id counts as an empty one; repeated rows count. Ties go to the first word in
    code-point order. An empty table gives an empty result; other columns are not read.
    """
    words = scratch.keep(word_counts(docs, letters, least, drop), "words")
    near = near_words(words, scratch, **search)
    placed = scratch.keep(words.join(near, "word", "left").withColumn(
        "fits", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))), "placed")
    roots = _roots(placed.where("fits").select("word", F.col("best").alias("root")), scratch)
    return placed.join(roots, "word", "left").select(
        "word", F.when(F.col("fits"), F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best_n")).alias("form_n"))
