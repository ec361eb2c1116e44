"""Byte-level BPE over one global shuffle of distinct words.

Texts are cut into pre-tokens; their positions stay in blocks (``blocks.py``). Each block sends its distinct
pre-tokens to shards by their checksum, where every distinct one of the corpus is encoded once, by one
task; the ids go back to the blocks that asked and are put in place by position. Decoding looks
ids up in the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.blocks import blocks, from_planes, gathered, planes
from orderlens.llm.common import arrow_schema, batch, map_arrow, shuffle_partitions, sliced_rows, utf8
from orderlens.session import Scratch

STORED = "block long, documents int, ids binary, lengths binary, numbers binary, words int, word_lengths binary, word_bytes binary"
ASKED = "block long, shard int, words int, word_lengths binary, word_bytes binary"
ANSWER = "block long, part int, words int, word_lengths binary, data binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in the order of their ids, with the start and length of each."""
    table = ranks_of(path)
    tokens = sorted(table, key=table.__getitem__)
    length = np.zeros(max(table.values()) + 1, np.int64)
    length[[table[t] for t in tokens]] = [len(t) for t in tokens]
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def splitter(pattern: str):
    """Finds the pre-tokens of a text. Texts of Latin-1 characters alone go through the standard library's
    matcher with the classes written out, which gives the same and is faster."""
    import regex
    whole = regex.compile(pattern).findall
    letters = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    numbers, spaces = "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
    expanded = pattern
    for general, listed in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"),
                            (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        expanded = expanded.replace(general, listed)
    usual = re.compile(expanded).findall if "\\" not in re.sub(r"\\[tnr]", "", expanded) else None
    beyond = re.compile("[Ā-\U0010ffff]").search
    return lambda text: whole(text) if usual is None or beyond(text) else usual(text)


def stored_blocks(docs: DataFrame, pattern: str, shards: int) -> DataFrame:
    """The documents as blocks. A word's number tells its shard (the remainder) and its place there."""
    def work(batches):
        split = splitter(pattern)

        def words_of(data):
            return split(data.decode("utf-8", "replace"))

        for number, held in blocks(batches, words_of):
            encoded = []

            def order(words, counts):
                encoded.extend(w.encode() for w in words)
                shard = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(words)).astype(np.int64) % shards
                by = np.lexsort((-counts, shard))
                first = np.searchsorted(shard[by], shard)
                place = np.empty(len(words), np.int64)
                place[by] = np.arange(len(words))
                return (place - first) * shards + shard

            words, new, numbers = held.ranked(order)
            by = np.lexsort((new // shards, new % shards))
            kept = [encoded[i] for i in by]
            # Where each shard's words begin follows from the numbers.
            counts = np.bincount(new % shards, minlength=shards).astype(np.uint32)
            lengths = np.fromiter(map(len, kept), np.uint32, len(kept))
            ids = np.array([-1 << 63 if x is None else x for x, in held.ids], np.int64)
            yield batch(arrow_schema(STORED), [
                [number], [len(ids)], [planes(ids)], [planes(held.lengths())], [planes(numbers)], [len(kept)],
                [counts.tobytes() + planes(lengths)], [b"".join(kept)]])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), work, STORED)


def encoded_words(stored: DataFrame, ranks_path: str, pattern: str, shards: int) -> DataFrame:
    """Ids of the words of every block and shard, each distinct word encoded once."""
    def ask(batches):
        def rows():
            for b in batches:
                for block, packed, data in zip(b.column("block"), b.column("word_lengths"), b.column("word_bytes")):
                    packed, data = packed.as_py(), data.as_py()
                    counts = np.frombuffer(packed[:4 * shards], np.uint32)
                    lengths = from_planes(packed[4 * shards:], np.uint32)
                    ends, at = np.cumsum(counts), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                    for s in np.flatnonzero(counts).tolist():
                        i, j = int(ends[s] - counts[s]), int(ends[s])
                        yield block.as_py(), s, j - i, planes(lengths[i:j]), data[at[i]:at[j]]
        yield from sliced_rows(rows(), arrow_schema(ASKED))

    def answer(batches):
        import tiktoken
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks_of(ranks_path), special_tokens={})
        # A word is a pre-token already: merges alone, as tiktoken's matcher raises on a million of white space.
        merged = encoding._core_bpe.encode_single_piece

        def rows():
            known: dict[bytes, bytes] = {}
            shard = None
            for b in batches:
                for block, s, n, packed, data in zip(*(b.column(c).to_pylist() for c in
                                                       ("block", "shard", "words", "word_lengths", "word_bytes"))):
                    if s != shard:
                        shard, known = s, {}
                    found, at = [], 0
                    for length in from_planes(packed, np.uint32).tolist():
                        word = data[at:at + length]
                        at += length
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = np.array(merged(word), "<u4").tobytes()
                        found.append(ids)
                    lengths = np.fromiter(map(len, found), np.uint32, n) // 4
                    yield block, s, n, planes(lengths), planes(np.frombuffer(b"".join(found), "<u4"))
        yield from sliced_rows(rows(), arrow_schema(ANSWER))

    asked = map_arrow(stored.select("block", "word_lengths", "word_bytes"), ask, ASKED)
    dealt = asked.repartition(shuffle_partitions(stored.sparkSession), "shard").sortWithinPartitions("shard")
    return map_arrow(dealt, answer, ANSWER)


def encode(docs: DataFrame, scratch: Scratch, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids as the tokenizer's on the whole text,
    decoded again through the token-byte table.

    Null texts are empty and have no ids. Repeated rows and null ids stay. An empty table gives an
    empty result; other columns are not read.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    shards = partitions
    stored = scratch.keep_bucketed(stored_blocks(docs, pattern, shards), "blocks", "block", partitions)
    answers = encoded_words(stored, ranks_path, pattern, shards)
    own = stored.select("block", "documents", "ids", "lengths", "numbers")

    def place(told, block):
        token_bytes, token_start, token_length = token_table(ranks_path)
        held = {part: (from_planes(packed, np.uint32).astype(np.int64), from_planes(data, np.uint32)) for part, packed, data in zip(
            *(told.column(c).to_pylist() for c in ("part", "word_lengths", "data")))}
        size = max((len(x) for x, _ in held.values()), default=0) * shards
        length, start, every, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [np.empty(0, np.uint32)], 0
        for s, (lengths, ids) in held.items():
            where = np.arange(len(lengths)) * shards + s
            length[where], start[where] = lengths, at + np.cumsum(lengths) - lengths
            every.append(ids)
            at += len(ids)
        every, row = np.concatenate(every), block.to_pylist()[0]
        doc_ids, lengths = from_planes(row["ids"], np.int64), from_planes(row["lengths"], np.uint32)
        numbers, at, rows = from_planes(row["numbers"], np.uint32), 0, []
        for doc_id, count in zip(doc_ids.tolist(), lengths.tolist()):
            here = numbers[at:at + count]
            at += count
            ids = gathered(every, start[here], length[here])
            decoded = hashlib.sha256()
            for k in range(0, len(ids), 1 << 16):  # a long text is decoded piece by piece
                some = ids[k:k + (1 << 16)]
                decoded.update(gathered(token_bytes, token_start[some], token_length[some]))
            rows.append((None if doc_id == -1 << 63 else doc_id, len(ids),
                         hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), decoded.hexdigest()))
        return pa.Table.from_batches([batch(arrow_schema(RESULT), zip(*rows))])

    return answers.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(place, RESULT)
