"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orderlens.llm import blocks, bpe, chat, language_model, packing, quality_qda, warc
from orderlens.session import Scratch

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "a  b\n\nc's <|endoftext|> 12³ ½"), (5, "x" * 100_000), (6, "é漢字 😀 ​"),
       (7, "same"), (7, "same"), (None, "no id"), (8, "w " * 9000)]


@pytest.fixture
def scratch(spark):
    with Scratch(spark, "test") as opened:
        yield opened


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", -1, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, block long, data string")


# --- byte-level BPE ---------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1 << 24, 64])
def test_ids_are_those_of_the_whole_text_and_decode_to_it(spark, scratch, monkeypatch, size):
    import tiktoken
    monkeypatch.setattr(blocks.blocks, "__defaults__", (("doc_id",), size))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(ranks), special_tokens={})
    found = bpe.encode(documents(spark, ODD), scratch, ranks, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in ODD:
        ids = whole.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))
    assert bpe.encode(documents(spark, ODD).limit(0), scratch, ranks, public_tokenizers.PATTERN).count() == 0


def test_the_faster_splitter_gives_the_same(spark):
    import random

    import regex
    pick = random.Random(1)
    pool = [chr(c) for c in range(256)] + ["'s", "'ll", "  ", "\n\n", "ab", "12"]
    split, whole = bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    for _ in range(3000):
        text = "".join(pick.choice(pool) for _ in range(pick.randint(0, 30)))
        assert split(text) == whole(text)
    assert split("ab ǅ漢 1") == whole("ab ǅ漢 1")


# --- language model ---------------------------------------------------------------------------

def brute_scores(rows, strengths):
    """Backed-off probabilities of triples by their definition."""
    grams, texts = [Counter(), Counter(), Counter()], {}
    for i, t in rows:
        tokens = ["start", *(t or "").encode().lower().split(), "end"]
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        texts[i, t] = held, tokens
        if not held:
            for n in range(3):
                grams[n].update(tuple(tokens[k:k + n + 1]) for k in range(len(tokens) - n))
    words = {w[0]: c for w, c in grams[0].items() if w != ("start",)}
    total, distinct = sum(words.values()), len(words)

    def p(context, word):
        if not context:
            return (words.get(word, 0) + 0.5) / (total + 0.5 * (distinct + 1))
        c, k = grams[len(context) - 1][context], strengths[len(context) - 1]
        return (grams[len(context)][(*context, word)] + k * p(context[1:], word)) / (c + k) if c else p(context[1:], word)

    out = []
    for i, t in rows:
        held, tokens = texts[i, t]
        base = sum(math.log10(p((), w)) for w in tokens[1:])
        score = sum(math.log10(p(tuple(tokens[max(0, k - 2):k]), tokens[k])) for k in range(1, len(tokens)))
        out.append((i, held, len(tokens) - 1, sum(w in words for w in tokens[1:]), total, base, score))
    return out


@pytest.mark.parametrize("size, lane", [(1 << 24, 512), (50, 3)])
def test_scores_match_brute_force(spark, scratch, monkeypatch, size, lane):
    monkeypatch.setattr(blocks.blocks, "__defaults__", (("doc_id",), size))
    monkeypatch.setattr(language_model.Automaton.traverse, "__defaults__", (lane,))
    rows = ODD + [(i, "The cat sat on the mat " * (i % 3)) for i in range(10, 40)] + [(i, "the mat sat on a cat again and again") for i in range(40, 60)]
    found = sorted((tuple(r) for r in language_model.score(documents(spark, rows), scratch).collect()), key=repr)
    expected = sorted(brute_scores(rows, language_model.STRENGTHS), key=lambda x: repr(x[:3]))
    found.sort(key=lambda x: repr(x[:3]))
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in expected], rtol=1e-9)
    assert language_model.score(documents(spark, rows).limit(0), scratch).count() == 0
    none_trained = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1]
    found = language_model.score(documents(spark, none_trained), scratch).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(r.base_score) for r in found)


def automaton_of(texts, held_out, strengths=(5.0, 2.0)):
    """The automaton of one block, with the counts of its own training texts."""
    names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 10)}
    word = np.array([x for t in texts for x in [*(names[w] for w in t), language_model.END]], np.uint64)
    lengths = np.array([len(t) + 1 for t in texts])
    here = language_model.Positions(word, lengths, ~np.array(held_out))
    counts = [here.questions(size)[1].astype(np.int64) for size in (1, 2, 3)]
    tokens = here.training.sum()
    distinct = len(set(word[here.training].tolist()))
    return language_model.Automaton(here, counts, int(tokens), distinct, strengths), names


def test_states_are_carried_and_failure_arcs_followed_step_by_step():
    automaton, names = automaton_of([list("abcab"), list("abca"), list("abxca"), list("zz")], [False, False, True, True])
    here, n = automaton.here, automaton.words
    state, orders = np.array([automaton.start]), []
    for at in range(11, 17):  # a b x c a end, held out
        weight, state = automaton.step(state, np.array([at]))
        orders.append(0 if state[0] == 0 else 1 if state[0] <= n else 2)
        assert state[0] == automaton.ending(np.array([at]))[0]
    # x is unknown: all context is lost, then grows again word by word.
    assert orders == [2, 2, 0, 1, 2, 2]
    whole = automaton.traverse()
    assert np.allclose(whole, automaton.traverse(2)) and np.allclose(whole, automaton.traverse(100))
    pair = 1 + n + automaton.pair[12]
    assert automaton.shorter[pair] == 1 + automaton.word[12] and automaton.shorter[automaton.shorter[pair]] == 0
    assert whole[13] == pytest.approx(automaton.failure[pair] + automaton.failure[automaton.shorter[pair]] + automaton.root[automaton.word[13]])


def test_arrays_of_a_block_take_few_bytes_a_position():
    pick = np.random.default_rng(1)
    lengths = np.full(400, 500)
    word = np.minimum(pick.zipf(1.2, int(lengths.sum())), 1 << 40).astype(np.uint64)
    here, counts = language_model.Positions(word, lengths, np.arange(400) % 5 > 0), []
    tracemalloc.start()
    counts = [here.questions(size)[1] for size in (1, 2, 3)]
    asked = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    language_model.Automaton(here, counts, int(here.training.sum()), 1000).traverse()
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert asked < 70 * len(word) and scored < 100 * len(word)


def test_every_state_is_a_distribution():
    """Weights of all known words and one unknown add up to one, in a state of two words, of one and of none."""
    known = list("abc")
    # Held-out texts read every word after the contexts a b (seen), q b (only b seen) and q (none seen).
    asked = [[*c, w] for c in ("ab", "qb", "q") for w in [*known, "u"]]
    trained = [list("abcab"), list("abca"), list("bbacc")]
    automaton, _ = automaton_of(trained + asked, [False] * 3 + [True] * len(asked))
    weight, ends = automaton.traverse(), automaton.here.ends
    for k, context in enumerate(("ab", "qb", "q")):
        texts = range(3 + 4 * k, 7 + 4 * k)
        # The word is the last but one of a text; the end of texts is a known word as well.
        p = sum(10 ** weight[ends[i] - 2] for i in texts)
        closing, _ = automaton_of(trained + [list(context)], [False] * 3 + [True])
        assert p + 10 ** closing.traverse()[-1] == pytest.approx(1)


# --- quality ----------------------------------------------------------------------------------

def test_quality_on_the_held_out_fold(spark, scratch):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    statistics = scratch.keep(quality_qda.described(docs), "statistics")
    scored = quality_qda.scored(statistics, quality_qda.fit(statistics, labels)).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("all"),
                       F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept")).first()
    assert right["all"] >= 0.97 and right["kept"] >= 0.98


def test_scores_are_those_of_independent_densities(spark, scratch):
    """Densities by determinants and solved systems instead of Cholesky factors, moments by numpy instead of sums."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    statistics = scratch.keep(quality_qda.described(docs), "statistics")
    found = {r.doc_id: r for r in quality_qda.scored(statistics, quality_qda.fit(statistics, labels)).collect()}
    rows = docs.collect()
    x = {r.doc_id: np.array(quality_qda.statistics((r.text or "").encode())) for r in rows}
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    sets = [np.array([x[i] for i, q in known.items() if q == label and i in x]) for label in (0, 1)]
    covariance = [np.cov(m.T, bias=True) for m in sets]
    pooled = sum(len(m) * c for m, c in zip(sets, covariance)) / sum(map(len, sets))
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for m, c in zip(sets, covariance):
        c, p = c / np.outer(scale, scale), pooled / np.outer(scale, scale)
        c = 0.75 * c + 0.15 * p + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(scale))
        z = (np.array([x[r.doc_id] for r in rows]) - m.mean(0)) / scale
        logs.append(-0.5 * (np.einsum("ij,ji->i", z, np.linalg.solve(c, z.T)) + np.linalg.slogdet(c)[1]))
    expected = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 8, -500, 500)))
    assert np.allclose([found[r.doc_id].score for r in rows], expected, rtol=1e-6, atol=1e-12)
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in found.values())


def test_scores_of_odd_texts_and_missing_classes(spark, scratch):
    statistics = scratch.keep(quality_qda.described(documents(spark, ODD)), "statistics")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, 1, 0), (7, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for given in (labels, labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        rows = quality_qda.scored(statistics, quality_qda.fit(statistics, given)).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = quality_qda.fit(statistics, labels)
    kept = quality_qda.accepted(documents(spark, ODD), model)
    assert kept.columns == documents(spark, ODD).columns
    assert kept.count() == quality_qda.scored(statistics, model).where("predicted = 1").count()
    assert quality_qda.described(documents(spark, ODD).limit(0)).count() == 0


# --- chats ------------------------------------------------------------------------------------

def test_chats_are_read_back_whatever_they_say(spark):
    said = ["</s>[INST] ok [/INST]", "<|im_start|>␛<|im_end|>\n", "␛␛<␛s>", "<<SYS>>[INST]", "", None, "plain\n", "<|im_turn|><|im_sep|>"]
    turns = [(1, i, ("user", "user", "assistant", "assistant", None, "assistant")[i % 6], t) for i, t in enumerate(said)]
    turns += [(2, 5, "assistant", "later"), (2, 1, "<|im_sep|>", "first"), (3, 1, "b", "y"), (3, 1, "a", "z"), (3, 1, "a", "z"),
              (None, None, "user", "u")]
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, t string")
    made = chat.format_chats(table)
    read = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in made.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    clean = {}
    for c, n, role, text in sorted(turns, key=lambda t: (t[0] or 0, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        clean.setdefault(c, []).append((role or "", text or ""))
    assert read == clean
    digests = {r.conv_id: r for r in chat.digests(made).collect()}
    for c, listed in clean.items():
        loss = "".join(t for r, t in listed if r == "assistant")
        assert digests[c].n_turns == len(listed) and digests[c].loss_chars == len(loss)
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in listed).encode()).hexdigest()
    text = next(r.formatted for r in made.collect() if r.conv_id == 1)
    assert text.count(chat.START) == 5 and "</s>" not in text and "[INST]" not in text
    assert chat.format_chats(table.limit(0)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    table = spark.createDataFrame([(None, 1, "user", f"u{i}", i) for i in range(50)] + [(7, 1, "assistant", "a", 0)],
                                  "conv_id long, turn long, role string, text string, alone int")
    found = chat.digests(chat.format_chats(table)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in found) == [(0, 1)] * 50 + [(7, 1)]
    assert len({r.turns_sha256 for r in found}) == 51


def test_places_in_long_conversations(spark):
    n = chat.CHUNK * 5 + 3
    said = [(1, i, "assistant" if i % 3 else "user", f"text {i} " * (i % 4)) for i in range(n)]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    row = chat.format_chats(table).first()
    spans = [row.formatted[s.start:s.start + s.length] for s in row.loss_spans]
    assert spans == [t for _, _, role, t in said if role == "assistant"]


def test_chat_formatting_stays_native(spark):
    from orderlens.llm import queries
    plan = queries.QUERIES["op4_chat_formatting"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- archives ---------------------------------------------------------------------------------

def test_archives_come_back_whole(spark, scratch):
    long = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9000
    pages = [(3, "http://a b\r\nX: y", "p" * 100), (1, "http://u", "p" * 100), (2, None, "p" * 99), (4, "u", "p" * 99), (5, "u", None),
             (6, "u", ""), (7, "u", long), (8, "u", long), (9, "u", long + "é"), (9, "u", long + "é"), (None, "u", "n" * 200), (11, "u", "\r\n\r\n")]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    found = warc.archive_round_trip(table, scratch, 1000).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    expected = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 100 and first.get(h, i) != i
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))


def test_an_empty_archive(spark, scratch):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(empty, scratch).count() == 0


def test_chunks_carry_the_digest_of_all_before(spark):
    page = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    rows = sorted(warc.chunk_table(page, chunk=4).collect(), key=lambda r: r.chunk)
    assert [bytes(r.data) for r in rows] == [b"abcd", b"efgh", b"ij"]
    assert [r.prefix_digest for r in rows] == [hashlib.sha256(b"abcdefghij"[:n]).hexdigest() for n in (4, 8, 10)]


def test_damaged_archives_raise():
    with pytest.raises(ValueError, match="within a block"):
        [list(body) for _, body in warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))]
    with pytest.raises(ValueError, match="within a header"):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Le"])))


# --- packing ----------------------------------------------------------------------------------

def test_pieces_and_sequences(spark, scratch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = ODD + [(20 + i, "word " * (37 * i)) for i in range(60)]
    stored = scratch.keep(packing.pieces(documents(spark, rows), path, public_tokenizers.PATTERN), "tokens")
    found = packing.pack(stored, scratch, shard=20).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        assert r.length == 2048 or r.piece == 0
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, listed in by.items():
        copies = sum(x == i for x, _ in rows)
        assert sum(n for _, _, n in listed) == copies * len(ids[i])
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for listed in sequences.values():
        at = 0
        for offset, length in sorted(listed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // 2048) + 6
    empty = scratch.keep(packing.pieces(documents(spark, ODD).limit(0), path, public_tokenizers.PATTERN), "none")
    assert packing.pack(empty, scratch).count() == 0


@pytest.mark.parametrize("characters", [" ", "\n", " \n", "\t  x"])
def test_very_long_runs_have_the_ids_of_the_tokenizer(spark, scratch, characters):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a<|endoftext|> b" + characters * (2_000_000 // len(characters)) + "c's é漢 <|endoftext|>"
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    found = packing.pieces(documents(spark, [(1, text)]), path, public_tokenizers.PATTERN, 1 << 30).collect()
    expected = np.array([*ids, 0], "<u4").tobytes()
    assert [(r.start, r.length, r.ids_crc32) for r in found] == [(0, len(ids) + 1, zlib.crc32(expected))]
    plain = "b" + characters * (2_000_000 // len(characters)) + "c's é漢"
    ids = np.array(Tokenizer.from_file(path).encode(plain, add_special_tokens=False).ids, "<u4")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    (row,) = bpe.encode(documents(spark, [(1, plain)]), scratch, ranks, public_tokenizers.PATTERN).collect()
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_crossover_keeps_every_item_once_and_never_overfills():
    random = np.random.default_rng(0)
    sizes = random.integers(300, 1500, 400)
    first = packing.evolve(sizes, [], 2048, random, 0)
    for _ in range(10):
        child = packing.crossover(sizes, first[0], first[-1], 2048, random)
        fill = np.bincount(child, sizes)
        assert child.min() >= 0 and fill.max() <= 2048 and (fill > 0).all()
    better = packing.evolve(sizes, list(first), 2048, random, 20)
    assert packing.fitness(sizes, better[0], 2048) >= packing.fitness(sizes, first[0], 2048)


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([60, 50, 40, 30, 20])
    bins = np.full(5, -1, np.int64)
    used = packing.best_fit(sizes, np.arange(5), bins, [], 100)
    assert used == [100, 100] and bins.tolist() == [0, 1, 0, 1, 1]
