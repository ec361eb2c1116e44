"""Near-duplicate and search operators against brute force, and their defined results for odd input."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import ann, components, embedding_dedup, simhash, suffix_dedup
from orderlens.session import Scratch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def scratch(spark):
    with Scratch(spark, "test") as opened:
        yield opened


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, th string, n_chars long")


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# --- components -------------------------------------------------------------------------------

def test_components_of_chains_stars_and_cycles(spark, scratch):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200),
                                                                                    (300, 300), (5, 4), (4, 5)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long"), scratch)
    expected = groups([p for p in pairs if p[0] != p[1]], {x for p in pairs for x in p if p[0] != p[1]})
    assert {r.node: r.component for r in found.collect()} == expected


def test_no_links_give_no_components(spark, scratch):
    assert components.components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), scratch).count() == 0


# --- SimHash ----------------------------------------------------------------------------------

def plain_fingerprint(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_links_of_odd_texts(spark, scratch):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "One Two"), (7, "a b c d e"), (7, "a b c d e"),
            (8, "É è É"), (None, "a b c d e"), (9, long)]
    found = simhash.near_duplicates(documents(spark, *rows), scratch).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        if r.id is not None:
            assert np.uint64(plain_fingerprint(text[r.id])) == np.int64(r.fp).view(np.uint64)
    component = {(r.id, r.component_id) for r in found}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (None, 7)} <= component


def test_every_pair_within_the_radius_is_linked(spark, scratch):
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 40, np.uint64)
    fps = list(base)
    for x in base:
        for flips in (1, 2, 3, 3, 4, 5):
            fps.append(x ^ np.uint64(sum(1 << int(b) for b in random.choice(64, flips, replace=False))))
    fps += [base[0] ^ np.uint64((1 << i) | (1 << j)) for i in range(12) for j in range(i)]  # one dense group
    fps = np.unique(np.array(fps, np.uint64))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").withColumn("node", F.col("fp"))
    masks, rest = simhash.zones(3)
    links = simhash.links(table, masks, rest // 2, ("fp",), 3)
    for r in links.collect():
        assert r.a != r.b
    found = {r.node: r.component for r in components.components(links, scratch).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    names = fps.view(np.int64).tolist()
    expected = groups([(names[i], names[j]) for i, j in zip(*np.nonzero(near)) if i < j], names)
    assert {n: found.get(n, n) for n in names} == expected


def test_simhash_of_an_empty_table(spark, scratch):
    assert simhash.near_duplicates(documents(spark).limit(0), scratch).count() == 0


# --- embeddings -------------------------------------------------------------------------------

def clusters(seed=0, dim=16):
    random = np.random.default_rng(seed)
    v = list(random.standard_normal((60, dim)))
    v += [v[0] * 3, v[1], v[1], *[v[2] + random.standard_normal(dim) * s for s in np.linspace(0.01, 0.5, 60)]]
    return [x.tolist() for x in v]


def vectors(spark, values):
    return spark.createDataFrame([(i, v, "extra") for i, v in values], "vec_id long, embedding array<float>, label string")


def test_links_counts_and_components_match_brute_force(spark, scratch, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)  # buckets are divided into cells
    v = clusters()
    table = vectors(spark, list(enumerate(v)))
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(table, scratch).collect()}
    m = np.array(v, np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    expected = groups([(i, j) for i, j in zip(*np.nonzero(close)) if i < j], range(len(v)))
    for i in range(len(v)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (close[i].sum() - 1, expected[i], expected[i] == i)


def test_odd_vectors_link_with_nothing(spark, scratch):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    found = embedding_dedup.near_vectors(vectors(spark, odd), scratch).collect()
    counts = Counter((r.vec_id, r.n_links, r.component_id) for r in found)
    assert counts == Counter({**{(i, 0, i): 1 for i in (1, 2, 3, 4, 5, 6, 8)}, (7, 2, 7): 1, (9, 2, 7): 2})
    assert embedding_dedup.near_vectors(vectors(spark, odd).limit(0), scratch).count() == 0


def test_tables_follow_from_threshold_and_recall():
    for count in (1, 1000, 10**6, 10**9):
        bits, tables = embedding_dedup.layout(count)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= embedding_dedup.RECALL


# --- nearest neighbours -----------------------------------------------------------------------

def exact_nearest(ids, m, k):
    out = {}
    for i in ids:
        if i % 20 == 0:
            scores = m @ m[ids.index(i)]
            order = sorted((-s, j) for s, j in zip(scores, ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def test_recall_against_brute_force_with_uneven_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    monkeypatch.setattr(ann, "QUERIES", 40)
    random = np.random.default_rng(2)
    m = random.standard_normal((2000, 32)) * random.uniform(0.5, 2.0, (2000, 1))
    m = m.astype(np.float32).astype(float)
    table = vectors(spark, [(i, x.tolist()) for i, x in enumerate(m)])
    found = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    expected = exact_nearest(list(range(2000)), m, 20)
    hits = sum(len({v for v, _ in found[q].values()} & {v for v, _ in e}) for q, e in expected.items())
    assert hits / (20 * len(expected)) >= 0.9
    for q, ranks in found.items():
        assert list(sorted(ranks)) == list(range(1, 21))
        assert [(-s, v) for v, s in (ranks[k] for k in sorted(ranks))] == sorted((-s, v) for v, s in ranks.values())
        for v, s in ranks.values():
            assert v != q and s == pytest.approx(m[v] @ m[q], abs=1e-12)


def test_odd_vectors_take_no_part_in_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (None, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (5, [0.5, 0.5])]
    table = vectors(spark, rows)
    found = ann.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 5, 0.5)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


# --- suffix arrays ----------------------------------------------------------------------------

def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("length", [48, 400])
def test_removal_matches_brute_force(spark, scratch, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # longer texts are taken piece by piece
    monkeypatch.setattr(suffix_dedup, "RANGE", 40)  # many ranges
    monkeypatch.setattr(suffix_dedup, "HELD", 100)
    random = np.random.default_rng(length)

    def text(n):
        return "".join(random.choice(list("abcdé \n"), n))
    passage, other = text(3 * length), text(length + 7)
    texts = [None, "", "short", text(2000), "ab" * 900, "ab" * 500, text(300) + passage + text(200), passage,
             text(50) + passage[length // 2:] + text(40), text(100) + passage[:length + 3] + other, other + text(90) + other,
             text(length - 1), "x" * (length - 1), "y" * length, "z" * (length + 1), text(1500)]
    texts += [texts[3], texts[3], texts[15][:1200]] + [text(20) + passage[:length] + text(20) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
             for r in suffix_dedup.remove_repeats(documents(spark, *rows), scratch, length).collect()}
    assert [found[i] for i in range(len(texts))] == brute_removal(texts, length)


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark, scratch):
    passage = " ".join(f"word{i}" for i in range(200))
    rows = [(1, passage), (1, passage), (None, "lonely " * 3), (None, passage + "!"), (2, "kept")]
    found = suffix_dedup.remove_repeats(documents(spark, *rows), scratch, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in found) == [(0, 1), (0, 21), (1, 0), (1, 0), (2, 4)]
    assert {r.kept for r in found if r.n_removed} == {b"", b"!"} or {bytes(r.kept) for r in found if r.n_removed} == {b"", b"!"}
    assert suffix_dedup.remove_repeats(documents(spark).limit(0), scratch).count() == 0


def brute_passages(texts, more):
    """(passages, their words): maximal runs under strings of ``more`` + 1 words that another document has too."""
    words = [(t or "").encode().split() for t in texts]
    runs = [[tuple(w[i:i + more + 1]) for i in range(len(w) - more)] for w in words]
    counts = Counter(r for each in runs for r in set(each))
    out = []
    for w, each in zip(words, runs):
        under = np.zeros(len(w) + 1, int)
        for i, r in enumerate(each):
            if counts[r] > 1:
                under[i:i + more + 1] = 1
        out.append((int((np.diff(np.concatenate([[0], under])) == 1).sum()), int(under.sum())))
    return out


@pytest.mark.parametrize("piece, more", [(1 << 20, 50), (300, 50), (300, 3)])
def test_short_passages_of_many_words_are_told_by_documents(spark, scratch, monkeypatch, piece, more):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)  # many blocks
    random = np.random.default_rng(more)

    def prose(n):
        return " ".join("".join(random.choice(list("abcdefé"), random.integers(2, 7))) for _ in range(n))
    passage, other, line = prose(more + 1), prose(3 * more), prose(more + 9)
    assert len(passage.encode()) < 400
    texts = [None, "", "short", prose(900), prose(40) + " " + passage + " " + prose(30), passage.replace(" ", "\n"), prose(more + 5),
             # Too short by a word; repeated within one document alone; longer and overlapping passages; copies.
             prose(9) + " " + passage.rsplit(" ", 1)[0] + " " + prose(9), line + " " + prose(5) + " " + line,
             other + " " + prose(7) + " " + other, prose(7) + " " + other[other.index(" "):], "ab " * 700, "ab " * 60, "x" * 3000]
    texts += [texts[3], texts[3] + " " + passage, prose(20) + " " + " ".join(texts[3].split()[300:500]) + " " + prose(20)]
    texts += [prose(12) + "\t" + passage + " " + prose(12) for _ in range(40)]
    rows = [*enumerate(texts), (None, texts[6]), (6, texts[6])]
    found = suffix_dedup.remove_repeats(documents(spark, *rows), scratch, passages=more).collect()
    wanted = [(i, *x, *y) for (i, _), x, y in zip(rows, brute_removal([t for _, t in rows], 400), brute_passages([t for _, t in rows], more))]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == sorted(wanted, key=str)
    assert suffix_dedup.remove_repeats(documents(spark).limit(0), scratch, passages=more).count() == 0


def test_characters_stay_whole_where_texts_are_cut():
    data = "é".encode() * 10
    assert suffix_dedup._whole_characters(data, [(1, 7)]) == "é".encode() * 8
    assert suffix_dedup._whole_characters(data, [(0, 20)]) == b""


def test_levels_of_the_family_grow_geometrically(spark, scratch):
    family = suffix_dedup.IndexFamily(scratch, 2)
    texts = [(i, " ".join(hashlib.sha256(f"{k} {i if i % 3 else 0}".encode()).hexdigest() for k in range(20))) for i in range(7)]
    docs = documents(spark, *texts).select("doc_id", F.col("text").cast("binary").alias("text"))
    sizes, matches = [], []
    for i in range(7):
        family.add(suffix_dedup.array_parts(docs.where(F.col("doc_id") == i), 400, np.array([b"5", b"c"], "S32")))
        sizes.append([size for size, _ in family.levels])
        matches.append(not family.repeated[-1].isEmpty())
    # Levels of one size merge when the next batch comes.
    assert sizes == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0], [2, 1, 0]]
    assert matches == [False, False, False, True, False, False, True]
    for _, level in family.levels:
        for r in level.collect():
            held = suffix_dedup._unpacked_prefixes(bytes(r.prefixes))
            assert (held[1:] > held[:-1]).all()
            assert all(int(x[:1] >= b"5") + int(x >= b"c") == r.range for x in held)


def test_common_prefixes_of_neighbours():
    ordered = np.array(sorted(["a" * 32, "a" * 32, "a" * 31 + "b", "ab", "\x00"]), "S32")
    assert suffix_dedup.common_prefixes(ordered).tolist() == [0, 32, 31, 1]
