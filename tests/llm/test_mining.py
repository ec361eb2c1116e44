"""Collocations, spelling variants and secret scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import collocations, secrets, spelling
from orderlens.llm.sieve import Sieve, sieve_of
from orderlens.session import Scratch

EXTRA = "key long, f long, word string, n long, kinds string, box int, total long, batch int, `range` int"


@pytest.fixture
def scratch(spark):
    with Scratch(spark, "mining") as opened:
        yield opened


def documents(spark, rows):
    """(doc_id, text, lang) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "w", 3, "k", 4, 5, 6, 7) for r in rows], f"doc_id long, text string, lang string, {EXTRA}")


# --- sieves -----------------------------------------------------------------------------------

def test_a_sieve_holds_all_its_keys_and_few_others(spark):
    keys = np.random.default_rng(1).integers(-1 << 62, 1 << 62, 50_000)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    sieve = Sieve(sieve_of(table, len(keys)))
    assert sieve.may(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert sieve.may(others).mean() < 0.05
    assert Sieve.size(1 << 40) * 8 <= 16 << 20 and Sieve.size(0) == 2
    # One that is far too small lets all through and loses none.
    assert Sieve.empty(2).add(keys.view(np.uint64)).may(keys.view(np.uint64)).all()


# --- collocations -----------------------------------------------------------------------------

def brute_collocations(rows, support, longest=5, top=2000, percent=100):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i:i + size]) for size in range(1, longest + 1) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        longer = Counter()
        for p, a in candidates.items():
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longer[inner] = max(longer[inner], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] < percent * a:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, count):
    pick = random.Random(seed)
    pool = ["the", "New", "york", "a", "a", "é漢", "x" * 90, "of", "\x00z", "nul l"]
    fixed = ["the new york times. ", "a a a a a! ", "of the,of the\tof ", "New\x0byork\n"]
    rows = [(i, "".join(pick.choice(fixed) if pick.random() < 0.3 else pick.choice(pool) + pick.choice([" ", "  ", "\t", ". "])
                        for _ in range(pick.randint(0, 60))), pick.choice(["en", "de", None])) for i in range(count)]
    return rows + [(None, None, "en"), (1, "", None), (2, " ,.; ", "fr"), (3, "the new york times " * 3000, "en")] + rows[:5]


@pytest.mark.parametrize("support, percent, shard_bytes, top", [(20, 100, 1 << 25, 2000), (7, 100, 2000, 2000), (7, 80, 500, 6), (1, 100, 3000, 2000)])
def test_collocations_match_brute_force(spark, scratch, monkeypatch, support, percent, shard_bytes, top):
    monkeypatch.setattr(collocations, "RANGE_KEYS", 5000)
    rows = phrase_rows(support, 60)
    found = collocations.collocations(documents(spark, rows), scratch, support, top=top, percent=percent, shard_bytes=shard_bytes)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, support, top=top, percent=percent)


def test_nothing_is_lost_by_a_sieve_that_is_too_small(spark, scratch, monkeypatch):
    monkeypatch.setattr(collocations.Sieve, "size", staticmethod(lambda keys, most=0: 2))
    rows = phrase_rows(3, 40)
    found = collocations.collocations(documents(spark, rows), scratch, 9, shard_bytes=1500)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 9)


def test_shards_send_only_phrases_of_frequent_parts(spark, scratch, monkeypatch):
    """With a lowered support of one, phrases with a rare word stay where they are."""
    sent, mined = [], collocations.mined

    def counted(*args):
        out = mined(*args)
        sent.append(out.agg(F.sum(F.octet_length("counts") / 4)).first()[0] or 0)
        return out

    monkeypatch.setattr(collocations, "mined", counted)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100)) + " a b a b", "en") for i in range(40)]
    found = collocations.collocations(documents(spark, rows), scratch, 20, shard_bytes=500)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 20)
    words, others = 40 * 102, 40 * 6  # a b, b a, a b a, b a b, a b a b
    assert 0 < sum(sent) <= words + others


def test_collocations_of_no_rows(spark, scratch):
    assert collocations.collocations(documents(spark, phrase_rows(1, 1)).limit(0), scratch).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None), (2, ".", "en")]), scratch, 1).count() == 0


def test_lowered_supports_miss_no_frequent_phrase():
    pick = random.Random(5)
    for _ in range(300):
        tokens = [pick.randint(1, 10 ** pick.randint(1, 6)) for _ in range(pick.randint(1, 40))]
        least = [collocations.lowered(100, t, sum(tokens)) for t in tokens]
        assert sum(x - 1 for x in least) < 100 and min(least) >= 1


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10 ** 12 + 7, 10 ** 14 + 3, 10 ** 12 + 9, 10 ** 12 + 11), (100, 10 ** 17, 100, 100), (3, 10, 7, 9)]
    table = spark.createDataFrame(rows, "a long, n long, l long, r long")
    found = table.select("a", "n", "l", "r", collocations.score("a", "n", "l", "r").alias("score")).collect()
    assert all(r.score == 1000 * r.a * r.n // (r.l * r.r) for r in found)


# --- spelling ---------------------------------------------------------------------------------

def brute_spelling(rows, letters=6, least=5, ratio=5, drop=199):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % drop == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, many = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        many[w] = len(close)
        if close and n[best := min(close, key=lambda x: (-n[x], x))] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], many[w], n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def spelling_rows(seed):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdéÿ") for _ in range(pick.randint(5, 9))) for _ in range(25)] + ["aabbccdd", "ddccbbaa", "abcdabcd"]

    def variant(w):
        k = pick.randrange(len(w))
        return pick.choice([w, w[:k] + w[k + 1:], w[:k] + pick.choice("abcÀ×") + w[k:], w[:k] + pick.choice("abÉ") + w[k + 1:], w.upper()])
    rows = [(pick.randint(0, 400), pick.choice([" ", "1", "-", "Ā"]).join(variant(pick.choice(words)) for _ in range(pick.randint(0, 40))), "x") for _ in range(120)]
    # A chain of ever rarer forms, and many words of the same letters.
    chain = [("rootword " * 2000), "rootworx " * 300, "rootwoxx " * 40, "rootwxxx " * 6]
    anagrams = " ".join("".join(pick.sample("abcdefg", 7)) for _ in range(200))
    return rows + [(500 + i, t, "x") for i, t in enumerate(chain)] + [(600 + i, anagrams, "x") for i in range(6)] + [
        (None, "nobody " * 9, "x"), (7, None, None), (8, "", "x"), (9, "z" * 100_000, "x")] + [(9, "z" * 100_000, "x")] * 5 + rows[:3]


@pytest.mark.parametrize("drop, search", [(199, {}), (3, {"sample": 100, "box": 6, "chunk": 10})])
def test_spelling_matches_brute_force(spark, scratch, monkeypatch, drop, search):
    monkeypatch.setattr(spelling, "SMALL", 3)
    monkeypatch.setattr(spelling, "SEARCHING", 50)
    monkeypatch.setattr(spelling, "HELD", 40)
    rows = spelling_rows(drop)
    found = spelling.spelling_variants(documents(spark, rows), scratch, drop=drop, **search).collect()
    assert sorted(map(tuple, found), key=repr) == brute_spelling(rows, drop=drop)
    assert any(r.form and r.root != r.form for r in found)


def test_spelling_of_no_rows(spark, scratch):
    assert spelling.spelling_variants(documents(spark, spelling_rows(1)[:1]).limit(0), scratch).count() == 0


def test_no_word_within_reach_lies_in_a_box_that_is_left_out():
    pick = np.random.default_rng(4)
    words = pick.integers(0x61, 0x67, (3000, 8)).astype(np.uint8)
    counts = spelling.vectors(words)
    tree = spelling.Boxes(counts[:500], 6.0, 60)
    assert tree.size > 20
    home = np.full(len(words), -1)
    rows, boxes = tree.reached(counts, 0)
    home[rows] = boxes
    assert (np.bincount(rows, minlength=len(words)) == 1).all()
    for radius in (1, 2):
        rows, boxes = tree.reached(counts[:200], radius)
        reached = set(zip(rows.tolist(), boxes.tolist()))
        near = np.abs(counts[:200, None].astype(int) - counts[None]).sum(2) <= radius
        assert all((i, int(home[j])) in reached for i, j in zip(*np.nonzero(near)))
        assert len(reached) < 200 * tree.size / 2  # and boxes are left out


# --- secrets ----------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for k, rule in enumerate(secrets.RULES[1:], 1):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= rule.least]
    return sorted(found)


PIECES = ["token", "=", "api_key", "apikey", ": ", "'", '"', "password", "passwd", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é",
          " ", "\n", "eyJ", ".", "ghp_", "a" * 36, "AIza", "x" * 35, "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "漢", "Secret",
          "ſecret", "toKen", "secret=", "==", "B", "token:token:", "\x00"]


@pytest.mark.parametrize("lane, at_once, few", [(2048, 4 << 20, 12), (16, 300, 2), (5, 50, 100)])
def test_spans_match_the_patterns(monkeypatch, lane, at_once, few):
    monkeypatch.setattr(secrets, "LANE", lane)
    monkeypatch.setattr(secrets, "AT_ONCE", at_once)
    monkeypatch.setattr(secrets, "FEW", few)
    pick = random.Random(lane)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 40))) for _ in range(500)]
    texts += ["", "a" * 30_000 + "0" * 500, "eyJ" * 3000, "token=" + "z" * 20_000, "AKIA" * 3000]
    found = secrets.scanner_of(secrets.RULES).scan([t.encode() for t in texts])
    for text, spans in zip(texts, found):
        data = text.encode()
        assert [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in spans] == brute_secrets(text)
    assert sum(map(len, found)) > 500


def test_the_automaton_is_small_and_its_arrays_are_those_of_the_patterns():
    rules = (secrets.Rule("x", "(ab|a)*c"), secrets.Rule("y", "a{2,3}"), secrets.Rule("z", "[^a-y\n]?q"))
    once = secrets.Automaton(rules, False)
    assert len(once.ends) < 20
    pick = random.Random(6)
    for _ in range(3000):
        text = bytes(pick.choice(b"abcqz\n") for _ in range(pick.randint(0, 7)))
        state = 0
        for byte in text:
            state = int(once.step[state * once.width + once.byte_class[byte]])
        expected = sum(bool(re.fullmatch(r.pattern.encode(), text)) << k for k, r in enumerate(rules))
        assert (once.ends[state] if text else expected) == expected
    # No two states of the combined automaton are alike.
    whole = secrets.scanner_of(secrets.RULES).all
    reached = np.column_stack([whole.ends, whole.step.reshape(-1, whole.width)])
    assert len(np.unique(reached, axis=0)) == len(whole.ends)


def test_digests_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "é token = \"abcdefgh1\" 漢 AKIA" + "Z9" * 6 + " " + "0f" * 16, "x"), (3, "y" * 200_000 + " secret:12345678", "x")]
    rows += [rows[2], (4, "token: short", "x")]
    found = sorted(map(tuple, secrets.digests(secrets.secrets(documents(spark, rows))).collect()), key=repr)
    expected = []
    for i, t, _ in rows:
        spans = brute_secrets(t or "")
        named = [f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in spans]
        expected.append((i, *[sum(k == x for _, k, _ in spans) for x in range(3)],
                         hashlib.sha256(",".join(n for n, (_, k, _) in zip(named, spans) if k < 3).encode()).hexdigest(), ",".join(named)))
    assert found == sorted(expected, key=repr) and any(r[1] and r[2] and r[3] for r in found)
    assert secrets.digests(secrets.secrets(documents(spark, rows).limit(0))).count() == 0
    with pytest.raises(ValueError):
        secrets.Scanner((secrets.Rule("bad", r"a\b"),))
