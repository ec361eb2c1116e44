"""The pipeline stage by stage against brute force, and its contract."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from orderlens.llm import quality_qda, simhash, suffix_dedup
from orderlens.session import Scratch, scratch_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = docs.collect(), out.collect(), docs.columns, out.columns
        docs = out
    return seen


def test_all_but_the_last_return_documents(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    for name in names[:-1]:
        _, _, before, after = stages[name]
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_what_the_model_accepts(spark, stages):
    before, after, *_ = stages["quality classifier"]
    with Scratch(spark, "q") as scratch:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        model = quality_qda.fit(scratch.keep(quality_qda.described(docs), "x"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    x = np.array([quality_qda.statistics((r.text or "").encode()) for r in before])
    kept = {r.doc_id for r, s in zip(before, model.scores(x)) if s >= quality_qda.CUT}
    assert {r.doc_id for r in after} == kept and len(kept) < len(before)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after, *_ = stages["SimHash near-dedup"]
    fps = np.array([simhash.fingerprint((r.text or "").encode()) for r in before], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    ids, label = [r.doc_id for r in before], list(range(len(before)))
    for _ in range(len(before)):
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(before))]
        if new == label:
            break
        label = new
    groups = {}
    for i, group in zip(ids, label):
        groups.setdefault(group, []).append(i)
    assert {r.doc_id for r in after} == {min(g) for g in groups.values()} and len(after) < len(before)


def test_repeated_passages_are_cut(stages):
    before, after, *_ = stages["suffix-array dedup"]
    length, data = corpus_pipeline.PASSAGE_BYTES, {r.doc_id: (r.text or "").encode() for r in before}
    counts = Counter(d[i:i + length] for d in data.values() for i in range(len(d) - length + 1))
    left = {r.doc_id: r for r in after}
    assert left.keys() == data.keys()
    changed = 0
    for i, d in data.items():
        hits = np.array([k for k in range(len(d) - length + 1) if counts[d[k:k + length]] > 1], np.int64)
        spans = [(s, e) for s, e in suffix_dedup._spans(hits, hits + length) if len(d[s:e].split()) > corpus_pipeline.PASSAGE_WORDS]
        expected = suffix_dedup._whole_characters(d, spans).decode()
        assert left[i].text == expected and (not spans or left[i].n_chars == len(expected))
        changed += bool(spans)
    assert changed


def test_what_is_left_is_packed_whole(stages):
    from tokenizers import Tokenizer
    before, after, *_ = stages["best-fit packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in before}
    covered, fill = Counter(), Counter()
    for r in after:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_gives_the_last_stage(spark, stages):
    _, packed, _, columns = stages["best-fit packing"]
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == columns
    fixed = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in fixed) for r in found.collect()) == sorted(tuple(r[c] for c in fixed) for r in packed)


ODD = "doc_id long, text string, lang string, source string, n_chars long, doc string, th string, kept string, `row doc` string, " \
      "`row th` string, `CUT text` string, `labelled id` string, batch string"


def odd_rows():
    passage = " ".join(f"word{i}" for i in range(90))
    texts = [(1, None), (2, ""), (None, "no id at all"), (3, passage + " and an end"), (4, "another start " + passage), (4, "another start " + passage),
             (5, "same id"), (5, "same id but another text of other words"), (6, "x" * 200_000), (7, "w " * 60_000)]
    return [(i, t, "en", "s", len(t or ""), *(f"{c}{n}" for c in ("doc", "th", "kept", "rd", "rt", "ct", "li", "ba"))) for n, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name_and_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(odd_rows(), ODD)
    rows = [tuple(r) for r in stage(spark, docs, SMALL).collect()]
    given = {tuple(r) for r in docs.collect()}
    if name == "suffix-array dedup":
        left = {r[5]: r for r in rows}
        assert len(rows) == len(given) and {r[5:] for r in rows} == {r[5:] for r in given}
        # Repeated rows repeat their text, which goes whole; so does the passage in the third place.
        assert [left[f"doc{n}"][1] for n in (3, 4, 5)] == [" and an end", "", ""]
        assert [left[f"doc{n}"][4] for n in (3, 4, 5)] == [11, 0, 0]
        assert all(left[f"doc{n}"][:5] == odd_rows()[n][:5] for n in (0, 1, 2, 6, 7, 8))
    else:
        assert set(rows) <= given and len(rows) == len(set(rows))
    if name == "SimHash near-dedup":
        texts = sorted((r[0] or 0, r[1]) for r in rows)
        # Empty texts are one group; of repeated rows one stays, of a repeated id both texts.
        assert [i for i, _ in texts] == [0, 1, 3, 4, 5, 5, 6, 7]
    empty = stage(spark, docs.limit(0), SMALL)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    found = corpus_pipeline.best_fit_packing(spark, docs, SMALL).collect()
    pieces = Counter(r.doc_id for r in found if r.piece == 0)
    assert pieces == Counter(i for i, *_ in odd_rows())
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), SMALL).count() == 0
