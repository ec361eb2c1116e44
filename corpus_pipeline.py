"""From raw documents to packed training sequences, one operator after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import packing, quality_qda, simhash, suffix_dedup
from orderlens.llm.common import fresh, table
from orderlens.session import Scratch, materialize, scratch_path

#: A passage is cut if it has so many bytes that stand elsewhere too in one piece, and more than so many words.
PASSAGE_BYTES, PASSAGE_WORDS = 150, 50
#: Batches of the suffix arrays: fewer write less, more hold less at a time.
PASSAGE_BATCHES = 2


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with their id (null: the least long) and the hash of their text, by which operators know them, and the
    names of both columns, which no column of the rows has."""
    doc, th = fresh("row doc", docs), fresh("row th", docs)
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)),
                             th: F.xxhash64(F.coalesce("text", F.lit("")))}), doc, th


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts, all columns as they are.

    The model is fitted on labelled documents of the input outside the held-out fold, ``quality_qda.FIT_ROWS`` at most.
    Null texts are empty and judged like any other; null ids are in no label. Repeated rows are judged each. No rows give none.
    """
    with Scratch(spark, "quality") as scratch:
        labels = table(spark, sf_dir, "labels")
        statistics = scratch.keep(quality_qda.described(quality_qda.labelled(docs, labels)), "statistics")
        model = quality_qda.fit(statistics, labels)
    return quality_qda.accepted(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that the SimHash operator links, all columns as they are.

    The one with the least id stays (null: before all), with the least text hash among repeated ids; of rows with equal id and
    text any one. Null texts and texts without words have fingerprint zero and are one group. No rows give none.
    """
    keyed, doc, th = _keyed(docs)
    with Scratch(spark, "near") as scratch:
        found = simhash.near_duplicates(keyed, scratch, simhash.SHINGLE, simhash.RADIUS, id_column=doc)
        firsts = found.groupBy("component").agg(F.min(F.struct("id", "th")).alias("first"))
        stays = materialize(firsts.select(F.col("first.id").alias(fresh("stay doc", keyed)),
                                          F.col("first.th").alias(fresh("stay th", keyed))), "near-stays")
    same = (F.col(doc) == F.col(stays.columns[0])) & (F.col(th) == F.col(stays.columns[1]))
    return keyed.join(stays, same, "left_semi").dropDuplicates([doc, th]).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat anywhere out of the texts, in every place they stand; ``n_chars``, if there, follows.

    A passage is a longest run of bytes under strings of ``PASSAGE_BYTES`` that start elsewhere too, with more than
    ``PASSAGE_WORDS`` words; texts are cut at whole characters. Other columns and rows stay as they are, null texts, null ids
    and texts without such a passage too. Repeated rows repeat their passages. No rows give none.
    """
    keyed, doc, th = _keyed(docs)
    own = [fresh(name, keyed) for name in ("cut doc", "cut th", "cut text")]
    with Scratch(spark, "passages") as scratch:
        found = suffix_dedup.remove_repeats(docs, scratch, PASSAGE_BYTES, PASSAGE_BATCHES, with_text=True, words=PASSAGE_WORDS)
        cut = materialize(found.where("kept IS NOT NULL").select(
            F.coalesce("doc_id", F.lit(-1 << 63)).alias(own[0]), F.col("th").alias(own[1]),
            F.col("kept").cast("string").alias(own[2])).dropDuplicates(own[:2]), "passages-cut")
    joined = keyed.join(cut, (F.col(doc) == F.col(own[0])) & (F.col(th) == F.col(own[1])), "left")
    left = F.col(own[2])
    return joined.select(*[F.coalesce(left, c).alias(c) if c == "text" else
                           F.when(left.isNotNull(), F.length(left)).otherwise(F.col(c)).cast(t).alias(c)
                           if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences: one row per piece of a document. Null texts are empty, null ids stay, repeated rows
    are packed each, and other columns are not read. No rows give none."""
    with Scratch(spark, "packing") as scratch:
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        pieces = scratch.keep(packing.pieces(docs, tokenizer, public_tokenizers.PATTERN), "tokens")
        return materialize(packing.pack(pieces, scratch), "packed")


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup),
          ("suffix-array dedup", suffix_array_dedup), ("best-fit packing", best_fit_packing)]

#: No stage can be said in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
