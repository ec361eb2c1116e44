"""The registered queries: each applies its operator to its whole table.

Results are written once below the shared folder and read from there; the intermediate
tables are removed before a query returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (ann, bpe, chat, collocations, embedding_dedup, language_model, packing, quality_qda, secrets, simhash,
                           spelling, suffix_dedup, warc)
from orderlens.llm.common import table
from orderlens.session import Scratch, materialize


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op1") as scratch:
        return materialize(embedding_dedup.near_vectors(table(spark, folder, "embeddings"), scratch), "op1-result")


def op2_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op2") as scratch:
        return materialize(warc.archive_round_trip(table(spark, folder, "pages"), scratch), "op2-result")


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op3") as scratch:
        found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), scratch, passages=suffix_dedup.PASSAGE)
        return materialize(found.drop("th", "kept"), "op3-result")


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_chats(turns.union(added)))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op5") as scratch:
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
        return materialize(bpe.encode(table(spark, folder, "documents"), scratch, ranks, public_tokenizers.PATTERN), "op5-result")


def op6_hash_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op7") as scratch:
        statistics = scratch.keep(quality_qda.described(table(spark, folder, "documents")), "statistics")
        model = quality_qda.fit(statistics, table(spark, folder, "labels"))
        return materialize(quality_qda.scored(statistics, model), "op7-result")


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op8") as scratch:
        found = simhash.near_duplicates(table(spark, folder, "documents"), scratch)
        return materialize(found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"),
                                        "component_id"), "op8-result")


def op9_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op9") as scratch:
        return materialize(language_model.score(table(spark, folder, "documents"), scratch), "op9-result")


def op10_grouping_packing(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op10") as scratch:
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        found = scratch.keep(packing.pieces(table(spark, folder, "documents"), tokenizer, public_tokenizers.PATTERN), "tokens")
        return materialize(packing.pack(found, scratch), "op10-result")


def op11_son_collocations(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op11") as scratch:
        return materialize(collocations.collocations(table(spark, folder, "documents"), scratch), "op11-result")


def op12_spelling_kd_trees(spark: SparkSession, folder: str) -> DataFrame:
    with Scratch(spark, "op12") as scratch:
        return materialize(spelling.spelling_variants(table(spark, folder, "documents"), scratch), "op12-result")


def op13_secret_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_hash_prefix_forest": op6_hash_prefix_forest,
    "op7_quality_discriminant": op7_quality_discriminant,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_backoff_automaton": op9_backoff_automaton,
    "op10_grouping_packing": op10_grouping_packing,
    "op11_son_collocations": op11_son_collocations,
    "op12_spelling_kd_trees": op12_spelling_kd_trees,
    "op13_secret_automaton": op13_secret_automaton,
}

_CONTROL = "|".join(r"\|im_start\|> \|im_sep\|> \|im_turn\|> \|im_end\|> \|endoftext\|> s> /s> INST\] /INST\] <SYS>> </SYS>>".split())


def _escaped(value: str) -> str:
    return f"regexp_replace(replace({value}, '␛', '␛␛'), '([<\\[])({_CONTROL})', '\\1␛\\2', 'g')"


OP4_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(length({_escaped("text")})
        + CASE WHEN opens THEN length('<|im_start|><|im_sep|><|im_end|>') + 1 + length({_escaped("role")})
               ELSE length('<|im_turn|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP2_SQL = """
WITH paid AS (
    SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages),
sized AS (
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
        min(page_id) OVER (PARTITION BY payload_digest) AS least FROM paid)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM sized
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

OP11_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array({_LOWER("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size + 2, 1)),
        lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
inner_phrases AS (
    SELECT lang, a, unnest(list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
    FROM candidates, (SELECT unnest([2, 3, 4]) AS s) WHERE s < size),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
cut AS (
    SELECT c.lang, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM candidates c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size),
scored AS (
    SELECT cut.lang, cut.phrase, cut.a, l.f AS l, r.f AS r, n,
        CAST((1000::HUGEINT * cut.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score, k
    FROM cut JOIN counts l ON l.lang = cut.lang AND l.phrase = cut.first
        JOIN counts r ON r.lang = cut.lang AND r.phrase = cut.rest JOIN totals t ON t.lang = cut.lang
        LEFT JOIN covered v ON v.lang = cut.lang AND v.phrase = cut.phrase
    WHERE v.longer IS NULL OR 100 * v.longer < 100 * cut.a
    QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
"""

# Letters above ASCII as ASCII signs, for a distance in code points.
_ABOVE = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.islower())[:len(_ABOVE)].replace("'", "''")

OP12_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all({_LOWER("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (
    SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
        lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))), lambda c, b: list_reduce(
            list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) AS h
    FROM counted),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
        CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
plain AS (SELECT *, length(word) AS size, translate(word, '{_ABOVE}', '{_SIGNS}') AS signs FROM words),
sized AS (SELECT *, unnest([size - 1, size, size + 1]) AS other FROM plain),
near AS (
    SELECT a.word, a.n, count(*) AS n_near, min((-b.n, b.word)) AS best
    FROM sized a JOIN plain b ON a.other = b.size AND a.word <> b.word AND levenshtein(a.signs, b.signs) = 1
    GROUP BY a.word, a.n),
formed AS (SELECT word, best[2] AS form, -best[1] AS form_n FROM near WHERE -best[1] >= 5 * n),
chains AS (
    SELECT word, form AS root FROM formed
    UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root),
roots AS (SELECT word, root FROM chains WHERE root NOT IN (SELECT word FROM formed))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM words w LEFT JOIN formed USING (word) LEFT JOIN roots USING (word) LEFT JOIN near USING (word)
"""


def _secrets_of(number: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return rf"""
    SELECT row, doc_id, {number} AS rule, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
        size := length(g[i]), stop := length(array_to_string(p[:i], '')) + length(array_to_string(m[:i], '')), own := length(m[i]))),
        recursive := true)
    FROM (SELECT row, doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
        regexp_split_to_array(text, '{pattern}') AS p FROM texts)
    WHERE len(m) > 0"""


OP13_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
least AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r.least})" for i, r in enumerate(secrets.RULES))}) t(rule, least)),
matched AS ({" UNION ALL ".join(_secrets_of(i, r) for i, r in enumerate(secrets.RULES))}),
found AS (
    SELECT row, rule, stop - own AS start, concat(kind, ':', stop - own, ':', stop) AS span
    FROM matched JOIN least USING (rule) WHERE size >= least),
listed AS (
    SELECT row, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans
    FROM found GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""

SQL: dict[str, str] = {"op2_warc_chunks": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op11_son_collocations": OP11_SQL,
                       "op12_spelling_kd_trees": OP12_SQL, "op13_secret_automaton": OP13_SQL}
