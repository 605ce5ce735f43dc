"""Queries opN_* over the driver's tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, exact_dedup, lm_scoring, mixing, piece_codec, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model() -> str:
    """The public tokenizer's model file; TIDEMARK_PIECE_MODEL names another."""
    import os

    if at := os.environ.get("TIDEMARK_PIECE_MODEL"):
        return at
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_docs(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, quality_classifier.grades(labels))
    return quality_classifier.scored(docs, model, wanted=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_docs(spark, sf_dir), piece_model())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id", "component_size")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_docs(spark, sf_dir)).drop("row")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(_docs(spark, sf_dir), piece_model())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_docs(spark, sf_dir), contents=False).drop("spans")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.paired_by_id(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_exact_dedup, op4_lm_scoring, op5_simhash, op6_quality_rules, op7_source_mix, op8_sentencepiece, op9_suffix_dedup, op10_preference_format)}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM r, range(5) AS t(k) GROUP BY doc_id
), l AS (
  SELECT DISTINCT doc_id, source, line FROM (
    SELECT doc_id, source, trim(regexp_replace(lower(unnest(lines)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d)
), f AS (
  SELECT source, line FROM l GROUP BY source, line HAVING count(*) > 100
), e AS (
  SELECT doc_id, CAST(sum(len(string_split(x.line, ' '))) AS BIGINT) AS removed_words
  FROM (SELECT doc_id, source, trim(regexp_replace(lower(unnest(lines)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d) x
  JOIN f ON x.line = f.line AND x.source IS NOT DISTINCT FROM f.source GROUP BY doc_id
), o AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(e.removed_words, 0) AS removed_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM o
"""


OP1_SQL = r"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][.!?"'')\]]*[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*)', '\1' || chr(57344), 'g'), chr(57344)) AS us
  FROM documents
), l AS (
  SELECT doc_id, i, unit, CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, unnest(us) AS unit, unnest(range(1, len(us) + 1)) AS i FROM s)
), r AS (
  SELECT *, start + length(unit) AS stop, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words,
         norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS again FROM l
), n AS (
  SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), g AS (
  SELECT *, again AND sum(CASE WHEN again AND words >= 2 THEN words ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 25 AS gone FROM n
), c AS (
  SELECT doc_id, run, min(start) || '-' || max(stop) AS span, min(start) AS pos FROM g WHERE gone GROUP BY doc_id, run
), p AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY pos) AS spans FROM c GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN unit END, '' ORDER BY i), '') AS text,
         CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(coalesce(sum(stop - start) FILTER (gone), 0) AS BIGINT) AS removed_chars
  FROM g GROUP BY doc_id
)
SELECT d.*, coalesce(p.spans, '') AS spans FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i
), n AS (
  SELECT pair_id, CAST(coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS BIGINT) AS n FROM m GROUP BY pair_id
), r AS (
  SELECT t.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)
), p AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r
)
SELECT pair_id, any_value(n) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n), '') END AS chosen,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg((CAST(pos AS BIGINT) + 13 + length(role)) || '-' || (CAST(pos AS BIGINT) + 23 + length(role) + length(text)), ',' ORDER BY i)
         FILTER (side = 0 AND i > n AND role = 'assistant'), '') END AS chosen_mask,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n), '') END AS rejected,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg((CAST(pos AS BIGINT) + 13 + length(role)) || '-' || (CAST(pos AS BIGINT) + 23 + length(role) + length(text)), ',' ORDER BY i)
         FILTER (side = 1 AND i > n AND role = 'assistant'), '') END AS rejected_mask
FROM p GROUP BY pair_id
"""

OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()), cap) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor((t.target + 1e-6) / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, floor(target + 1e-6) - epochs * source_size - start)) AS BIGINT) AS taken
FROM p
"""


def oracle_sql() -> dict:
    return {"op1_substring_dedup": OP1_SQL, "op10_preference_format": OP10_SQL, "op3_exact_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL, "op7_source_mix": OP7_SQL}
