"""The queries of this subpackage, each over its whole table, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import context_mixing, exact_dedup, mixing, near_dedup, packing, pii, quality, sharding, suffix_dedup, token_files
from lexiforge.llm.common import word_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_count("text"), order=("text",))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_documents(documents(spark, sf_dir).select("doc_id", "source", "text"), word_count("text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op8_sql() -> str:
    """The rules of quality.RULES in SQL, with sketches as counts by log bucket."""
    ratios = ", ".join(f"('{r.name}', {r.ratio.replace(' div ', ' // ')}, {r.slack}, {r.spread}, {str(r.lower).lower()})" for r in quality.RULES)
    level = """
      SELECT {keys} rule, any_value(slack) slack, any_value(spread) spread, any_value(lower_) lower_, max(of) AS of,
             min(CASE WHEN 4 * upto >= of THEN bucket END) q1, min(CASE WHEN 4 * upto >= 2 * of THEN bucket END) q2, min(CASE WHEN 4 * upto >= 3 * of THEN bucket END) q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} rule ORDER BY bucket) upto, sum(n) OVER (PARTITION BY {keys} rule) AS of
            FROM (SELECT {keys} rule, slack, spread, lower_, bucket, count(*) n FROM cells GROUP BY ALL)) GROUP BY {keys} rule"""
    value = "CASE WHEN {q} < 0 THEN 0.0 ELSE 2.0 / 2.02 * pow(1.02, {q}) END"
    bound = "SELECT *, floor(CASE WHEN lower_ THEN v2 - greatest(slack, spread * (v2 - v1)) ELSE v2 + greatest(slack, spread * (v3 - v2)) END) bound FROM (SELECT *, " + ", ".join(f"{value.format(q=f'q{k}')} v{k}" for k in (1, 2, 3)) + " FROM ({level}))"
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS row_, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row_, unnest(range(len(w) - 2)) AS p, w FROM words WHERE len(w) > 2),
twice AS (SELECT row_, p, count(*) OVER (PARTITION BY row_, w[p + 1], w[p + 2], w[p + 3]) > 1 AS again FROM windows),
covered AS (SELECT row_, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) WHERE again GROUP BY row_),
counted AS (
  SELECT row_, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_distinct,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (row_)),
base AS (SELECT *, n_lines - n_distinct AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
ratios AS (SELECT row_, lang, source, base_failed, r.* FROM base, LATERAL (SELECT * FROM (VALUES {ratios}) AS v(rule, x, slack, spread, lower_)) AS r),
cells AS (SELECT lang, source, rule, slack, spread, lower_, CASE WHEN x < 1 THEN -1 ELSE ceil(ln(x) / ln(1.02)) END AS bucket FROM ratios WHERE NOT base_failed),
fine AS ({bound.format(level=level.format(keys='lang, source, '))}),
middle AS ({bound.format(level=level.format(keys='lang, '))}),
top AS ({bound.format(level=level.format(keys=''))}),
chosen AS (
  SELECT f.lang, f.source, f.rule, CASE WHEN f.of >= 100 THEN f.bound WHEN m.of >= 100 THEN m.bound ELSE t.bound END AS bound
  FROM fine f JOIN middle m ON f.lang IS NOT DISTINCT FROM m.lang AND f.rule = m.rule JOIN top t ON f.rule = t.rule),
failed AS (
  SELECT DISTINCT row_ FROM ratios r JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source AND r.rule = c.rule
  WHERE CASE WHEN r.lower_ THEN r.x < c.bound ELSE r.x > c.bound END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.row_ IS NULL AS kept, n_lines
FROM base LEFT JOIN failed f USING (row_)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_personal_data": op2_personal_data,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_token_files": op5_token_files,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_context_mixing": op9_context_mixing,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_quality_rules": op8_sql()}
