"""Cleaning of lines and blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import is_boilerplate, is_licence_block, is_page_number, line_key, n_words
from lexiforge.functions.udfs import without_near_repeats
from lexiforge.operators.hyphens import join_lines

#: Blocks of these kinds carry markers whose text is equal by design.
PROTECTED = ("equation", "table")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line_no, line) for each line of each text, from 0."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def repeated_lines(lines: DataFrame, share: float = 0.5, least_pages: int = 3, least_key: int = 6) -> DataFrame:
    """(doc, key, n, pages) of lines(doc, page, line) whose key stands on at least half of a document's pages.

    A key counts once a page; documents under least_pages pages have none. Both sums are keyed by document.
    """
    keyed = lines.select("doc", "page", line_key(F.col("line")).alias("key"))
    pages = keyed.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    hits = keyed.where(F.length("key") >= least_key).select("doc", "page", "key").distinct().groupBy("doc", "key").agg(F.count("*").alias("n"))
    return hits.join(pages, "doc").where(F.col("n") >= share * F.col("pages")).select("doc", "key", "n", "pages")


def drop_reasons(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """lines(doc, page, block, kind, line, y, height) with reason: why a line goes, or null. The first that holds counts.

    A licence notice goes with its whole block; then page numbers in the margins, repeated lines, and patterns.
    Protected kinds stay.
    """
    blocks = lines.groupBy("doc", "page", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], " ").alias("block_text"))
    rows = lines.join(blocks, ["doc", "page", "block"]).withColumn("key", line_key(F.col("line"))).join(repeated.select("doc", "key", F.lit(True).alias("_again")), ["doc", "key"], "left")
    reason = (
        F.when(F.col("kind").isin(*PROTECTED), None)
        .when(is_licence_block(F.col("block_text")), "licence")
        .when(is_page_number(F.col("line"), F.col("y"), F.col("height")), "page_number")
        .when(F.col("_again"), "repeated")
        .when(is_boilerplate(F.col("line")), "boilerplate")
    )
    return rows.withColumn("reason", reason).drop("_again", "key", "block_text")


def dropped_counts(reasons: DataFrame) -> DataFrame:
    """(doc, dropped): how often each reason held, as a map."""
    each = reasons.where("reason IS NOT NULL").groupBy("doc", "reason").agg(F.count("*").alias("n"))
    return each.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("dropped"))


def figure_labels(blocks: DataFrame, most_words: int = 3, least: int = 4) -> DataFrame:
    """blocks(doc, kind, text) with figure_label: short texts that a document repeats."""
    n = F.count("*").over(Window.partitionBy("doc", "text"))
    return blocks.withColumn("figure_label", (F.col("kind") == "text") & (n_words(F.col("text")) <= most_words) & (n >= least))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, word, n): words of ASCII letters, lower-cased."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z]+)"), F.lit(1)))
    return docs.select(F.col(id_col).alias("doc"), words.alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


def near_repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_lines, n_kept, text): a fold over each document's lines, since a line is compared with the last that was kept."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(F.col(id_col).alias("doc"), F.size(lines).alias("n_lines"), without_near_repeats(lines).alias("kept"))
    return rows.select("doc", "n_lines", F.size("kept").alias("n_kept"), F.array_join("kept", "\n").alias("text"))


def dehyphenate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text): lines joined; a hyphen at a line's end goes unless the document knows the compound, or both halves, by themselves.

    A fold over the lines, with the document's own word counts as a map.
    """
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: join_lines(t.split("\n")))

    return docs.select(F.col(id_col).alias("doc"), run(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
