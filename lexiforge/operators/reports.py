"""Inspection of parsed documents, comparison of parsers, and estimates of cost before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import n_words, parser_norm


def layout_votes(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc, voted, stated, agrees): the layout of most pages(doc, page, layout) against manifest(doc, layout); of equals the first by name."""
    each = pages.groupBy("doc", "layout").agg(F.count("*").alias("n"))
    best = each.groupBy("doc").agg(F.min_by("layout", F.struct(F.negative("n"), "layout")).alias("voted"))
    return best.join(manifest.select("doc", F.col("layout").alias("stated")), "doc", "left").withColumn("agrees", F.col("voted").eqNullSafe(F.col("stated")))


def is_junk(text: Column) -> Column:
    """Under 55 % letters among what isn't white space, or under 4 words."""
    solid = F.regexp_replace(text, r"\s", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    return (100 * letters < 55 * F.length(solid)) | (n_words(text) < 4)


def parser_scores(blocks: DataFrame, by: str = "parser") -> DataFrame:
    """(parser, blocks, words, junk_rate, inline_formulas, latex_equations) of blocks(parser, doc, kind, text, latex)."""
    return blocks.groupBy(by).agg(
        F.count("*").alias("blocks"),
        F.sum(n_words(F.col("text"))).alias("words"),
        F.round(F.avg(is_junk(F.col("text")).cast("int")), 6).alias("junk_rate"),
        F.sum(F.floor((F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit("")))) / 2)).alias("inline_formulas"),
        F.sum(((F.col("kind") == "equation") & F.col("latex").isNotNull()).cast("int")).alias("latex_equations"),
    )


def common_documents(blocks: DataFrame, parsers: list[str]) -> DataFrame:
    """Documents for which every parser has output."""
    found = blocks.select("doc", "parser").distinct().where(F.col("parser").isin(parsers)).groupBy("doc").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(parsers)).select("doc")


def gold_coverage(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """(parser, found, wanted): how many strings of gold(doc, string) the texts(parser, doc, text) contain, both normalised."""
    both = gold.join(texts, "doc").withColumn("hit", F.contains(parser_norm(F.col("text")), parser_norm(F.col("string"))))
    return both.groupBy("parser").agg(F.sum(F.col("hit").cast("int")).alias("found"), F.count("*").alias("wanted"))


def has_core_sections(sections: DataFrame) -> DataFrame:
    """(doc, complete): abstract and conclusion are among the labels."""
    return sections.groupBy("doc").agg((F.size(F.array_except(F.array(F.lit("abstract"), F.lit("conclusion")), F.collect_set("label"))) == 0).alias("complete"))


def cost_estimate(questions: DataFrame, price_in: float, price_out: float, context_chars: int, answer_tokens: int = 350, judge: float = 0.0) -> DataFrame:
    """One row: estimated tokens and cost; 3.5 characters are a token."""
    tokens = F.sum((F.length("question") + context_chars) / 3.5)
    n = F.count("*")
    return questions.agg(tokens.alias("tokens_in"), (n * answer_tokens).alias("tokens_out")).withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6 * (1 + judge))


def guarded(estimate: DataFrame, limit: float) -> float:
    """The estimated cost, if it is within the limit."""
    cost = estimate.first()["cost"] or 0.0
    if cost > limit:
        raise ValueError(f"the run would cost {cost:.2f}, more than {limit:.2f}")
    return cost
