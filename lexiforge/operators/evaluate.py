"""Retrieval metrics, answer checks and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import REFUSAL, eval_norm


def retrieval_metrics(hits: DataFrame, gold: DataFrame, depths: tuple[int, ...] = (1, 3, 6, 10)) -> DataFrame:
    """(qid, hit_at_k…, rr, cov_at_6, depth_at_6) from hits(qid, rank, paper) and gold(qid, papers), ranks counting chunks."""
    rows = gold.join(hits, "qid", "left").withColumn("good", F.coalesce(F.array_contains("papers", F.col("paper")), F.lit(False)))
    first = F.min(F.when(F.col("good"), F.col("rank")))
    found = F.count_distinct(F.when(F.col("good") & (F.col("rank") <= 6), F.col("paper")))
    deep = F.sum(F.when(F.col("good") & (F.col("rank") <= 6), 1).otherwise(0))
    each = rows.groupBy("qid").agg(first.alias("first"), found.alias("found"), deep.alias("deep"), F.max(F.size("papers")).alias("wanted"))
    hit = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit_at_{k}")
    return each.select("qid", *map(hit, depths), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("found") / F.col("wanted"), 6).alias("cov_at_6"), F.round(F.col("deep") / 6, 6).alias("depth_at_6"))


def metric_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metrics, in total and by each of the given columns, in one plan of grouping sets."""
    names = [c for c in metrics.columns if c not in ("qid", *by)]
    sets = [[F.col(b)] for b in by] + [[]]
    return metrics.groupingSets(sets, *by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def evidence(contexts: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, evidence): whether all strings that gold(qid, must_include) needs are in the context; null where none is needed."""
    text = eval_norm(F.coalesce("context", F.lit("")))
    all_ = F.forall("must_include", lambda s: F.contains(text, eval_norm(s)))
    return gold.join(contexts, "qid", "left").select("qid", F.when(F.size("must_include") > 0, all_.cast("int")).alias("evidence"))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(eval_norm(text), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def leaked_numbers(answer: Column, passages: Column) -> Column:
    """Numbers of the answer that the passages have too, but years and 0, 1, 2; repeated as often as the answer repeats them."""
    known = numbers_in(passages)
    return F.filter(numbers_in(F.replace(answer, F.lit(REFUSAL), F.lit(""))), lambda n: F.array_contains(known, n) & ~n.rlike(r"^(19|20)\d\d$") & ~n.isin("0", "1", "2"))


def auto_checks(answers: DataFrame) -> DataFrame:
    """answers(qid, type, text, must_include, cited, dropped, refused, context, no_metric) with each check and auto_pass, their conjunction.

    Unanswerable questions must be refused without leaking numbers; others must contain what is asked, cite, and
    not refuse. no_metric marks questions whose source reports none, so that any is invented.
    """
    text = eval_norm(F.col("text"))
    un = F.col("type") == "unanswerable"
    missing = F.filter("must_include", lambda s: ~F.contains(text, eval_norm(s)))
    bare = F.regexp_replace(text, r"\[\d+\]", "")
    invented = bare.rlike(r"\d(?:\.\d+)?\s*%") | bare.rlike(r"\b(mape|rmse)\b[^.\n]{0,25}\d")
    rows = answers.withColumns(
        {
            "refused_ok": F.when(un, F.startswith(F.trim("text"), F.lit(REFUSAL))),
            "leaked": F.when(un, leaked_numbers(F.col("text"), F.col("context"))),
            "missing": F.when(~un, missing),
            "has_citation": F.when(~un, F.size("cited") > 0),
            "not_refused": F.when(~un, ~F.col("refused")),
            "citations_valid": F.size("dropped") == 0,
            "no_invented_metric": F.when(F.col("no_metric"), ~invented),
        }
    )
    yes = lambda c: F.coalesce(c, F.lit(True))
    passed = yes(F.col("refused_ok")) & yes(F.size("leaked") == 0) & yes(F.size("missing") == 0) & yes(F.col("has_citation")) & yes(F.col("not_refused")) & F.col("citations_valid") & yes(F.col("no_invented_metric"))
    return rows.withColumn("auto_pass", F.when(un, F.col("refused_ok") & (F.size("leaked") == 0) & F.col("citations_valid") & yes(F.col("no_invented_metric"))).otherwise(passed))


def answer_summary(judged: DataFrame) -> DataFrame:
    """By type and in total: n, accuracy (judged 2), mean score, refusals, cost, true median latency of judged(type, judge, refused, cost, latency)."""
    return judged.groupingSets([[F.col("type")], []], "type").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("judge") == 2).cast("int")), 6).alias("accuracy"), F.round(F.avg("judge"), 6).alias("mean_score"),
        F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"), F.round(F.sum("cost"), 6).alias("cost"), F.median("latency").alias("median_latency"),
    )


def size_histogram(chunks: DataFrame, edges: tuple[int, ...] = (0, 100, 200, 300, 400, 450, 513)) -> DataFrame:
    """(bucket, n) of n_tokens by the lower edge of its bucket."""
    bucket = F.lit(None).cast("int")
    for low, high in zip(edges, edges[1:], strict=False):
        bucket = F.when((F.col("n_tokens") >= low) & (F.col("n_tokens") < high), F.lit(low)).otherwise(bucket)
    return chunks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def upper_median(values: Column) -> Column:
    """The middle value, of an even number the upper one."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
