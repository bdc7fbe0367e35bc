"""Turns of a conversation: what to search for, and whether the passages of the last answer serve again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import rewrite_line, wants_same
from lexiforge.operators.context import in_order

#: Requests that only concern style.
STYLE = r"(?i)\b(simpl\w*|like i'?m|eli5|shorter|rephrase|bullet|in (english|indonesian))\b"


def rule_reply(messages: DataFrame) -> DataFrame:
    """messages(qid, message) with reply: the offline planner; a model client fills the same column."""
    return messages.withColumn("reply", F.when(F.col("message").rlike(STYLE), "SAME").otherwise(F.concat(F.lit("SEARCH: "), F.col("message"))))


def plan(turns: DataFrame, most_chars: int = 500) -> DataFrame:
    """turns(qid, message, last_question, reuse_ids, reply) with search and reuse.

    A first message is searched as it is. A reply SAME reuses the last passages if there are any; one without SEARCH or SAME,
    or a null one (an error), searches the last question and the message.
    """
    first = F.col("last_question").isNull()
    fallback = F.trim(F.concat_ws(" ", "last_question", "message"))
    reply = F.coalesce("reply", F.lit(""))
    reuse = ~first & wants_same(reply) & (F.size(F.coalesce("reuse_ids", F.array().cast("array<long>"))) > 0)
    search = F.when(first, F.col("message")).when(reuse, None).otherwise(F.coalesce(F.substring(rewrite_line(reply), 1, most_chars), fallback))
    return turns.withColumns({"reuse": reuse, "search": search})


def reused(turns: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, n, …): the chunks (with id) of turns that reuse, in their old order; ids that are gone are skipped."""
    rows = in_order(turns.where("reuse").select("qid", F.col("reuse_ids").alias("ids")), chunks, "id")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).drop("pos")


def lost(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns that wanted to reuse and found nothing: they search."""
    return turns.where("reuse").join(found.select("qid").distinct(), "qid", "left_anti")
