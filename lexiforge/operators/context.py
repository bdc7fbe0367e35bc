"""From hits to cited context: neighbours, referenced tables, formatting, citations, source cards, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import REFUSAL, sentences, snippet, strip_markers
from lexiforge.functions.udfs import validate_citations


def neighbours(hits: DataFrame, chunks: DataFrame, span: int = 1) -> DataFrame:
    """(qid, n, paper_id, seq, text, own) of the hits(qid, n, paper_id, seq, heading) and the prose around them.

    Neighbours share paper and heading. A chunk is shown once for each question: hits claim theirs first, then
    passages in their order. The band is a few places wide, so it is an equi-join on (paper_id, seq).
    """
    around = hits.withColumn("d", F.explode(F.sequence(F.lit(-span), F.lit(span))))
    wanted = around.select("qid", "n", "paper_id", "heading", (F.col("seq") + F.col("d")).cast("long").alias("seq"), (F.col("d") == 0).alias("own"))
    c = chunks.select("paper_id", F.col("seq").cast("long").alias("seq"), F.col("heading").alias("c_heading"), "kind", "text")
    rows = wanted.join(c, ["paper_id", "seq"]).where("own OR (kind = 'prose' AND heading <=> c_heading)")
    claim = F.row_number().over(Window.partitionBy("qid", "paper_id", "seq").orderBy(F.desc("own"), "n"))
    return rows.withColumn("claim", claim).where("claim = 1").select("qid", "n", "paper_id", "seq", "text", "own")


def widened(shown: DataFrame) -> DataFrame:
    """(qid, n, paper_id, text): each passage with its neighbours in reading order."""
    return shown.groupBy("qid", "n", "paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


TABLE_REFERENCE = r"\bTable\s+(\d+|[IVX]+)\b"


def referenced_tables(passages: DataFrame, chunks: DataFrame, shown: DataFrame, most: int = 3) -> DataFrame:
    """(qid, n, paper_id, seq, number): tables that passages(qid, n, paper_id, text) mention, of the same paper, not shown yet, at most most a question.

    The number is extracted on both sides, which makes the match an equi-join.
    """
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(TABLE_REFERENCE), F.lit(1)))
    asked = passages.select("qid", "n", "paper_id", F.posexplode(named).alias("nth", "number"))
    tables = chunks.where("kind = 'table'").select("paper_id", F.col("seq").cast("long").alias("seq"), F.regexp_extract("heading", r"^(?:Table|TABLE)\s+(\d+|[IVX]+)\b", 1).alias("number")).where("number != ''")
    rows = asked.join(tables, ["paper_id", "number"]).join(shown.select("qid", "paper_id", "seq"), ["qid", "paper_id", "seq"], "left_anti")
    first = F.row_number().over(Window.partitionBy("qid", "paper_id", "seq").orderBy("n", "nth"))
    rows = rows.withColumn("first", first).where("first = 1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("n", "nth", "seq"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("qid", "n", "paper_id", "seq", "number", "place")


def formatted(passages: DataFrame) -> DataFrame:
    """(qid, context): passages(qid, n, chunk_id, cite, heading, page_start, page_end, text) numbered and joined by blank lines."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p."), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("pp."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    one = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.concat_ws(" · ", "chunk_id", "cite", "heading", pages), F.lit("\n"), F.col("text"))
    return passages.select("qid", "n", one.alias("one")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "one"))), lambda x: x["one"]), "\n\n").alias("context"))


def checked_answers(answers: DataFrame) -> DataFrame:
    """answers(text, n_passages) with clean text, cited, dropped, refused and uncited."""
    rows = answers.withColumn("_c", validate_citations(F.col("text"), F.col("n_passages")))
    refused = F.startswith(F.trim(F.col("_c.text")), F.lit(REFUSAL))
    return rows.withColumns({"text": F.col("_c.text"), "cited": F.col("_c.cited"), "dropped": F.col("_c.dropped")}).withColumns({"refused": refused, "uncited": ~refused & (F.size("cited") == 0)}).drop("_c")


def source_cards(passages: DataFrame, papers: DataFrame) -> DataFrame:
    """passages(qid, n, paper_id, text) with doi, collection and a snippet; unknown papers get '' and 'core'."""
    rows = passages.join(papers.select("paper_id", "doi", "collection"), "paper_id", "left")
    return rows.select("qid", "n", "paper_id", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("collection", F.lit("core")).alias("collection"), snippet(F.col("text")).alias("snippet"))


def cited_sources(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, pos, n, paper_id): passages in the order in which an answer first cites them."""
    used = answers.select("qid", F.posexplode("cited").alias("pos", "n"))
    return used.join(passages.select("qid", "n", "paper_id"), ["qid", "n"])


def history(turns: DataFrame, most: int = 8, chars: int = 2000) -> DataFrame:
    """(conv_id, pos, role, text): the last turns of turns(conv_id, turn, role, text), beginning with a user and ending with an assistant.

    Neighbours of one role become one turn; runs are islands of equal roles.
    """
    by = Window.partitionBy("conv_id")
    recent = turns.withColumn("back", F.row_number().over(by.orderBy(F.desc("turn")))).where(F.col("back") <= most)
    recent = recent.withColumn("users", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by.orderBy("turn"))).where("users > 0")
    change = (F.col("role") != F.lag("role").over(by.orderBy("turn"))).cast("int")
    runs = recent.withColumn("pos", F.sum(F.coalesce(change, F.lit(0))).over(by.orderBy("turn")))
    merged = runs.groupBy("conv_id", "pos", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    last = F.max("pos").over(by)
    kept = merged.withColumn("last", last).where("NOT (pos = last AND role = 'user')")
    return kept.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", F.substring("text", 1, chars).alias("text"))


def extractive_answers(passages: DataFrame) -> DataFrame:
    """(qid, text): the first sentence of each of the first two passages, cited; the refusal where there is none.

    This is the offline answerer; a model client has the same signature.
    """
    first = F.concat(strip_markers(F.coalesce(F.get(sentences(F.col("text")), 0), F.col("text"))), F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    rows = passages.where("n <= 2").select("qid", "n", first.alias("one"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "one"))), lambda x: x["one"]), " ").alias("text"))


def in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows of each (qid, ids array) in the given order; unknown ids are skipped."""
    wanted = ids.select("qid", F.posexplode("ids").alias("pos", key))
    return wanted.join(rows, key)
