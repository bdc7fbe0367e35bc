"""Hybrid retrieval for batches of questions: BM25, exact nearest neighbours, rank fusion, and choice of hits.

Statistics of BM25 are those of the whole corpus; filters apply to scored rows. Ties always go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import query_terms, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): the inverted index as a table; partition it by term to keep it."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return rows.select("id", F.explode("t").alias("term"), F.size("t").alias("dl")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n, avgdl."""
    return docs.select(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def ranked(scores: DataFrame, k: int, order: list[Column], rank: str = "rank", key: str = "qid") -> DataFrame:
    """The k first rows of each question with their rank; the window limit is pushed below the shuffle."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(query_terms(F.col("question"))).alias("term")).withColumn("times", F.lit(1))


def _scored(asked: DataFrame, tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, id, score) from asked(qid, term, times), tf(id, term, dl, tf) of the asked terms and the one row stats(n, avgdl)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "avgdl")  # stats is one row
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(asked.join(idf, "term"), "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(questions: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 30, keep: Column | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) for questions(qid, question): the k best documents of each, of those that satisfy keep.

    The terms of all questions, a set whose size the batch bounds, restrict the tokens before they are shuffled; tokens
    are summed by document and term within each task first. With an index, bm25_indexed reads its postings instead.
    """
    asked = terms if terms is not None else asked_terms(questions)
    wanted = asked.select("term").distinct()
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    hits = rows.select("id", F.explode("t").alias("term"), F.size("t").alias("dl")).join(wanted, "term", "left_semi")
    tf = hits.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    scored = _scored(asked, tf, corpus_stats(docs, text_col))
    if keep is not None:
        allowed = docs.where(keep).select(F.col(id_col).alias("id"))
        scored = scored.join(allowed, "id", "left_semi")
    return ranked(scored, k, [F.desc("score"), F.asc("id")])


def term_part(term: Column, partitions: int) -> Column:
    """The partition of the postings that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(partitions)).cast("int")


def bm25_indexed(questions: DataFrame, postings_: DataFrame, stats: DataFrame, k: int = 30, partitions: int = 64, keep: DataFrame | None = None) -> DataFrame:
    """As bm25, from postings(id, term, dl, tf, part) and stats(n, avgdl) of a built index; keep(id) are the rows that may be found.

    Only the partitions that hold asked terms are read (their numbers, partitions at most, are the filter), and only rows of asked terms
    are shuffled.
    """
    asked = asked_terms(questions)
    wanted = asked.select("term").distinct()
    parts = sorted(r[0] for r in wanted.select(term_part(F.col("term"), partitions).alias("part")).distinct().collect())
    tf = postings_.where(F.col("part").isin(parts)).join(wanted, "term", "left_semi").select("id", "term", "dl", "tf")
    scored = _scored(asked, tf, stats)
    if keep is not None:
        scored = scored.join(keep.select("id"), "id", "left_semi")
    return ranked(scored, k, [F.desc("score"), F.asc("id")])


def _block_top(vectors: np.ndarray, qids: list, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            own = np.stack(f["vec"].to_numpy()).astype(np.float64)
            far = np.round(1 - vectors @ own.T, 6)
            ids = f["id"].to_numpy()
            order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
            n = order.shape[1]
            yield pd.DataFrame({"qid": np.repeat(np.array(qids), n), "id": ids[order].reshape(-1), "distance": np.take_along_axis(far, order, axis=1).reshape(-1)})

    return run


def dense(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 30, over_fetch: int | None = None, keep: Column | None = None, block: int = 4096) -> DataFrame:
    """(qid, id, distance, rank): the k nearest of vectors by cosine distance for each of queries(qid, vec), all of unit length.

    The stated queries go to the tasks in blocks; a task answers with its own best, so k rows for each query and batch are
    shuffled. With keep, over_fetch neighbours (60 or 4 * k at least) are fetched first and filtered then, so
    fewer than k may be left; over_fetch 0 filters first.
    """
    wanted = queries.select("qid", "vec").orderBy("qid").collect()  # the stated queries
    fetch = k if keep is None or over_fetch == 0 else (over_fetch or max(60, 4 * k))
    rows = vectors if keep is None or over_fetch != 0 else vectors.where(keep)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    found = None
    for i in range(0, max(1, len(wanted)), block):
        part = wanted[i : i + block]
        if not part:
            return rows.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
        matrix = np.array([r["vec"] for r in part], np.float64)
        best = rows.mapInPandas(_block_top(matrix, [r["qid"] for r in part], fetch), "qid long, id long, distance double")
        found = best if found is None else found.unionByName(best)
    found = ranked(found, fetch, [F.asc("distance"), F.asc("id")])
    if keep is not None and over_fetch != 0:
        allowed = vectors.where(keep).select(F.col(id_col).cast("long").alias("id"))
        found = ranked(found.drop("rank").join(allowed, "id", "left_semi"), k, [F.asc("distance"), F.asc("id")])
    return found


def fuse(lexical: DataFrame, near: DataFrame, k: int = 60, guaranteed: int = 0) -> DataFrame:
    """(qid, id, rrf, bm25_rank, dense_rank, pos): reciprocal rank fusion of two ranked lists.

    Ties keep the lexical order. With guaranteed, the first so many of the dense list and then of the lexical list come to
    the front.
    """
    both = lexical.select("qid", "id", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("dense_rank")).unionByName(near.select("qid", "id", F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("dense_rank")))
    ranks = both.groupBy("qid", "id").agg(F.max("bm25_rank").alias("bm25_rank"), F.max("dense_rank").alias("dense_rank"))
    share = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    scored = ranks.withColumn("rrf", share("bm25_rank") + share("dense_rank"))
    front = F.when(F.col("dense_rank") <= guaranteed, F.col("dense_rank")).when(F.col("bm25_rank") <= guaranteed, guaranteed + F.col("bm25_rank"))
    order = Window.partitionBy("qid").orderBy(front.asc_nulls_last(), F.desc("rrf"), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last())
    return scored.withColumn("pos", F.row_number().over(order))


def pick(fused: DataFrame, papers: DataFrame, caps: DataFrame, top_k: int = 6) -> DataFrame:
    """(qid, id, paper, rank, …): top_k hits, at most cap of a paper; if that leaves room, the skipped ones follow in order.

    papers(id, paper) and caps(qid, cap). Hits without a paper are dropped.
    """
    rows = fused.join(papers, "id").join(F.broadcast(caps), "qid")
    nth = F.row_number().over(Window.partitionBy("qid", "paper").orderBy("pos"))
    rows = rows.withColumn("over", nth > F.col("cap"))
    return ranked(rows, top_k, [F.asc("over"), F.asc("pos")]).drop("over", "cap")


def hybrid(questions: DataFrame, docs: DataFrame, queries: DataFrame, vectors: DataFrame, papers: DataFrame, caps: DataFrame, top_k: int = 6, candidates: int = 30, use_bm25: bool = True, use_dense: bool = True, guaranteed: int = 2, **columns) -> DataFrame:
    """Search end to end: both retrievers, fusion, guaranteed places (only if both run), cap per paper."""
    lexical = bm25(questions, docs, k=candidates, **columns) if use_bm25 else None
    near = dense(queries, vectors, k=candidates) if use_dense else None
    empty = (lexical if lexical is not None else near).where("false")
    fused = fuse(lexical if lexical is not None else empty, near if near is not None else empty, guaranteed=guaranteed if use_bm25 and use_dense else 0)
    return pick(fused, papers, caps, top_k)


#: The configurations that are compared. Name; lexical, dense; cap of a paper (0: none, -1: by the question); guaranteed places.
GRID = (("bm25", True, False, 0, 0), ("dense", False, True, 0, 0), ("hybrid", True, True, 0, 2), ("hybrid_cap3", True, True, 3, 2), ("hybrid_cap2", True, True, 2, 2), ("hybrid_adaptive", True, True, -1, 2))


def ablation(lexical: DataFrame, near: DataFrame, papers: DataFrame, caps: DataFrame, top_k: int = 6) -> DataFrame:
    """(config, qid, id, paper, rank, ...) of each configuration of GRID, from one run of each retriever; caps(qid, cap) are those of the adaptive one."""
    out = None
    for name, words, vectors, cap, guaranteed in GRID:
        fused = fuse(lexical if words else lexical.where("false"), near if vectors else near.where("false"), guaranteed=guaranteed)
        own = caps if cap < 0 else caps.withColumn("cap", F.lit(cap or top_k))
        found = pick(fused, papers, own, top_k).select(F.lit(name).alias("config"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def named_papers(questions: DataFrame, papers: DataFrame, fold) -> DataFrame:
    """(qid, paper_id) of papers(paper_id, surnames, year) that a question names: by id, else by surname, and by year if any is given.

    fold removes accents and case. The papers are a small dimension, whose surnames are looked for in each question.
    """
    q = questions.select("qid", fold(F.col("question")).alias("q"))
    ids = q.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"\b([pu]\d{2,})\b"), F.lit(1)))).alias("paper_id"))
    ids = ids.join(papers.select("paper_id"), "paper_id", "left_semi").select("qid", "paper_id")
    years = F.transform(F.regexp_extract_all("q", F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    names = papers.select("paper_id", "year", F.explode("surnames").alias("surname")).withColumn("surname", fold(F.col("surname"))).where(F.length("surname") >= 2)
    quoted = F.concat(F.lit(r"\Q"), F.col("surname"), F.lit(r"\E"))
    pattern = F.when(F.length("surname") <= 2, F.concat(F.lit(r"\b"), quoted, F.lit(r"\s+(et al|and|&|\(\d{4})"))).otherwise(F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))
    without = q.join(ids, "qid", "left_anti").withColumn("years", years)
    hits = without.join(F.broadcast(names.withColumn("pattern", pattern)), F.expr("q rlike pattern AND (size(years) = 0 OR array_contains(years, year))"))
    return ids.unionByName(hits.select("qid", "paper_id").distinct())
