"""Quotas, logs, registration and deletion as batch operators; lexiforge.streaming has their streaming forms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def daily_quota(requests: DataFrame, cap: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """requests with day, nth and admitted: the first cap of each UTC day pass.

    A day's rank is taken in two steps, within minutes and over the minutes before, so that no day is gathered in one task.
    """
    rows = requests.withColumn("day", F.to_date(ts)).withColumn("_slot", F.hour(ts) * 60 + F.minute(ts))
    hours = rows.groupBy("day", "_slot").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(hours.select("day", "_slot", before.alias("_before")), ["day", "_slot"])
    nth = F.row_number().over(Window.partitionBy("day", "_slot").orderBy(ts, key)) + F.col("_before")
    return rows.withColumn("nth", nth.cast("long")).withColumn("admitted", F.col("nth") <= cap).drop("_slot", "_before")


def rate_limit(requests: DataFrame, limit: int, window: str, who: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """requests with opened, nth and admitted: limit of each who and fixed window pass."""
    rows = requests.withColumn("opened", F.window(ts, window)["start"])
    nth = F.row_number().over(Window.partitionBy(who, "opened").orderBy(ts, key))
    return rows.withColumn("nth", nth.cast("long")).withColumn("admitted", F.col("nth") <= limit)


def retained(log: DataFrame, now: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    return log.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def used(requests: DataFrame, ts: str = "ts") -> DataFrame:
    return requests.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


#: Limits of an upload.
MOST_BYTES, MOST_PAGES, LEAST_LETTERS = 20 << 20, 60, 200


def admission(uploads: DataFrame) -> DataFrame:
    """uploads(content, encrypted, n_pages, letters) with reason: the first rule that fails, or null."""
    reason = (
        F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF")
        .when(F.octet_length("content") > MOST_BYTES, "too large")
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("n_pages") > MOST_PAGES, "too many pages")
        .when(F.col("letters") < LEAST_LETTERS, "no text layer")
    )
    return uploads.withColumn("reason", reason)


def new_uploads(uploads: DataFrame, registered: DataFrame) -> DataFrame:
    """uploads(sha256, …) that no registered row has, failed ones aside; of several with one hash the first."""
    fresh = uploads.join(registered.where("status != 'failed'").select("sha256"), "sha256", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("sha256").orderBy("uploaded_at", "filename"))).where("_n = 1").drop("_n")


def smallest_free_id(registered: DataFrame) -> DataFrame:
    """(paper_id): the first of u01 to u99 that is not taken; null if all are."""
    all_ = registered.sparkSession.range(1, 100).select(F.format_string("u%02d", "id").alias("paper_id"))
    return all_.join(registered.select("paper_id"), "paper_id", "left_anti").agg(F.min("paper_id").alias("paper_id"))


def without_document(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """table without the papers in doomed; papers of the core collection stay."""
    return table.join(doomed.select("paper_id").withColumn("collection", F.lit("user")), ["paper_id", "collection"], "left_anti")


def latest(states: DataFrame, key: str = "paper_id", tie: str = "status") -> DataFrame:
    """(key, status, ts): the last of states(key, status, ts[, tie]); of those at one time the one with the largest tie."""
    return states.groupBy(key).agg(F.max_by("status", F.struct("ts", tie)).alias("status"), F.max("ts").alias("ts"))


def content_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha256, n, first_id) of contents that come more than once."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by, n, fingerprint) of rows (by, order, hash) that come in order: hashes are fed to SHA-256 one after the other, none is kept."""
    group, n, sha = None, 0, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=names)

    for batch in batches:
        kind, names = batch.schema.field(0).type, [batch.schema.names[0], "n", "fingerprint"]
        for by, content_hash in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n and by != group:
                yield out()
                n, sha = 0, hashlib.sha256()
            group, n = by, n + 1
            sha.update((content_hash or "").encode())
    if n:
        yield out()


def fingerprint(chunks: DataFrame, by: str, order: str, content_hash: str = "content_hash") -> DataFrame:
    """(by, n, fingerprint): SHA-256 of a group's content hashes in order.

    The digest of a sequence can't be split, so a group's narrow rows are sorted and pass through one task, but they stream:
    no row or list grows with the corpus.
    """
    rows = chunks.select(by, order, content_hash)
    schema = T.StructType([rows.schema[by], T.StructField("n", T.LongType()), T.StructField("fingerprint", T.StringType())])
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(_digests, schema)
