"""Streaming forms of the quota, the log and ingestion; results equal those of the batch operators on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quota(requests: DataFrame, cap: int, ts: str = "ts", key: str = "event_id", watermark: str = "1 day") -> DataFrame:
    """(key, ts, day, nth, admitted) in the order of arrival: a counter for each day, dropped once the watermark has passed it."""

    def count(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values(["ts", "key"])
            nth = range(n + 1, n + 1 + len(f))
            n += len(f)
            yield pd.DataFrame({"key": f["key"], "ts": f["ts"], "day": of[0], "nth": nth, "admitted": [x <= cap for x in nth]})
        state.update((n,))

    rows = requests.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.withColumn("day", F.to_date("ts")).groupBy("day").applyInPandasWithState(count, "key long, ts timestamp, day date, nth long, admitted boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, watermark: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(opened, by, n): events in tumbling or sliding windows; late rows go once the watermark has passed."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    spans = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rows.groupBy(spans.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", ts: str = "ts", who: str = "user_id") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), who).agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), who, "n")


def without_repeats(events: DataFrame, key: str, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, folder: str, checkpoint: str, transform) -> StreamingQuery:
    """Write transform(batch) for each micro-batch into its own folder of a table; a batch that is repeated replaces its folder, so it counts once."""

    def one(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
