"""Exact deduplication by Grace hash partitioning.

Records are hashed into spill files, recursively and with another seed at each depth, until a bucket fits
an open-addressing table that compares complete contents. The same routine runs before the shuffle, where
it collapses the copies in each input partition (so that a text that a third of all rows share reaches the
shuffle once a partition), and after it, where it merges what is left.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, text_of

#: Stands for a null id in spilled records; it loses against every id.
NO_ID = -(2**63)
_HEAD = struct.Struct("<qqI")
_ENTRY = 150  # bytes a record costs besides its content


class OpenTable:
    """Open addressing with linear probing; a slot matches only if the complete contents are equal."""

    def __init__(self, seed: int):
        self.seed, self.slots, self.items, self.bytes = seed, [-1] * 1024, [], 0

    def find(self, content: bytes) -> tuple[int, int]:
        """The slot that the content has or would take, and the item there or -1."""
        mask = len(self.slots) - 1
        at = (xxhash.xxh3_64_intdigest(content, self.seed) >> 20) & mask
        while (i := self.slots[at]) >= 0:
            if self.items[i][0] == content:
                return at, i
            at = (at + 1) & mask
        return at, -1

    def absorb(self, content: bytes, keep: int, n: int) -> bool:
        """Merge into the entry of this content, if there is one."""
        _, i = self.find(content)
        if i >= 0:
            item = self.items[i]
            item[1], item[2] = max(item[1], keep), item[2] + n
        return i >= 0

    def add(self, content: bytes, keep: int, n: int) -> None:
        at, _ = self.find(content)
        self.slots[at] = len(self.items)
        self.items.append([content, keep, n])
        self.bytes += len(content) + _ENTRY
        if 2 * len(self.items) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for i, item in enumerate(self.items):
                self.slots[self.find(item[0])[0]] = i


def _records(path: Path) -> Iterator[tuple[bytes, int, int]]:
    with path.open("rb") as f:
        while head := f.read(_HEAD.size):
            keep, n, size = _HEAD.unpack(head)
            yield f.read(size), keep, n


def grace(records: Iterable[tuple[bytes, int, int]], memory: int, fanout: int, folder: Path, depth: int = 0) -> Iterator[list]:
    """[content, largest id, count] of each distinct content, using about memory bytes at a time.

    A bucket that outgrows memory freezes its table: records equal to an entry still merge into it, all
    others go to fanout spill files by a hash seeded with the depth, and each file is taken alone.
    """
    table, files, names = OpenTable(2 * depth), [], []
    for content, keep, n in records:
        if table.absorb(content, keep, n):
            continue
        if not files and (table.bytes + len(content) <= memory or not table.items):
            table.add(content, keep, n)
            continue
        if not files:
            names = [folder / f"{depth}-{i}" for i in range(fanout)]
            files = [name.open("wb", buffering=1 << 16) for name in names]
        f = files[xxhash.xxh3_64_intdigest(content, 2 * depth + 1) % fanout]
        f.write(_HEAD.pack(keep, n, len(content)))
        f.write(content)
    yield from table.items
    del table
    for f in files:
        f.close()
    for i, name in enumerate(names):
        inner = folder / f"in-{depth}-{i}"
        inner.mkdir()
        yield from grace(_records(name), memory, fanout, inner, depth + 1)
        name.unlink()


def _merge(memory: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for content, keep, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    yield content.as_py(), NO_ID if keep is None else keep, n

        with tempfile.TemporaryDirectory() as folder:  # this task's own; gone when the task ends, rebuilt if it is lost
            out, size = [], 0
            for item in grace(records(), memory, fanout, Path(folder)):
                out.append(item)
                size += len(item[0])
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(items: list[list]) -> pa.RecordBatch:
    content, keep, n = zip(*items, strict=True)
    keep = pa.array([None if k == NO_ID else k for k in keep], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), keep, pa.array(n, pa.int64())], names=["content", "keep_id", "group_size"])


def distinct_contents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 96 << 20, fanout: int = 16) -> DataFrame:
    """(content, keep_id, group_size): each distinct content once, with the largest id and the rows that have it."""
    schema = "content binary, keep_id long, group_size long"
    rows = df.select(F.encode(text_of(text_col), "UTF-8").alias("content"), F.col(id_col).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    merge = _merge(memory, fanout)
    local = rows.mapInArrow(merge, schema)
    return local.repartition(F.xxhash64("content")).mapInArrow(merge, schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 96 << 20, fanout: int = 16) -> DataFrame:
    """One row for each row of df, dropped ones too.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays;
    of repeated rows with that id, one. Returns id_col, keep_id, group_size, kept and text_sha256. A null id
    stays only where its whole group has none; an empty table gives no rows; other columns are not looked at.

    Plan: the scan gives (id, digest) rows, which are narrow, and the contents, which Grace hashing reduces
    to one row each; the two meet on the digest. The side of the contents is unique, so adaptive
    execution may split a digest that a third of all rows share.
    """
    classes = distinct_contents(df, id_col, text_col, memory, fanout).select(F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    return _back(df, classes, id_col, text_col)


def _back(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    members = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.encode(text_of(text_col), "UTF-8"), 256).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    )
    nth = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return (
        members.join(classes, "text_sha256").withColumn("nth", nth)
        .select(F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that stay, with all their columns.

    Repeated rows with the same id and text are one row, of which one copy stays (the first by its other
    columns' hash).
    """
    digest, key, nth = free_name(df, "text_sha256"), free_name(df, "row_id"), free_name(df, "row_order")
    # Ids without nulls on both sides, so that one shuffle of the texts serves the join and the window.
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    kept = exact_dedup(df, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_digest"))
    kept = kept.select(F.col("_kept_digest").alias(digest), known("_kept_id").alias(key))
    rows = df.withColumns({digest: F.sha2(F.encode(text_of(text_col), "UTF-8"), 256), key: known(id_col)}).join(kept, [digest, key], "left_semi")
    order = Window.partitionBy(digest, key).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*df.columns)
