"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many virtual nodes on a ring of cells and owns the cells up to each. A row's key falls into
a cell; the cell's shard takes it unless the shard is full, and then the row goes on clockwise to the next
cell whose shard has room. Only the number of
rows in each cell of the ring is needed to decide that: the driver walks the ring over these counts (their
number is fixed by parameters), and a row finds its shard and slot from its rank within its cell.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, small, text_of


def cell_owners(shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard that owns each cell of the ring: that of the first virtual node at or clockwise from it."""
    points = sorted((xxhash.xxh3_64_intdigest(f"shard {s} node {v}".encode()) % cells, s) for s in range(shards) for v in range(vnodes))
    at = [p for p, _ in points]
    return [points[bisect.bisect_left(at, c) % len(points)][1] for c in range(cells)]


def quotas(total: int, shards: int) -> list[int]:
    """The tightest bound on loads: counts that add up to total and differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def bounded(total: int, shards: int, slack: float) -> list[int]:
    """The usual bound: (1 + slack) times the mean for every shard."""
    return [-int(-(1 + slack) * total // shards)] * shards


def walk(cells: dict[tuple[int, int], int], owners: list[int], most: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, salt, first rank, last rank, shard, slot of the first rank), covering every rank of every cell.

    Two passes over the ring make moves rare: first each shard takes from its own cells up to its bound, then
    what is left of a cell continues clockwise. Both go in the order of the ring, so equal counts give equal
    results.
    """
    load, out, rest = [0] * len(most), [], []
    for (cell, salt), n in sorted(cells.items()):
        s = owners[cell]
        if (take := min(n, most[s] - load[s])) > 0:
            out.append((cell, salt, 0, take - 1, s, load[s]))
            load[s] += take
        if take < n:
            rest.append((cell, salt, max(take, 0), n))
    # The next cell clockwise whose shard has room; paths are compressed as shards fill.
    after = list(range(1, len(owners))) + [0]

    def room(cell: int) -> int:
        path = []
        while load[owners[cell]] >= most[owners[cell]]:
            path.append(cell)
            cell = after[cell]
        for p in path:
            after[p] = cell
        return cell

    for cell, salt, done, n in rest:
        at = cell
        while done < n:
            at = room(at)
            s = owners[at]
            take = min(n - done, most[s] - load[s])
            out.append((cell, salt, done, done + take - 1, s, load[s]))
            load[s], done = load[s] + take, done + take
    return out


def assign_shards(df: DataFrame, shards: int, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", vnodes: int = 128, cells: int = 1 << 14, salts: int = 2, slack: float | None = None) -> DataFrame:
    """All columns of df but text_col, and size, text_crc32, shard and slot.

    slack None gives the tightest loads, counts at most one apart; a slack of 0.1, say, moves fewer rows when
    shards are added. Null keys and null texts hash like any value; an empty table gives no rows; rows that
    agree in keys and text are interchangeable and share a cell. Columns of df named like the results are
    replaced.

    Plan: one narrow pass counts the cells of the ring (cells * salts at most, so their collection is
    bounded), the second ranks rows within cells: one shuffle of narrow rows, no text in it. The salt comes
    from the text, so a key that a third of all rows share is spread over its cell's salts.
    """
    if shards < 1 or cells & (cells - 1):
        raise ValueError("shards must be positive and cells a power of two")
    spark, text = df.sparkSession, F.col(text_col)
    names = [c for c in df.columns if c.lower() not in (text_col.lower(), "size", "text_crc32", "shard", "slot")]
    cell, salt, order, from_, to, at, nth = (free_name(df, x) for x in ("cell", "salt", "order", "from", "to", "at", "rank"))
    rows = df.select(
        *names,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text_col), "UTF-8")).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(*key_cols), 64 - (cells.bit_length() - 1)).cast("int").alias(cell),
        F.pmod(F.xxhash64(text_col), F.lit(salts)).cast("int").alias(salt),
        F.xxhash64(*key_cols, text_col).alias(order),
    )
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(cell, salt).count().collect()}  # cells * salts rows at most
    total = sum(counts.values())
    most = quotas(total, shards) if slack is None else bounded(total, shards, slack)
    plan = walk(counts, cell_owners(shards, vnodes, cells), most)
    plan = small(spark, plan, ", ".join(f"`{name}` {kind}" for name, kind in ((cell, "int"), (salt, "int"), (from_, "long"), (to, "long"), ("shard", "int"), (at, "long"))))
    rank = F.row_number().over(Window.partitionBy(cell, salt).orderBy(order, *key_cols)) - 1
    found = rows.withColumn(nth, rank.cast("long")).join(F.broadcast(plan), [cell, salt]).where(F.col(nth).between(F.col(from_), F.col(to)))
    return found.select(*names, "size", "text_crc32", "shard", (F.col(at) + F.col(nth) - F.col(from_)).alias("slot"))
