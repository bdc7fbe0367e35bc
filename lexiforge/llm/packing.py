"""Variable-capacity best-fit packing.

Several sequence lengths are permitted. Pieces go in descending size into the open bin that they fill best;
where none has room, a bin of the length that costs least for this piece and what is still to come is
opened; at the end each bin shrinks to the shortest permitted length that holds its contents.

Best fit depends on sizes alone, so it runs over the histogram of sizes (as many rows as the longest
sequence has tokens, whatever the corpus) with whole runs of equal bins at a time, and gives exactly what
packing piece by piece would. Rows then find their bin from their rank among the pieces of their size.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import small, stored


def padded_cost(length: int) -> float:
    """What a sequence of this length costs: its tokens, and attention that grows with their square."""
    return length * (1 + length / 65536)


class Bins:
    """Runs of equal open bins, by what they have left; of equal rooms the bin opened first is taken."""

    def __init__(self, lengths: tuple[int, ...], cost: Callable[[int], float]):
        self.lengths, self.cost = sorted(lengths), cost
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # room -> [(first bin, bins, opened length)]
        self.rooms: list[int] = []
        self.n = 0

    def put(self, room: int, run: tuple[int, int, int]) -> None:
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        heapq.heappush(self.runs[room], run)

    def best(self, size: int) -> int | None:
        i = bisect.bisect_left(self.rooms, size)
        return self.rooms[i] if i < len(self.rooms) else None

    def pop(self, room: int) -> tuple[int, int, int]:
        run = heapq.heappop(self.runs[room])
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return run

    def to_open(self, size: int, smaller: int) -> int:
        """The length with the least cost for each token in it; smaller is the mass that may still fill gaps."""

        def each(length: int) -> float:
            own = size * (length // size)
            return self.cost(length) / (own + min(length - own, smaller))

        return min((x for x in self.lengths if x >= size), key=lambda x: (each(x), x))


def pack_histogram(counts: dict[int, int], lengths: tuple[int, ...], cost: Callable[[int], float] = padded_cost) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Placements (size, first rank, pieces, first bin, pieces a bin, offset of the first piece in each bin) and final runs of bins (first bin, bins, final length)."""
    bins, placed = Bins(lengths, cost), []
    mass = sum(s * n for s, n in counts.items())
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        mass -= size * left
        while left:
            room = bins.best(size)
            if room is None:
                length = bins.to_open(size, mass)
                per = length // size
                bins.put(length, (bins.n, -(-left // per), length))
                bins.n += -(-left // per)
                room = length
            first, n, length = bins.pop(room)
            per = room // size
            full = min(n, left // per)
            if full:
                placed.append((size, rank, full * per, first, per, length - room))
                bins.put(room - per * size, (first, full, length))
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if left and n:  # the last pieces fill one bin in part
                placed.append((size, rank, left, first, per, length - room))
                bins.put(room - left * size, (first, 1, length))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                bins.put(room, (first, n, length))
    final = []
    for room, runs in bins.runs.items():
        for first, n, length in runs:
            final.append((first, n, bins.lengths[bisect.bisect_left(bins.lengths, length - room)]))
    return placed, sorted(final)


def cut(placed: list[tuple], final: list[tuple]) -> list[tuple]:
    """(size, first rank, last rank, first bin, pieces a bin, offset, final length): placements split where the final length changes."""
    starts, out = [f for f, _, _ in final], []
    for size, rank, n, first, per, offset in placed:
        while n:
            i = bisect.bisect_right(starts, first) - 1
            run, bins, length = final[i]
            take = min(n, (run + bins - first) * per)
            out.append((size, rank, rank + take - 1, first, per, offset, length))
            rank, n, first = rank + take, n - take, first + -(-take // per)
    return out


def pack(df: DataFrame, size: Column, id_col: str = "doc_id", order: tuple[str, ...] = (), lengths: tuple[int, ...] = (512, 1024, 2048, 4096), cost: Callable[[int], float] = padded_cost, salts: int = 8) -> DataFrame:
    """id_col, n_tokens, piece, piece_start, piece_tokens, bin_id, bin_length and bin_offset for each piece of each row.

    Rows longer than the longest sequence are cut into full sequences and a rest; every piece is packed, none
    is dropped. A row without tokens (or with a null size) has one piece of 0 tokens, in no bin (null). Repeated rows are packed
    as often as they come. Ties (pieces of one size) go in the order of a hash of id_col and the order columns.

    Plan: sizes are taken from the rows once and stored, narrow. The histogram has max(lengths) * salts rows at most. Ranks need one shuffle by size and salt, so a
    size that a third of all rows share is spread over salts tasks.
    """
    spark, longest = df.sparkSession, max(lengths)
    rows = df.select(F.col(id_col), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64(id_col, *order).alias("_hash"))
    last = F.when(F.col("n_tokens") > 0, F.floor((F.col("n_tokens") - 1) / longest)).otherwise(0)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    rows = rows.withColumn("piece_start", F.col("piece").cast("long") * longest)
    rows = rows.withColumn("piece_tokens", F.least(F.col("n_tokens") - F.col("piece_start"), F.lit(longest)).cast("int"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_hash", "piece"), F.lit(salts)).cast("int"))
    rows = stored(rows, "pieces")
    counted = sorted(tuple(r) for r in rows.where("piece_tokens > 0").groupBy("piece_tokens", "_salt").count().collect())  # max(lengths) * salts rows at most
    counts, at = {}, []
    for s, salt, n in counted:
        at.append((s, salt, counts.get(s, 0)))
        counts[s] = counts.get(s, 0) + n
    plan = small(spark, cut(*pack_histogram(counts, tuple(lengths), cost)), "_size int, _from long, _to long, _bin long, _per int, _offset int, bin_length int")
    at = small(spark, at, "_size int, _salted int, _at long")
    rank = F.row_number().over(Window.partitionBy("piece_tokens", "_salt").orderBy("_hash", F.col(id_col), "piece")) - 1
    full = rows.where("piece_tokens > 0").withColumn("_nth", rank.cast("long"))
    full = full.join(F.broadcast(at), (F.col("piece_tokens") == F.col("_size")) & (F.col("_salt") == F.col("_salted"))).drop("_size", "_salted").withColumn("_rank", F.col("_at") + F.col("_nth"))
    full = full.join(F.broadcast(plan), (F.col("piece_tokens") == F.col("_size")) & F.col("_rank").between(F.col("_from"), F.col("_to")))
    step = F.col("_rank") - F.col("_from")
    names = [F.col(id_col), F.col("n_tokens"), F.col("piece"), F.col("piece_start"), F.col("piece_tokens")]
    full = full.select(*names, (F.col("_bin") + F.floor(step / F.col("_per"))).alias("bin_id"), "bin_length", (F.col("_offset") + (step % F.col("_per")) * F.col("piece_tokens")).cast("int").alias("bin_offset"))
    none = rows.where("piece_tokens = 0").select(*names, F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"))
    return full.unionByName(none)
