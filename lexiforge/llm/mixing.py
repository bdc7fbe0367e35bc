"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). A network routes tokens from
patterns to the quotas of their sources; using a pattern's documents once is free, and each repetition costs
more than the last (convex), so nothing is repeated while a source has unused text. Within a pattern the
flow is met with seeded documents, whole passes first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import checked, free_name, release, small, stored


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Each source's share of all sizes. Sources go by code point, null last, and weigh as weights, repeating.

    A target stops at most times its source's size; the excess is shared again by weight among the others.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def route(mass: dict[frozenset, int], quota: dict[str | None, int], most: int) -> dict[frozenset, dict[str | None, int]]:
    """Min-cost flow of tokens from patterns to the sources in them, by successive shortest paths.

    A pattern has most arcs of its mass each, the k-th at cost k; a source drains its quota. Costs are small
    integers, so Dijkstra with potentials takes few rounds; the network has a node for each pattern and source.
    """
    patterns = sorted(mass, key=lambda p: sorted(map(str, p)))
    sources = list(quota)
    node = {("p", p): 1 + i for i, p in enumerate(patterns)} | {("s", s): 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(node)
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            heads[x].append(len(to))
            to.append(y), cap.append(room), cost.append(price)
        return len(to) - 2

    through = {}
    for p in patterns:
        for k in range(most):
            arc(0, node["p", p], mass[p], k)
        for s in sorted(p, key=str):
            if s in quota:
                through[p, s] = arc(node["p", p], node["s", s], most * mass[p], 0)
    for s in sources:
        arc(node["s", s], sink, quota[s], 0)
    potential = [0] * (sink + 1)
    while True:
        far, back, heap = [float("inf")] * (sink + 1), [-1] * (sink + 1), [(0, 0)]
        far[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in heads[x]:
                if cap[e] and (n := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], back[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if far[sink] == float("inf"):
            break
        potential = [p + min(f, far[sink]) for p, f in zip(potential, far, strict=True)]
        push, x = float("inf"), sink
        while x:
            push, x = min(push, cap[back[x]]), to[back[x] ^ 1]
        x = sink
        while x:
            cap[back[x]] -= push
            cap[back[x] ^ 1] += push
            x = to[back[x] ^ 1]
    out: dict[frozenset, dict[str | None, int]] = {p: {} for p in patterns}
    for (p, s), e in through.items():
        out[p][s] = cap[e ^ 1]
    return out


#: Columns that mix() joins to its rows; columns of that name are called otherwise meanwhile.
_INNER = {"whole", "ends", "upto", "more", "less"}


def _sources(patterns: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, weight, target and shared (some pattern has it beside others) of each source.

    Ranks by code point come from the place in sorted ranges and the counts of ranges before, so no task holds
    all sources. The rate that shares what is left rises as full sources drop out, a sum over the sources each time.
    """
    spark = patterns.sparkSession
    held = patterns.select(F.explode("pattern").alias("source"), "mass", (F.size("pattern") > 1).alias("several"))
    held = held.groupBy("source").agg(F.sum("mass").alias("source_size"), F.max("several").alias("shared"))
    in_order = F.col("source").asc_nulls_last()
    held = stored(held.repartitionByRange(in_order).sortWithinPartitions(in_order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    of_range = F.shiftright("at", 33)
    before, starts = 0, []  # a row for each range, however many sources there are
    for r, n in sorted(held.groupBy(of_range.alias("range")).count().collect()):
        starts.append((r, before))
        before += n
    rank = F.col("start") + F.col("at") - F.shiftleft(of_range, 33)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = held.join(F.broadcast(small(spark, starts, "range long, start long")), of_range == F.col("range")).withColumn("weight", weight)

    total, once = ranked.agg(F.sum("source_size")).first()[0] or 0, patterns.agg(F.sum("mass")).first()[0] or 0
    limit = most * F.col("source_size")
    rate, known = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(rate) > limit
        n, capped, open_ = ranked.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == known or not open_:
            break
        rate, known = (total - (capped or 0)) / open_, n
    # Shares are of the mass of all documents, each counted once though several sources may hold it.
    target = F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(rate)) * F.lit(once / max(1, total))
    return stored(ranked.select("source", "source_size", "weight", "shared", target.alias("target")), "mix-targets")


def _routed(patterns: DataFrame, sources: DataFrame, most: int, most_patterns: int) -> DataFrame:
    """pattern, mass and got, the tokens that flow from each pattern.

    A source that only its own pattern holds fills its quota from there, as the cheapest flow does, so these need
    no network. Patterns that share sources go through route() on the driver, most_patterns at most.
    """
    first, alone = F.element_at("pattern", 1), F.size("pattern") == 1
    own = patterns.where(alone).join(sources.where("NOT shared"), first.eqNullSafe(F.col("source")))
    own = own.select("pattern", "mass", F.least(F.rint("target").cast("long"), most * F.col("mass")).alias("got"))
    tied = patterns.where(alone).join(sources.where("shared"), first.eqNullSafe(F.col("source")), "left_semi").unionByName(patterns.where(~alone))
    what = "membership patterns that share sources"
    mass = {frozenset(p): (p, n) for p, n in checked(tied.limit(most_patterns + 1).collect(), most_patterns, what)}
    quota = {}
    if mass:
        quota = {s: round(t) for s, t in checked(sources.where("shared").select("source", "target").limit(most_patterns + 1).collect(), most_patterns, "sources that share patterns")}
    flow = route({p: n for p, (_, n) in mass.items()}, quota, most)
    found = [(p, n, sum(flow[key].values())) for key, (p, n) in mass.items()]
    return own.unionByName(small(patterns.sparkSession, found, "pattern array<string>, mass long, got long"))


def mix(df: DataFrame, size: Column, members: Column, order: list[str], weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, buckets: int = 1 << 14, most_patterns: int = 100_000) -> DataFrame:
    """df with pattern, size, source_size and target (of the row's first source) and repeats.

    members is an array of the sources that hold the row; order and repetitions in it don't matter, and a null
    or empty one means the one source null. A row is taken repeats times, most at most. A pattern's flow is
    met by whole passes, then by rows in the order of a seeded hash of the order columns while they fit; what is
    then missing is made up by one more row, or by one more and one fewer, whichever comes nearest. Rows that agree in the order columns are taken
    together. Rows of size 0 are never taken; an empty table gives no rows. Reruns agree: nothing depends on
    partitioning. Columns of df named like the results are replaced.

    Plan: a narrow table of patterns, sizes and hashes is stored once. Sums by pattern and hash bucket are
    pre-aggregated; only the bucket in which a pattern's flow ends is summed up row by row, so a source with
    a third of all rows is never gathered. Sources, targets and cuts are stored tables with a row for each pattern,
    which Spark broadcasts if their files are small and joins by key otherwise, so any number of sources will do;
    only patterns that share sources meet on the driver, most_patterns at most (an error beyond). The last pass only compares hashes.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c.lower() not in ("pattern", "size", "source_size", "target", "repeats")]
    own = {c: free_name(df, f"own_{c}") for c in keep if c.lower() in _INNER}
    # A row without any source belongs to the source null.
    pattern = F.sort_array(F.array_distinct(F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))))
    h, b = free_name(df, "_hash"), free_name(df, "_bucket")
    rows = df.select(*[F.col(c).alias(own.get(c, c)) for c in keep], pattern.alias("pattern"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *order).alias(h))
    rows = rows.withColumn(b, F.shiftrightunsigned(h, 64 - (buckets.bit_length() - 1)).cast("int"))
    narrow = stored(rows.groupBy("pattern", b, h).agg(F.sum("size").alias("size")), "mix")

    patterns = stored(narrow.groupBy("pattern").agg(F.sum("size").alias("mass")), "mix-patterns")
    sources = _sources(patterns, weights, most)
    whole = F.when(F.col("mass") > 0, F.least(F.floor(F.col("got") / F.col("mass")), F.lit(most))).otherwise(0)
    plan = _routed(patterns, sources, most, most_patterns).withColumn("whole", whole.cast("int"))
    plan = stored(plan.select("pattern", "whole", (F.col("got") - F.col("whole") * F.col("mass")).alias("rest")), "mix-plan")

    # The bucket in which each pattern's rest ends.
    up_to = Window.partitionBy("pattern").rowsBetween(Window.unboundedPreceding, 0)
    cells = narrow.groupBy("pattern", b).agg(F.sum("size").alias("in_it")).withColumn("upto", F.sum("in_it").over(up_to.orderBy(b)))
    cells = cells.join(plan, "pattern").where("upto >= rest AND upto - in_it < rest")
    ends = stored(cells.select("pattern", F.col(b).alias("ends"), (F.col("upto") - F.col("in_it")).alias("before"), "rest"), "mix-ends")
    # The last hash taken in it or null, and what is still missing.
    last = narrow.join(ends, "pattern").where(F.col(b) == F.col("ends"))
    last = last.withColumn("with", F.col("before") + F.sum("size").over(up_to.orderBy(h))).where("with <= rest")
    cuts = last.groupBy("pattern").agg(F.max(h).alias("upto"), F.max("with").alias("with"))
    stops = ends.join(cuts, "pattern", "left").select("pattern", "ends", "upto", (F.col("rest") - F.coalesce("with", "before")).alias("missing"))
    stops = stored(stops, "mix-stops")
    taken = (F.col(b) < F.col("ends")) | ((F.col(b) == F.col("ends")) & (F.col(h) <= F.col("upto")))
    near = narrow.where("size > 0").join(stops, "pattern").withColumn("in_it", F.coalesce(taken, F.lit(False)))
    # Either the row nearest to what is missing comes in, or the next larger one does and one of about the surplus goes.
    gap = F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), F.col(h).alias("at"))
    larger = F.when(F.col("size") > F.col("missing"), F.struct("size", F.col(h).alias("at")))
    come = stored(near.where("NOT in_it").groupBy("pattern").agg(F.min(gap).alias("nearest"), F.min(larger).alias("larger")), "mix-come")
    go = near.where("in_it").join(come.where("larger IS NOT NULL").select("pattern", "larger"), "pattern")
    surplus = F.col("larger.size") - F.col("missing")
    go = go.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - surplus).alias("off"), F.col(h).alias("at"))).alias("goes"))

    def choice(off: Column, place: int, more: Column, less: Column) -> Column:
        return F.struct(off.cast("long").alias("off"), F.lit(place).alias("place"), more.cast("long").alias("more"), less.cast("long").alias("less"))

    none = F.lit(None)
    best = F.array_min(
        F.array(
            choice(F.coalesce("missing", F.lit(0)), 0, none, none),
            F.when(F.col("nearest").isNotNull(), choice(F.col("nearest.off"), 1, F.col("nearest.at"), none)),
            F.when(F.col("goes").isNotNull(), choice(F.col("goes.off"), 2, F.col("larger.at"), F.col("goes.at"))),
        )
    )
    final = plan.join(stops, "pattern", "left").join(come, "pattern", "left").join(go, "pattern", "left").withColumn("best", best)
    final = final.join(sources, F.element_at("pattern", 1).eqNullSafe(F.col("source")))
    final = stored(final.select("pattern", "whole", F.coalesce("ends", F.lit(-1)).alias("ends"), "upto", "best.more", "best.less", "source_size", "target"), "mix-final")
    release(spark, narrow, patterns, sources, plan, ends, stops, come)

    found = rows.join(final, "pattern")
    extra = F.when(F.col(h) == F.col("less"), 0).when(taken | (F.col(h) == F.col("more")), 1).otherwise(0)
    repeats = F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(most))).otherwise(0)
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in keep], "pattern", "size", "source_size", "target", repeats.cast("int").alias("repeats"))


def mix_documents(df: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """mix() where each row has the one source in source_col."""
    return mix(df, size, F.array(F.col(source_col).cast("string")), [id_col, text_col], **options)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of mix()'s result, each row as often as it is taken."""
    again = free_name(mixed, "again")
    return mixed.where("repeats > 0").withColumn(again, F.explode(F.sequence(F.lit(1), "repeats"))).select(*columns)
