"""Removal of repeated passages with longest-previous-factor arrays.

A passage is repeated where a string of 200 bytes also starts elsewhere. The suffixes of a whole corpus are
never sorted together: two equal strings of 200 bytes choose the same 64 bytes in them (those with the least
hash), so only strings that share this anchor can be equal. Each anchor stands for a run of starts; the bytes
around it that these starts can reach are its context. Anchors that occur once are dropped, equal contexts
become one, and the starts in the contexts of an anchor are put in suffix order, with the length that each shares
with the one before. The longest previous factor of a start is what it shares with the nearest starts above and below
in that order that come earlier in the corpus (its previous and next smaller position), the longest next factor likewise;
where it reaches 200 bytes, the start is that of an earlier or later copy. Lengths count up to 200.

An anchor with very many different contexts is split: its starts are halved by their distance to the
anchor, and each half gets a longer anchor, the bytes that all its starts share. After eight halvings the
anchor is the string itself, so this ends with equal contexts only; no group is ever cut off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import release, stored, text_of
from lexiforge.llm.near_dedup import mixed

LENGTH, ANCHOR = 200, 64
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def lpf(data: bytes) -> list[int]:
    """For each position, the length of the longest match that starts earlier. The textbook form, for any length; quadratic sorting."""
    order = sorted(range(len(data)), key=lambda i: data[i:])

    def common(a: int, b: int) -> int:
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    best, stack = [0] * len(data), []
    for i in [*order, -1]:  # a position leaves the stack when its next smaller one comes; below it lies its previous smaller one
        while stack and stack[-1] > i:
            top = stack.pop()
            best[top] = max(common(top, stack[-1]) if stack else 0, common(top, i) if i >= 0 else 0)
        stack.append(i)
    return best


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes from each position (as far as they fit), by doubling."""
    done, h = 1, _BYTES[data]
    factor = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    while 2 * done <= size:
        h = h[:-done] * factor(done) + h[done:]
        done *= 2
    if done < size:  # two overlapping halves
        step = size - done
        h = h[:-step] * factor(step + 1) + h[step:]
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima within blocks of w from both sides."""
    n = len(v) - w + 1
    full = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fore = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, anchor, first start, last start) of each run of starts, for concatenated texts that end at ends; len(data) < 2^24."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < LENGTH:
        return none
    h = mixed(window_hashes(data, ANCHOR))
    least = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - ANCHOR + 1)
    at = (least & _LOW).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    ok = np.zeros(len(at) + 1, np.int64)
    fits = ends - begins >= LENGTH
    np.add.at(ok, begins[fits], 1)
    np.add.at(ok, ends[fits] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(starts):
        return none
    new = np.concatenate([[True], (at[starts[1:]] != at[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)])
    first = starts[new]
    last = np.concatenate([starts[np.flatnonzero(new)[1:] - 1], starts[-1:]])
    return h[at[first]].view(np.int64), at[first], first, last


def _pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Runs of texts as one array with their ends, and (row, offset in its text) of each; long texts come in pieces that overlap by LENGTH - 1."""
    parts, ends, rows, n = [], [], [], 0
    for i, value in enumerate(column):
        text = np.frombuffer(value.as_buffer(), np.uint8)
        if len(text) < LENGTH:
            continue
        for begin in range(0, len(text) - LENGTH + 1, most):
            part = text[begin : begin + most + LENGTH - 1]
            parts.append(part)
            n += len(part)
            ends.append(n)
            rows.append((i, begin))
            if n >= most:
                yield np.concatenate(parts), np.array(ends), rows
                parts, ends, rows, n = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(ends), rows


#: ctx is a hash of the context's bytes, of another kind than the key: both tell contexts apart. digest holds 64 bits of the text's.
_ANCHORS = "key long, ctx long, doc_id long, digest long, lo int, hi int, off int"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        digests = pa.array([int.from_bytes(hashlib.sha256(x.as_buffer()).digest()[:8], "big", signed=True) for x in batch.column(1)], pa.int64())
        for data, ends, rows in _pieces(batch.column(1)):
            key, at, lo, hi = anchors(data, ends)
            piece = np.searchsorted(ends, lo, side="right")
            row = pa.array(np.array([r for r, _ in rows])[piece])
            shift = np.array([o for _, o in rows])[piece] - np.concatenate([[0], ends[:-1]])[piece]
            raw = memoryview(np.ascontiguousarray(data))
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)
            cols = [pa.array(key), pa.array(ctx), ids.take(row), digests.take(row), *(pa.array(x.astype(np.int32)) for x in (lo + shift, hi + shift, at - lo))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "ctx", "doc_id", "digest", "lo", "hi", "off"])


_PLACE = pa.struct([("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32())])
_CONTEXTS = "key long, ctx long, contexts long, off int, first struct<doc_id:long,digest:long,lo:int>, content binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, digest, text, runs): the context of each run."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), _PLACE, pa.binary())
    for batch in batches:
        out = []
        for doc_id, digest, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            out += [(r["key"], r["ctx"], r["contexts"], r["off"], {"doc_id": doc_id, "digest": digest, "lo": r["lo"]}, raw[r["lo"] : r["hi"] + LENGTH]) for r in runs]
        for i in range(0, len(out), 20_000):
            cols = zip(*out[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "ctx", "contexts", "off", "first", "content"])


def suffix_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the starts by their LENGTH bytes, equal ones by position, and the length that each in that order shares with the one before.

    Words of 8 bytes refine the order of ties until none is left; most starts differ early.
    """
    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    shared, rank, tied = np.zeros(n, np.int32), np.zeros(n, np.int64), np.arange(n)
    for k in range(LENGTH // 8):
        word = words[starts[tied] + 8 * k]
        order = np.lexsort((word, rank[tied]))  # stable: equal ones stay in the order of positions
        s, word = tied[order], word[order]
        old = np.concatenate([[True], rank[s][1:] != rank[s][:-1]])
        new = old | np.concatenate([[True], word[1:] != word[:-1]])
        group = np.flatnonzero(new)
        counts = np.diff(np.concatenate([group, [len(s)]]))
        base = np.maximum.accumulate(np.where(old, np.arange(len(s)), 0))
        rank[s] = rank[s] + np.repeat(group, counts) - base  # the place of a group's first in the whole order
        edge = np.flatnonzero(new & ~old)
        differ = word[edge] ^ word[edge - 1]
        bits = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1] + 11  # leading byte of the difference, exactly
        small_ = differ < np.uint64(1 << 11)
        bits[small_] = np.frexp(differ[small_].astype(np.float64))[1]
        shared[rank[s[edge]]] = 8 * k + (64 - bits) // 8
        tied = np.sort(s[np.repeat(counts > 1, counts)])
        if not len(tied):
            break
    if len(tied):  # equal in all bytes: they follow their group's first
        order = np.lexsort((tied, rank[tied]))
        s = tied[order]
        first = np.flatnonzero(np.concatenate([[True], rank[s][1:] != rank[s][:-1]]))
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.concatenate([first, [len(s)]])))
        rank[s] += nth
        shared[rank[s[nth > 0]]] = LENGTH
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out, shared


def nearest_smaller(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, the least of `shared` from behind the nearest place above with a smaller value; 0 if there is none.

    Between a place and its candidate all values are larger, whether the candidate is final or not, so all places
    jump to their candidate's candidate at once until every candidate is smaller.
    """
    at, least = np.arange(len(value)) - 1, shared.copy()
    open_ = np.arange(1, len(value))
    while len(open_):
        open_ = open_[value[at[open_]] > value[open_]]
        further = at[open_]
        jump, low = at[further], np.minimum(least[open_], least[further])
        at[open_], least[open_] = jump, low
        open_ = open_[jump >= 0]
    least[at < 0] = 0
    return least


def longest_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """In suffix order, the longest match of each position that starts at a smaller one: from its previous and its next smaller position."""
    below = np.concatenate([shared[1:], [0]])[::-1] if len(shared) else shared
    return np.maximum(nearest_smaller(position, shared), nearest_smaller(position[::-1], below)[::-1])


def matches(contents: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each content and each start in it: is its longest previous, and its longest next factor LENGTH bytes long?

    Previous means in a content that comes before, or before in the same. Starts whose first 128 bytes have a hash of their own
    have none and are set aside first.
    """
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    many = sizes - LENGTH + 1
    starts = np.arange(many.sum()) + np.repeat(begins - (np.cumsum(many) - many), many)
    h = window_hashes(data, 128)[starts]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    left = np.sort(starts[order[twice]])
    earlier, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(left):
        order, shared = suffix_order(data, left)
        at = left[order]
        earlier[at[longest_factors(at, shared) >= LENGTH]] = True
        later[at[longest_factors(-at, shared) >= LENGTH]] = True
    cut = [slice(b, b + n) for b, n in zip(begins, many, strict=True)]
    return [earlier[c] for c in cut], [later[c] for c in cut]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last positions of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


_FOUND = "key long, ctx long, early_from array<int>, early_to array<int>, other_from array<int>, other_to array<int>"


def _suffix_order(most: int):
    """Over rows (key, ctx, first, content) in the order of key and first: the starts that have earlier and other matches."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        earlier, later = matches([c for _, _, c in group])
        a, b = [_runs(e) for e in earlier], [_runs(e | f) for e, f in zip(earlier, later, strict=True)]
        cols = [[k for k, _, _ in group], [c for _, c, _ in group], [x for x, _ in a], [x for _, x in a], [x for x, _ in b], [x for _, x in b]]
        types = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "ctx", "early_from", "early_to", "other_from", "other_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for key, ctx, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if group and (key, ctx) == group[-1][:2]:  # rows repeated with id and text give their contexts again
                    continue
                if size > most and key != group[-1][0]:
                    yield solve(group)
                    group, size = [], 0
                group.append((key, ctx, content))
                size += len(content)
        if group:
            yield solve(group)

    return run


_HALVES = "key long, ctx long, off int, part int, sub_key long, sub_ctx long, sub_off int, shift int, content binary, sub_first struct<doc_id:long,digest:long,lo:int>"


def _halve(level: int):
    """Split contexts by distance to the anchor, at multiples of a width that halves with each level."""
    width = max(1, -(-(LENGTH - ANCHOR + 1) >> level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, ctx, off, content, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Start r lies off - r before the anchor; distances run from off down to off - (starts - 1).
                near = off - (len(content) - LENGTH)
                for part in range(near // width, off // width + 1):
                    low, high = max(near, part * width), min(off, part * width + width - 1)
                    begin, end = off - high, off - low + LENGTH
                    core = content[off - part * width : off - (part * width + width - 1) + LENGTH]
                    own = content[begin:end]
                    sub = xxhash.xxh3_64_intdigest(core + key.to_bytes(8, "little", signed=True), part) - (1 << 63)
                    out.append((key, ctx, off, part, sub, xxhash.xxh3_64_intdigest(own) - (1 << 63), high, begin, own, first | {"lo": first["lo"] + begin}))
            for i in range(0, len(out), 20_000):
                cols = list(zip(*out[i : i + 20_000], strict=True))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), _PLACE)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "ctx", "off", "part", "sub_key", "sub_ctx", "sub_off", "shift", "content", "sub_first"])

    return run


def _repeats(sized: DataFrame, hot: int, level: int = 0) -> DataFrame:
    """_FOUND for each of the different contexts (key, ctx, contexts, off, first, content) of keys that have several.

    contexts is the number of the key's contexts, first the earliest place of one. Keys with more than hot are halved and solved on their own.
    """
    some = sized.where(F.col("contexts") <= hot).select("key", "ctx", "content", "first")
    found = some.repartition("key").sortWithinPartitions("key", "first").select("key", "ctx", "content").mapInArrow(_suffix_order(2 << 20), _FOUND)
    large = sized.where(F.col("contexts") > hot).select("key", "ctx", "off", "content", "first")
    if large.isEmpty():
        return stored(found, "found")
    if level > 8:
        raise RuntimeError("different strings of 200 bytes share one anchor of 200 bytes: two hashes collide")
    halves = stored(large.mapInArrow(_halve(level + 1), _HALVES), "halves")
    subs = halves.groupBy(F.col("sub_key").alias("key"), F.col("sub_ctx").alias("ctx")).agg(F.count("*").alias("n"), F.min("sub_first").alias("first"), F.first("sub_off").alias("off"), F.first("content").alias("content"))
    subs = stored(subs, "subs")
    several = subs.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1")
    inner = _repeats(subs.join(several, "key").select("key", "ctx", "contexts", "off", "first", "content"), hot, level + 1)
    inner = subs.select("key", "ctx", "n", "first").join(inner, ["key", "ctx"], "left").select(F.col("key").alias("sub_key"), F.col("ctx").alias("sub_ctx"), "n", "first", *[c for c in inner.columns if c not in ("key", "ctx")])
    back = halves.select("key", "ctx", "sub_key", "sub_ctx", "shift", "sub_first", (F.octet_length("content") - LENGTH).alias("last")).join(inner, ["sub_key", "sub_ctx"])
    whole = lambda x: F.array(x)
    none = F.array().cast("array<int>")
    moved = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: x + F.col("shift"))
    # A part that other contexts have as well is repeated as a whole, and earlier unless it is the first of them.
    also = F.col("n") > 1
    not_first = also & (F.col("sub_first") != F.col("first"))
    parts = back.select(
        "key", "ctx",
        F.when(not_first, whole(F.col("shift"))).otherwise(moved("early_from")).alias("early_from"),
        F.when(not_first, whole(F.col("shift") + F.col("last"))).otherwise(moved("early_to")).alias("early_to"),
        F.when(also, whole(F.col("shift"))).otherwise(moved("other_from")).alias("other_from"),
        F.when(also, whole(F.col("shift") + F.col("last"))).otherwise(moved("other_to")).alias("other_to"),
    )
    joined = parts.groupBy("key", "ctx").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("early_from", "early_to", "other_from", "other_to")])  # at most 2 ** level parts each
    return stored(found.unionByName(joined), "found")


def _removed(with_text: bool):
    """From (doc_id, text, runs of removed starts): what is left of each text, its bytes only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from one(batch)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, text, first, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            kept, done, removed, spans, end = [], 0, 0, 0, -1
            for a, b in sorted(zip(first or (), last or (), strict=True)):
                b += LENGTH
                if a > end:
                    kept.append(raw[done:a])
                    spans, removed, done, end = spans + 1, removed + b - a, b, b
                elif b > end:
                    removed, done, end = removed + b - end, b, b
            kept.append(raw[done:])
            left = b"".join(kept)
            out.append((doc_id, len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
        if out:
            cols = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _spread(rows: DataFrame, keys: DataFrame, key: str = "key", by: tuple[str, ...] = ("ctx",), ways: int = 32, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """rows and keys (with n, the rows of each) with a column salt: a key that holds over a share-th of all rows is dealt over ways tasks by a hash of `by`.

    There are fewer than share such keys, whatever the input.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in keys.where(F.col("n") > max(total // share, share)).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    dealt = F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(ways)).cast("int")).otherwise(0)), keys.withColumn("salt", F.explode(dealt))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", hot: int = 2000, with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 (and kept, the bytes left) of each row of df.

    keep "first" removes the later copies of a repeated string, in the order of id_col and position, and leaves its
    first; "none" removes every byte that any repeated string covers. Strings are judged on the input and
    never cross rows. Null texts are empty; texts under 200 bytes are left alone; an empty table gives no
    rows. Rows repeated with id and text are copies of each other, which "first" can't tell apart: all keep
    what the first would.

    Plan: runs of starts are narrow rows; those with an anchor of their own leave first, and equal contexts become
    one by their hashes. Only then are texts shuffled, to cut the first copy of each context whose key has others, and at
    the end to remove spans. Shuffle files and tables that are done with are released on the way.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    spark = df.sparkSession
    runs = stored(rows.mapInArrow(_find_anchors, _ANCHORS), "anchors")
    twice = stored(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    dealt, keys = _spread(runs, twice)
    places = stored(dealt.join(keys, ["key", "salt"], "left_semi").drop("salt"), "places")
    release(spark, runs, twice)
    contexts = stored(places.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "lo", "hi", "off")).alias("at")), "contexts")
    release(spark)
    # Only different contexts of one key need their bytes, each from its first place.
    several = stored(contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    dealt, keys = _spread(contexts.select("key", "ctx", "at"), several)
    wanted = dealt.join(keys.withColumnRenamed("n", "contexts"), ["key", "salt"]).select("at.doc_id", "at.digest", F.struct("key", "ctx", "contexts", "at.lo", "at.hi", "at.off").alias("run"))
    wanted = wanted.groupBy("doc_id", "digest").agg(F.collect_list("run").alias("runs"))  # bounded by the document
    texts = rows.withColumn("digest", F.conv(F.substring(F.sha2("text", 256), 1, 16), 16, -10).cast("long"))
    of_doc = (texts["doc_id"].eqNullSafe(wanted["doc_id"])) & (texts["digest"] == wanted["digest"])
    sized = stored(texts.join(wanted, of_doc).select(texts["doc_id"], texts["digest"], "text", "runs").mapInArrow(_cut_contexts, _CONTEXTS), "sized")
    release(spark)
    found = _repeats(sized, hot)
    release(spark, sized)
    contexts = contexts.select("key", "ctx", "n", F.struct("at.doc_id", "at.digest", "at.lo").alias("first"))
    all_ = contexts.select("key", "ctx", "n", "first").join(found, ["key", "ctx"], "left")
    if keep == "none":
        solved = all_.where("n > 1 OR size(other_from) > 0").select("key", "ctx", "n", (F.col("n") > 1).alias("whole"), F.lit(None).cast(contexts.schema["first"].dataType).alias("first"), F.col("other_from").alias("a"), F.col("other_to").alias("b"))
    else:
        solved = all_.where("n > 1 OR size(early_from) > 0").select("key", "ctx", "n", (F.col("n") > 1).alias("whole"), "first", F.col("early_from").alias("a"), F.col("early_to").alias("b"))
    # A passage that very many texts hold is one context with very many places.
    places, solved = _spread(places, stored(solved, "solved"), "ctx", ("doc_id", "lo"))
    places = places.join(solved, ["key", "ctx", "salt"])
    everything = F.col("whole") & (F.col("first").isNull() | (F.struct("doc_id", "digest", "lo") != F.col("first")))
    none = F.array().cast("array<int>")
    first = F.when(everything, F.array("lo")).otherwise(F.transform(F.coalesce("a", none), lambda x: x + F.col("lo")))
    last = F.when(everything, F.array("hi")).otherwise(F.transform(F.coalesce("b", none), lambda x: x + F.col("lo")))
    spans = places.select("doc_id", "digest", first.alias("first"), last.alias("last")).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    joined = texts.join(spans, (texts["doc_id"].eqNullSafe(spans["doc_id"])) & (texts["digest"] == spans["digest"]), "left").select(texts["doc_id"], "text", "first", "last")
    done = joined.mapInArrow(_removed(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
