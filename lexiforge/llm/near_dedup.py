"""Near-duplicate detection with BagMinHash signatures.

A text is the bag of its five-word shingles; similarity is weighted Jaccard, the sum of the smaller over the
sum of the larger counts. Signatures come from Poisson processes over (shingle, weight): intervals of weight
double in width, a point of an interval counts for a bag if its weight coordinate lies below the shingle's
count, and each signature component keeps its earliest point. Points arrive in order of time, so a shingle
stops once its next point is later than all components. Components agree with a probability that is the
similarity, without bias; bands of them propose candidates, and whole bags verify each link.

Candidates within a bucket are not all paired. Every member is compared with the bucket's most central
member; the links give components; and only in buckets that still hold more than one component are members
of different components compared, in blocks, in the first band that two of them share. A pair of one
component needs no link of its own, so no component differs from what all pairs of all buckets would give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name, stored, text_of

SHINGLE = 5
#: Odd multipliers of the positions in a shingle, and the constants of a 64-bit finaliser.
POSITIONS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their counts. A text of 1 to 4 words has one shingle, its words; one without words has none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64), np.ones(1, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(POSITIONS):
        total += w[i : i + n] * p
    return np.unique(mixed(total), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash signatures, a row of m times for each bag; rows of empty bags are infinite."""
    sig = np.full(len(bags) * m, np.inf)
    sizes = [len(h) for h, _ in bags]
    if not sum(sizes):
        return sig.reshape(-1, m)
    h, c = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    # Interval 0 is [0, 1), interval j > 0 is [2^(j-1), 2^j); a shingle takes part in those that begin below its count.
    h_, d_, low, width, level = [h], [doc], [np.zeros(len(h))], [np.ones(len(h))], [np.zeros(len(h), np.uint64)]
    count_ = [c]
    for j in range(1, int(c.max()).bit_length() + 1):
        of = np.flatnonzero(c > 1 << (j - 1))
        for to, x in ((h_, h[of]), (d_, doc[of]), (count_, c[of]), (low, np.full(len(of), float(1 << (j - 1)))), (width, np.full(len(of), float(1 << (j - 1)))), (level, np.full(len(of), j, np.uint64))):
            to.append(x)
    h, doc, c, low, width, level = (np.concatenate(x) for x in (h_, d_, count_, low, width, level))
    seed = mixed(h + level * _STEP)
    time, slot, k = np.zeros(len(h)), doc * m, 0
    last = np.full(len(bags), np.inf)
    while len(seed):
        k += 1
        a = mixed(seed + np.uint64(2 * k * int(_STEP) % (1 << 64)))
        b = mixed(a + _STEP)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
        live = np.flatnonzero(time < last[doc])
        seed, time, slot, doc, c, low, width, b = seed[live], time[live], slot[live], doc[live], c[live], low[live], width[live], b[live]
        inside = low + width * ((b >> np.uint64(32)).astype(np.float64) * 2.0**-32) < c
        at = slot + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(sig, at[inside], time[inside])
        if k < 8 or k % 4 == 0:
            last = sig.reshape(-1, m).max(axis=1)
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = sig[:, : bands * rows].reshape(-1, bands, rows).view(np.uint64)
    key = np.zeros(bits.shape[:2], np.uint64)
    for r in range(rows):
        key = mixed(key + bits[:, :, r] * np.uint64(2 * r + 1) + _STEP)
    return key.view(np.int64)


def _signer(bands: int, rows: int, chunk: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                digests, bags, n, begin = [], [], 0, at
                while at < len(texts) and n < chunk:
                    raw = texts[at].as_buffer().to_pybytes()
                    digests.append(hashlib.sha256(raw).digest()[:16])
                    bags.append(bag(raw))
                    n += len(bags[-1][0])
                    at += 1
                keys = band_keys(signatures(bags, bands * rows), bands, rows)
                flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                empty = pa.array([not len(b[0]) for b in bags])
                sizes = pa.array([int(b[1].sum()) for b in bags], pa.int64())
                yield pa.RecordBatch.from_arrays([ids[begin:at], pa.array(digests, pa.binary()), sizes, pa.compute.if_else(empty, pa.scalar(None, flat.type), flat)], names=["doc_id", "digest", "shingles", "bands"])

    return run


def digest_of(text: Column) -> Column:
    """Identifies a text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def packed(h: np.ndarray, c: np.ndarray) -> bytes:
    """A bag as bytes: the number of shingles, their hashes, and their counts where one is above 1."""
    return len(h).to_bytes(8, "little") + h.astype("<u8").tobytes() + (c.astype("<u4").tobytes() if len(c) and c.max() > 1 else b"")


def unpacked(raw) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts, read in place."""
    n = int.from_bytes(bytes(memoryview(raw)[:8]), "little")
    h = np.frombuffer(raw, "<u8", n, 8)
    return h, np.frombuffer(raw, "<u4", n, 8 + 8 * n) if len(raw) > 8 + 8 * n else np.ones(n, np.uint32)


def _bagger(most: int = 1 << 22):
    """From (digest, text): (digest, bag). A batch is given out in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, begin = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                out.append(packed(*bag(text.as_buffer().to_pybytes())))
                n += len(out[-1])
                if n > most or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin : i + 1], pa.array(out, pa.binary())], names=["digest", "bag"])
                    out, n, begin = [], 0, i + 1

    return run


def _verifier(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                (h1, c1), (h2, c2) = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                n1, n2 = int(c1.sum()), int(c2.sum())
                if len(h1) > len(h2):
                    h1, c1, h2, c2 = h2, c2, h1, c1
                at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
                both = int(np.minimum(c1, c2[at])[h2[at] == h1].sum())
                if denominator * both >= numerator * (n1 + n2 - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, bags: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of digests whose whole bags are similar enough."""
    left = bags.select(F.col("digest").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("digest").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
    return both.mapInArrow(_verifier(*similarity), "a binary, b binary")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for each node of the edges (a, b): nodes share a label if a path joins them.

    Every node takes the least of itself and its neighbours, edges are carried over to the labels, and so on
    until none is left; digests are in random order, so a round leaves a fraction of the nodes. Each round is
    a table in the shared folder; nothing is collected.
    """
    rounds = []
    edges = stored(edges.select("a", "b").where("a != b").distinct(), name)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), name)
        rounds.append(labels)
        a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = edges.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        edges = stored(moved.distinct(), name)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = rounds[0]
    for labels in rounds[1:]:
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return stored(found, name)


class _Block:
    """Members of a bucket side by side: hashes and counts of all bags in one array each."""

    def __init__(self) -> None:
        self.digests, self.labels, self.keys, self.bags = [], [], [], []

    def add(self, digest: bytes, label: bytes, keys: np.ndarray, bag_: tuple[np.ndarray, np.ndarray]) -> None:
        self.digests.append(digest)
        self.labels.append(label)
        self.keys.append(keys)
        self.bags.append((bag_[0].copy(), bag_[1].copy()))  # the batch that they lie in goes

    def close(self) -> None:
        self.all_keys = np.array(self.keys)
        self.lengths = np.array([len(h) for h, _ in self.bags])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.sizes = np.array([int(c.sum()) for _, c in self.bags])
        self.hashes, self.counts = (np.concatenate([b[k] for b in self.bags]) for k in (0, 1))


def _compare(numerator: int, denominator: int):
    """Over rows (group, side, digest, label, band, bands, bag) in the order of group and side: links between members of different components.

    A group is two blocks of one bucket (sides 1 and 2), or one block with itself (side 0). One block is held, the members of the
    other pass by. A pair is compared in the first band that it shares, so in one task of all, and not at all once it is of one component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, closed, root = _Block(), None, False, {}

        def find(x: bytes) -> bytes:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def links(digest: bytes, label: bytes, keys: np.ndarray, own: tuple[np.ndarray, np.ndarray], band: int, upto: int) -> Iterator[tuple[bytes, bytes]]:
            h, c = own
            size, mine = int(c.sum()), find(label)
            sizes = block.sizes[:upto]
            ok = denominator * np.minimum(sizes, size) >= numerator * np.maximum(sizes, size)
            ok &= ~(block.all_keys[:upto, :band] == keys[:band]).any(axis=1)
            which = np.array([k for k in np.flatnonzero(ok) if find(block.labels[k]) != mine], np.int64)
            if not len(which):
                return
            lengths = block.lengths[which]
            of = np.repeat(np.arange(len(which)), lengths)
            cells = np.arange(len(of)) + np.repeat(block.begins[which] - (np.cumsum(lengths) - lengths), lengths)
            at = np.minimum(np.searchsorted(h, block.hashes[cells]), len(h) - 1)
            both = np.bincount(of, weights=np.where(h[at] == block.hashes[cells], np.minimum(c[at], block.counts[cells]), 0), minlength=len(which)).astype(np.int64)
            for k in np.flatnonzero(denominator * both >= numerator * (size + sizes[which] - both)):
                a, b = find(label), find(block.labels[which[k]])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield digest, block.digests[which[k]]

        def alone(band: int) -> Iterator[tuple[bytes, bytes]]:
            block.close()
            for i in range(1, len(block.digests)):
                yield from links(block.digests[i], block.labels[i], block.keys[i], block.bags[i], band, i)

        def out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        last = None  # side and band of the group at hand
        for batch in batches:
            found, bands, starts = [], batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy() - batch.column(5).offsets[0].as_py()
            sides, at_band = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for i, g in enumerate(batch.column(0)):
                if (g := g.as_py()) != group:
                    if last and last[0] == 0:
                        found += alone(last[1])
                    block, group, closed, root = _Block(), g, False, {}
                last = int(sides[i]), int(at_band[i])
                row = batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), bands[starts[i] : starts[i + 1]], unpacked(batch.column(6)[i].as_buffer())
                if last[0] < 2:
                    block.add(row[0], row[1], row[2].copy(), row[3])
                elif block.digests:
                    if not closed:
                        block.close()
                        closed = True
                    found += links(*row, last[1], len(block.digests))
            if found:
                yield out(found)
        if last and last[0] == 0 and (found := list(alone(last[1]))):
            yield out(found)

    return run


def compared_blocks(members: DataFrame, bags: DataFrame, similarity: tuple[int, int], block: int = 256, cells: int = 250_000) -> DataFrame:
    """Links (a, b) among members(band, key, n, total, digest, label, bands) of one bucket and different labels.

    A bucket of n members with total shingles is cut by a hash into blocks of some block members or cells shingles, and each two blocks meet
    in a task: a member goes to as many tasks as there are blocks, and a task holds one block, whatever the bucket's size.
    """
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / cells))
    rows = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    group = F.unhex(F.sha2(F.concat_ws(":", "band", "key", low, high), 256))
    rows = rows.select(group.alias("group"), side.alias("side"), "digest", "label", "band", "bands")
    full = rows.join(bags, "digest").select("group", "side", "digest", "label", "band", "bands", "bag")
    return full.repartition("group").sortWithinPartitions("group", "side", "digest").mapInArrow(_compare(*similarity), "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, rows: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """id_col, class_id, class_size and kept for each row of df.

    Texts are linked when identical or when their bags reach the similarity (given as a fraction); classes are
    what links join. class_id is the least id in the class, and of the rows with it one is kept. Words are split at ASCII white space; a text of 1 to
    4 words is one shingle; texts without words (null counts as empty) are linked to identical ones only. An empty table gives no rows; other
    columns are not looked at. At a similarity of exactly 0.8, 32 bands of 5 miss a pair once in 300,000.
    """
    rows_ = df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    signed = stored(rows_.mapInArrow(_signer(bands, rows), "doc_id long, digest binary, shingles long, bands array<long>"), "signatures")
    unique = signed.groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    members = unique.select("digest", "shingles", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    inside = stored(members.join(shared, ["band", "key"]), "buckets")
    weight = inside.groupBy("digest").agg(F.sum("n").alias("weight"))
    central = inside.join(weight, "digest").groupBy("band", "key").agg(F.max(F.struct("weight", "digest", "shingles")).alias("of")).select("band", "key", F.col("of.digest").alias("centre"), F.col("of.shingles").alias("of"))
    alike = F.lit(similarity[1]) * F.least("shingles", "of") >= F.lit(similarity[0]) * F.greatest("shingles", "of")
    star = inside.join(central, ["band", "key"]).where((F.col("digest") != F.col("centre")) & alike).select(F.col("digest").alias("a"), F.col("centre").alias("b"))
    star = stored(star.distinct(), "pairs")
    digest = digest_of(text_of(text_col))
    texts = df.select(digest.alias("digest"), F.encode(text_of(text_col), "UTF-8").alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    texts = texts.join(inside.select("digest").distinct(), "digest", "left_semi")
    bags = stored(texts.select("digest", "text").mapInArrow(_bagger(), "digest binary, bag binary"), "bags")
    links = stored(verified(star, bags, similarity), "links")
    labels = components(links)
    # What is left: members of different components in one bucket, not yet compared.
    placed = inside.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    mixed_ = placed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("shingles").alias("total")).where("low != high AND low IS NOT NULL").select("band", "key", "total")
    open_ = placed.join(mixed_, ["band", "key"]).where("n > 2").select("band", "key", "n", "total", "digest", "label")
    open_ = stored(open_.join(unique.select("digest", "bands"), "digest"), "open")
    more = stored(compared_blocks(open_, bags, similarity), "links")
    labels = components(links.union(more))
    classes = signed.select("doc_id", "digest").join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    classes = classes.groupBy("label", "digest", "doc_id").agg(F.count("*").alias("times"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("times").alias("class_size"), F.min(F.struct("doc_id", "digest")).alias("first"))
    found = classes.join(least, "label").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")) & (F.col("nth") == 1)
    return found.select(F.col("doc_id").alias(id_col), "class_id", "class_size", kept.alias("kept"), "digest")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that stay, one of each class, with all their columns.

    Repeated rows with the same id and text are one row, of which one copy stays.
    """
    digest, key, nth = free_name(df, "digest"), free_name(df, "row_id"), free_name(df, "row_order")
    # Ids without nulls on both sides, so that one shuffle of the texts serves the join and the window.
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    kept = near_duplicates(df, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    kept = kept.select(F.col("_kept_digest").alias(digest), known("_kept_id").alias(key))
    rows = df.withColumns({digest: digest_of(text_of(text_col)), key: known(id_col)}).join(kept, [digest, key], "left_semi")
    order = Window.partitionBy(digest, key).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*df.columns)
