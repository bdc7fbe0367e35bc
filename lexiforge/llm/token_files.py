"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of whole documents, in blocks of 512. A block subtracts its minimum and packs the
differences at the width that a percentile of them needs; the few that need more leave their high bits in
a list of exceptions. Block starts are indexed, and so are the documents, so any block can be decoded
alone.

Layout, little-endian: magic; blocks; then the arrays block starts (uint64), document ids (int64) and
document lengths (uint32); then their sizes and the number of ids (uint64 each) and the magic again. A block: minimum
(uint32), width (uint8), exceptions (uint16), packed bits, exception positions (uint16), exception high parts (uint32).
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import scratch, small, stored, text_of
from lexiforge.llm.shared_files import read_whole, write_whole

MAGIC = b"LXFPFOR1"
BLOCK = 512
_HEAD, _FOOT = struct.Struct("<IBH"), struct.Struct("<QQQ")
NO_ID = -(2**63)


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """One bytes object for each block of 512 ids; the last block is filled up with its last id."""
    if not len(ids):
        return []
    full = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], ids.dtype)]).astype(np.uint32).reshape(-1, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    widths = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * len(full)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        own = rest[of]
        bits = np.unpackbits(own.astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(of), BLOCK * w), axis=1, bitorder="little")
        high = own >> np.uint32(w) if w < 32 else np.zeros_like(own)
        for i, b in enumerate(of):
            odd = np.flatnonzero(high[i])
            out[b] = _HEAD.pack(low[b], w, len(odd)) + packed[i].tobytes() + odd.astype("<u2").tobytes() + high[i][odd].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given offsets, in their order."""
    out = np.empty((len(starts), BLOCK), np.uint32)
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts]
    widths = np.array([h[1] for h in heads], np.int64)
    view = np.frombuffer(data, np.uint8)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        size = BLOCK * int(w) // 8
        packed = np.stack([view[int(starts[b]) + _HEAD.size : int(starts[b]) + _HEAD.size + size] for b in of])
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, int(w)) if w else 0
        own = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(of), BLOCK)
        for i, b in enumerate(of):
            if n := heads[b][2]:
                at = int(starts[b]) + _HEAD.size + size
                odd = np.frombuffer(data, "<u2", n, at)
                own[i, odd] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(w)
            out[b] = own[i] + np.uint32(heads[b][0])
    return out.reshape(-1)


def file_parts(ids: np.ndarray, doc_ids: list[int], lengths: list[int]) -> list[bytes]:
    blocks = encode_blocks(ids)
    starts = len(MAGIC) + np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]) if blocks else np.zeros(0)
    return [MAGIC, *blocks, starts.astype("<u8").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), _FOOT.pack(len(blocks), len(doc_ids), len(ids)), MAGIC]


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, document ids and document lengths of a file."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a token file, or cut off")
    blocks, docs, n = _FOOT.unpack_from(data, len(data) - len(MAGIC) - _FOOT.size)
    at = len(data) - len(MAGIC) - _FOOT.size - 4 * docs - 8 * docs - 8 * blocks
    starts = np.frombuffer(data, "<u8", blocks, at)
    return decode_blocks(data, starts)[:n], np.frombuffer(data, "<i8", docs, at + 8 * blocks), np.frombuffer(data, "<u4", docs, at + 8 * blocks + 8 * docs)


class Words(dict):
    """Ids of a white-space-separated word, as bytes. The tokenizer drops white space and joins nothing across it, so words can be encoded alone and kept.

    Words of Latin letters, with or without a mark at the end, are what its normaliser and splitter leave as
    one or two pieces; these go to its model directly. All others take the whole tokenizer.
    """

    most = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.old: dict[bytes, bytes] = {}  # the generation before, so that words in use outlive a full cache
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # Byte-level pieces write bytes as printable characters: those that print stand for themselves, the others follow from 256.
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in set(keep) else next(rest)) for b in range(256)}
        self.letters = [self.letters[b] for b in range(256)]

    def piece(self, core: str) -> bytes:
        text = core.lower()
        if not text.isascii():
            text = "".join(map(self.letters.__getitem__, text.encode()))
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encoded(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        core = text[:-1] if text[-1] in ".,;:!?" else text
        if core.isalpha() and (core.isascii() or (max(core) < "İ" and unicodedata.is_normalized("NFC", core))):
            return self.piece(core) if core is text else self[core.encode()] + self[text[-1].encode()]
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_words: dict[str, Words] = {}


def words_for(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_for(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        chunks, doc_ids, lengths, n, seq, out = [], [], [], 0, 0, []

        def flush() -> None:
            nonlocal n, seq
            uri = f"{folder}/part-{part:06d}-{seq:06d}.pfor"
            write_whole(uri, file_parts(np.frombuffer(b"".join(chunks), "<u4"), doc_ids, lengths))
            out.append((part, seq, uri, n, len(doc_ids)))
            n, seq = 0, seq + 1
            chunks.clear(), doc_ids.clear(), lengths.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(words.__getitem__, text.as_buffer().to_pybytes().split())) + end
                chunks.append(ids)
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(ids) // 4)
                n += lengths[-1]
                if n >= file_ids:
                    flush()
        if doc_ids:
            flush()
        if out:
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_ids", "n_docs"])

    return run


def write_ids(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_ids: int = 1 << 22, partitions: int | None = None) -> DataFrame:
    """Encode every text, append end_id, and write files into folder, in ascending order of id_col.

    Returns (part, seq, path, n_ids, n_docs, start), one row for each file; files in the order of part and seq hold the documents in
    ascending order, and start counts the ids before the file. Null texts are empty, null ids come first, rows
    with equal ids go by a hash of their text. An empty table writes nothing.

    Plan: a range shuffle by id (and hash, so that a repeated id can be split). A task streams its sorted
    rows into files of about file_ids ids; a document never spans files. Starts come from the sums of the
    partitions, of which there are as many as shuffle partitions, and a window within each.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    files = stored(rows.mapInArrow(_writer(folder, tokenizer, end_id, file_ids), "part int, seq int, path string, n_ids long, n_docs long"), "token-files")
    before, starts = 0, []
    for part, total in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row for each partition
        starts.append((part, before))
        before += total
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return files.join(F.broadcast(small(spark, starts, "part int, before long")), "part").withColumn("start", F.col("before") + own).drop("before")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, docs, lengths = parse_file(read_whole(path))
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths, dtype=np.int64)
            begins = ends - lengths
            crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(start + begins, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files: a file is a task's unit of work."""
    rows = files.select("path", "start")
    return rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all texts of df to files in the shared folder and return what the files say."""
    return read_back(write_ids(df, tokenizer, scratch(df.sparkSession, "tokens"), **options))
