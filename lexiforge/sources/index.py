"""The index as tables: chunks, postings, vectors and a row of metadata, published as a whole through a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.operators.retrieve import bm25_indexed, corpus_stats, postings, term_part
from lexiforge.operators.state import fingerprint


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make `version` the current one: a small file is replaced in one step, so a reader sees the old version or the new."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    draft, final = hadoop.Path(f"{path}/.current-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/current")
    fs = draft.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    hadoop.FileContext.getFileContext(fs.makeQualified(final).toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), how)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the index's current version."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return f"{path}/{bytes(stream.readNBytes(200)).decode()}"
    finally:
        stream.close()


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with id: by paper and seq. Counted in three steps, by beginnings of paper ids, papers and chunks, so that no task sees all papers."""
    sizes = chunks.groupBy("paper_id").agg(F.count("*").alias("_n")).withColumn("_head", F.substring("paper_id", 1, 4))
    heads = sizes.groupBy("_head").agg(F.sum("_n").alias("_all"))
    all_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_head", F.coalesce(F.sum("_all").over(all_before(Window.orderBy("_head"))), F.lit(0)).alias("_first"))  # a row for each beginning
    within = F.coalesce(F.sum("_n").over(all_before(Window.partitionBy("_head").orderBy("paper_id"))), F.lit(0))
    starts = sizes.withColumn("_within", within).join(heads, "_head").select("paper_id", (F.col("_first") + F.col("_within")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq"))
    return chunks.join(starts, "paper_id").withColumn("id", nth + F.col("_before")).drop("_before")


def build(chunks: DataFrame, papers: DataFrame, vectors: DataFrame, path: str, model: str, partitions: int = 64) -> None:
    """Write all tables as a new version under path and point to it once they are whole. Postings are partitioned by a term's hash, chunks by collection.

    Older versions stay for those who still read them.
    """
    spark = chunks.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    draft = f"{path}/{version}"
    chunks.sortWithinPartitions("paper_id", "seq").write.partitionBy("collection").parquet(f"{draft}/chunks")
    papers.write.parquet(f"{draft}/papers")
    vectors.write.parquet(f"{draft}/vectors")
    posts = postings(chunks, "id", "embed_text").withColumn("part", term_part(F.col("term"), partitions))
    posts.repartition("part").sortWithinPartitions("term", "id").write.partitionBy("part").parquet(f"{draft}/postings")
    hashes = fingerprint(chunks, "paper_id", "seq").select(F.lit(0).alias("all"), "paper_id", F.col("fingerprint").alias("h"))
    whole = fingerprint(hashes, "all", "paper_id", "h").select("fingerprint", F.col("n").alias("papers"))
    stats = corpus_stats(chunks, "embed_text")
    meta = whole.crossJoin(F.broadcast(stats))  # both are one row
    meta.withColumns({"model": F.lit(model), "partitions": F.lit(partitions), "built_at": F.current_timestamp()}).coalesce(1).write.parquet(f"{draft}/meta")
    _point(spark, path, version)


def open_index(spark: SparkSession, path: str, model: str) -> dict[str, DataFrame]:
    """The tables of the current version, if it was built with this model."""
    folder = current(spark, path)
    meta = spark.read.parquet(f"{folder}/meta")
    if (built := meta.first()["model"]) != model:
        raise ValueError(f"the index was built with {built}, not {model}: build it again")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "papers", "vectors", "postings", "meta")}


def search_words(index: dict[str, DataFrame], questions: DataFrame, k: int = 30, keep: Column | None = None) -> DataFrame:
    """BM25 over the index's postings: only the partitions of asked terms are read."""
    partitions = index["meta"].first()["partitions"]
    allowed = index["chunks"].where(keep).select("id") if keep is not None else None
    return bm25_indexed(questions, index["postings"], index["meta"].select("n", "avgdl"), k, partitions, allowed)


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("id"), "id", "left_anti")
