"""What the operators of this subpackage share: scratch space, small plan tables, and text basics."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint
    folder exists (a local session in tests) a temporary one is set.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not (found := context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiforge-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder under the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Drop stored tables that no later step reads, and let Spark delete the shuffle files of finished steps.

    Spark does the latter when the driver collects garbage; a job of many steps would else keep them all.
    """
    for table in done:
        for path in table.inputFiles()[:1]:
            _remove(spark, path.rpartition("/")[0])
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already; the cluster's own retention takes over
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table made on the driver. The caller bounds its rows by a parameter, never by the data."""
    return spark.createDataFrame(rows, schema)


def text_of(text: str | Column) -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Words of the text; null and empty have none.

    All separators become blanks, and words are counted where a blank is followed by something else.
    """
    plain = F.translate(text_of(text), SPACE, " " * len(SPACE))
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checked(rows: list, most: int, what: str) -> list:
    """rows collected with a limit of most + 1: fails loudly where the stated bound does not hold."""
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}; raise the bound if the driver can hold them")
    return rows
