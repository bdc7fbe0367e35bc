"""The manifest of papers and its check against the files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON or (where PyYAML is installed) YAML list. Ids look like p01 or u01, hashes have 64 hexadecimal digits, and there is an author; else this raises."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        rows = yaml.safe_load(raw)
    else:
        rows = json.loads(raw)
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MANIFEST)
    good = F.col("id").rlike(r"^[pu]\d{2}$") & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.size("authors") >= 1)
    return table.withColumn("id", F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad manifest row "), F.coalesce("id", F.lit("without id")))).cast("string")))


def problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem): repeated ids, missing files, other contents. files is a binaryFile scan."""
    hashes = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    both = manifest.join(hashes, "file", "left")
    say = lambda df, what: df.select("id", F.lit(what).alias("problem"))
    return (
        say(manifest.groupBy("id").count().where("count > 1"), "duplicate id")
        .unionByName(say(both.where("found IS NULL"), "missing file"))
        .unionByName(say(both.where("found != sha256"), "other content"))
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
