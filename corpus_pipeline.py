"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir), gets what the stage before kept, and returns a DataFrame;
all but the last return the columns of documents. Between stages the result is a Parquet table in the shared
folder, so a lost executor costs the stage at hand at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import exact_dedup, mixing, near_dedup, packing, quality
from lexiforge.llm.common import stored, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows are judged alike and all stay or go;
    an empty table stays empty, other columns are kept, whatever their names.
    """
    return quality.drop_low_quality(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows repeated with it, one.

    A null text equals an empty one, a null id is less than any; an empty table stays empty, other columns are kept, whatever their names.
    """
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least id; of rows repeated with it, one.

    Texts without words are like identical ones only; an empty table stays empty, other columns are kept, whatever their names.
    """
    return near_dedup.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it doesn't take go.

    A null source is a source; texts without words are never taken; ties go by a seeded hash of id and text, and rows that agree in both are
    taken together; an empty table stays empty, other columns are kept, whatever their names.
    """
    return mixing.repeated(mixing.mix_documents(docs, word_count("text")), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of each document, in words.

    Long texts are cut into full sequences and a rest; texts without words have one piece of no words in no sequence; repeated rows are packed as often as
    they come, ties in the order of a hash of id and text; an empty table gives no rows. Of other columns none is returned.
    """
    return packing.pack(docs, word_count("text"), order=("text",))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express signatures, flows and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
