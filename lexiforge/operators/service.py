"""What stands around a question: guards, the verdict of a judge, the gold set, and a stand-in embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the most characters of a question.
MOST_CHARS = 500


def code_matches(given: Column, configured: Column) -> Column:
    """Whether an access code is right; without a configured one everybody may ask. Digests are compared, so time tells nothing of the code."""
    return (F.coalesce(configured, F.lit("")) == "") | (F.sha2(F.coalesce(given, F.lit("")), 256) == F.sha2(configured, 256))


def guarded(requests: DataFrame, configured: str = "", cap: int = 200, most_chars: int = MOST_CHARS) -> DataFrame:
    """requests(code, message, nth[, limited]) with status and reason of the first rule that fails, in the order code, empty, length, rate, daily cap; 200 and null if none does."""
    message = F.trim(F.coalesce("message", F.lit("")))
    limited = F.col("limited") if "limited" in requests.columns else F.lit(False)
    rules = ((~code_matches(F.col("code"), F.lit(configured)), 401, "code"), (message == "", 400, "empty"), (F.length(message) > most_chars, 400, "length"), (limited, 429, "rate"), (F.col("nth") > cap, 429, "budget"))
    status, reason = F, F
    for failed, number, name in rules:
        status, reason = status.when(failed, number), reason.when(failed, name)
    return requests.withColumns({"status": status.otherwise(200), "reason": reason})


def verdicts(replies: DataFrame, schema: str = "score int, faithful boolean, reason string") -> DataFrame:
    """replies(id, text, ...) with the verdict's fields and error: what can't be read as JSON says so with its beginning, and has no fields."""
    read = F.from_json(F.col("text"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = replies.withColumn("_v", read)
    bad = F.col("_v").isNull() | F.col("_v._bad").isNotNull()
    names = [c.strip().split()[0] for c in schema.split(",")]
    error = F.when(bad, F.concat(F.lit("unparseable judge output: "), F.substring(F.coalesce("text", F.lit("")), 1, 120)))
    return rows.select(*replies.columns, *[F.when(~bad, F.col("_v")[n]).alias(n) for n in names], error.alias("error"))


def answerable(gold: DataFrame) -> DataFrame:
    """Questions that some paper answers."""
    return gold.where((F.col("type") != "unanswerable") & (F.size("papers") > 0))


def with_originals(gold: DataFrame) -> DataFrame:
    """gold(qid, paraphrase_of, must_include): a paraphrase needs what its original needs."""
    original = gold.select(F.col("qid").alias("paraphrase_of"), F.col("must_include").alias("_needs"))
    return gold.join(original, "paraphrase_of", "left").withColumn("must_include", F.coalesce("_needs", "must_include")).select(*gold.columns)


#: Fixed value: what a question, not a passage, is embedded after.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed_vector(text: str, size: int) -> np.ndarray:
    """Words and their three-letter pieces, dealt with signs over the places of a unit vector."""
    out = np.zeros(size)
    for word in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
        for piece in (word, *(f"^{word}$"[i : i + 3] for i in range(len(word)))):
            h = xxhash.xxh3_64_intdigest(piece)
            out[h % size] += 1.0 if h >> 63 else -1.0
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def _embedder(size: int, prefix: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vec": [hashed_vector(prefix + (t or ""), size).tolist() for t in f["text"]]})

    return run


#: Embedders by name: (size, prefix of questions). More can be added: (id, text) becomes (id, vec), vectors of unit length.
EMBEDDERS = {"hashed-256": (256, QUERY_PREFIX), "hashed-64": (64, "")}


def embedded(texts: DataFrame, name: str = "hashed-256", questions: bool = False) -> DataFrame:
    """(id, vec) of texts(id, text): a deterministic stand-in for a model, in batches. Questions get the embedder's prefix, passages don't."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name}; there are {', '.join(sorted(EMBEDDERS))}")
    size, prefix = EMBEDDERS[name]
    return texts.select(F.col("id").cast("long"), "text").mapInPandas(_embedder(size, prefix if questions else ""), "id long, vec array<double>")
