"""Documents as JSON and Markdown, reports as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_markdown(parsed: DataFrame) -> DataFrame:
    """(paper_id, markdown) of parsed documents: title, sections with headings, tables, references."""
    blocks = lambda s: F.array_join(F.transform(s["blocks"], lambda b: F.when(b["kind"] == "equation", F.concat(F.lit("$$ "), F.coalesce(b["latex"], b["text"]), F.lit(" $$"))).otherwise(b["text"])), "\n\n")
    sections = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), blocks(s))), "\n\n")
    tables = F.array_join(F.transform("tables", lambda t: F.concat(F.lit("**"), t["caption"], F.lit("**\n\n"), t["markdown"])), "\n\n")
    refs = F.array_join(F.transform("references", lambda r: F.concat(F.lit("- "), r)), "\n")
    return parsed.select("paper_id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), sections, tables, refs).alias("markdown"))


def write_documents(parsed: DataFrame, folder: str) -> None:
    """Documents as JSON lines, and as Markdown in lines of JSON with their id: files by partition, not by document."""
    parsed.write.mode("overwrite").json(f"{folder}/json")
    as_markdown(parsed).write.mode("overwrite").json(f"{folder}/markdown")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Chunks as JSON lines, each paper's together and in order."""
    chunks.repartition("paper_id").sortWithinPartitions("paper_id", "seq").write.mode("overwrite").json(folder)


def events(answer: dict, sources: list[dict]) -> Iterator[tuple[str, dict]]:
    """What a client is sent for one answer: its sources, the text word by word, then the end; or the error alone."""
    if answer.get("error"):
        yield "error", {"message": answer["error"]}
        return
    yield "sources", {"sources": sources}
    for token in re.findall(r"\S+\s*", answer["text"]):
        yield "token", {"text": token}
    yield "done", {k: answer.get(k) for k in ("cited", "dropped", "refused")}


def report(table: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; it is a report, so most rows are shown."""
    rows = table.limit(most).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([f"# {title}", "", *lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def review_sample(judged: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Rows judged under 2 and n others in the order of a seeded hash of their id."""
    bad = judged.where("judge < 2")
    return bad.unionByName(judged.where("judge >= 2").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(n))
