"""Repairs and classes of blocks: sizes from spans, drop caps, leading headings, bylines, back matter, and the section of a marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import is_heading, n_words
from lexiforge.functions.udfs import partial_similarity
from lexiforge.operators.layout import FIGURE_CAPTION

#: Fixed value: how paragraphs of back matter begin.
BACKMATTER = (
    r"(?i)^(Author Contributions?|Authors[’'] contributions|Funding|Institutional Review Board Statement|Informed Consent Statement|"
    r"Data Availability Statement|Data Availability|Availability of data and materials|Conflicts? of Interest|Competing interests|"
    r"Acknowledge?ments?|Abbreviations|Supplementary Materials|Supporting information|Declarations?|Ethics approval[^:]*|"
    r"Consent for publication|Author details|Publisher[’']s Note)\s*[:.]"
)
#: How much larger than the body a drop cap is, than the body a styled line; the most words of a heading.
DROP_CAP, STYLED, HEADING_WORDS = 1.5, 1.08, 14


def is_backmatter_lead(text: Column) -> Column:
    return text.rlike(BACKMATTER)


def dominant_style(spans: DataFrame) -> DataFrame:
    """(doc, block, size, bold) of spans(doc, block, text, size, bold): the size with the most characters (of equals the larger), and whether over half of them are bold."""
    n = F.length("text")
    sizes = spans.groupBy("doc", "block", F.round("size", 1).alias("size")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("heavy"))
    return sizes.groupBy("doc", "block").agg(F.max_by("size", F.struct("n", "size")).alias("size"), (2 * F.sum("heavy") > F.sum("n")).alias("bold"))


def without_drop_caps(lines: DataFrame) -> DataFrame:
    """lines(doc, block, line, text, size, kind, body_size): a lone large capital is put before the first line of the next block of text.

    That line must begin with two capitals; else the letter stays where it is.
    """
    order = Window.partitionBy("doc").orderBy("block")
    head = F.row_number().over(Window.partitionBy("doc", "block").orderBy("line")) == 1
    rows = lines.withColumn("_head", head & (F.col("kind") == "text"))
    following = F.min(F.when(F.col("_head"), F.struct("block", "line", F.trim("text").alias("text")))).over(order.rangeBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_next", following)
    lone = F.trim("text").rlike("^[A-Z]$") & (F.col("size") >= DROP_CAP * F.col("body_size")) & F.col("_next.text").rlike("^[A-Z]{2,}")
    rows = rows.withColumn("_lone", F.coalesce(lone, F.lit(False)))
    caps = rows.where("_lone").groupBy("doc", F.col("_next.block").alias("block"), F.col("_next.line").alias("line"))
    caps = caps.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("block", "line", F.trim("text").alias("t"))))), lambda x: x["t"]), "").alias("_cap"))
    kept = rows.where("NOT _lone").join(caps, ["doc", "block", "line"], "left")
    return kept.withColumn("text", F.when(F.col("_cap").isNotNull(), F.concat("_cap", F.trim("text"))).otherwise(F.col("text"))).select(*lines.columns)


def split_leading_headings(blocks: DataFrame) -> DataFrame:
    """blocks(doc, no, kind, lines array<struct<text, size, bold>>, body_size) with part: a heading and the paragraph glued to it become parts 0 and 1.

    The first line must read as a heading by itself and no other line be styled.
    """
    first, rest = F.get("lines", F.lit(0)), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))
    plain = F.forall(rest, lambda x: ~x["bold"] & (x["size"] < STYLED * F.col("body_size")))
    heading = is_heading(first["text"], first["size"], first["bold"], F.lit(1), F.col("body_size"), F.col("kind"))
    split = (F.size("lines") >= 2) & (F.col("kind") == "text") & plain & (n_words(first["text"]) <= HEADING_WORDS) & heading
    parts = F.when(split, F.array(F.array(first), rest)).otherwise(F.array(F.col("lines")))
    return blocks.select(*[c for c in blocks.columns if c != "lines"], F.posexplode(parts).alias("part", "lines"))


def classified(stream: DataFrame, papers: DataFrame) -> DataFrame:
    """stream(doc, no, page, kind, text) with kind set to title, byline, backmatter or caption where rules say so; papers(doc, title, surnames).

    In order: a heading of the first two pages like the title is the title, one that begins as back matter with over 6 words is back matter. Of text,
    before the first heading what names an author in 40 words or fewer is a byline; then back matter by its beginning, then figure captions.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = stream.join(papers.select("doc", "title", "surnames"), "doc", "left").withColumn("_flat", flat)
    first = F.first("page").over(Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_early", F.col("page") <= first + 1)
    may = (F.col("kind") == "heading") & F.col("_early") & (F.length("_flat") > 15)
    alike = partial_similarity(F.when(may, F.lower("_flat")), F.when(may, F.lower("title"))) > 90
    rows = rows.withColumn("_title", F.coalesce(alike, F.lit(False)))
    opened = F.max(((F.col("kind") == "heading") & ~F.col("_title")).cast("int")).over(Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_opened", F.coalesce(opened, F.lit(0)) == 1)
    named = F.exists(F.filter(F.coalesce("surnames", F.array().cast("array<string>")), lambda s: F.length(s) > 2), lambda s: F.contains(F.col("_flat"), s))
    text, lead, words = F.col("kind") == "text", is_backmatter_lead(F.col("_flat")), n_words(F.col("_flat"))
    kind = (
        F.when(F.col("_title"), "title")
        .when((F.col("kind") == "heading") & lead & (words > 6), "backmatter")
        .when(text & ~F.col("_opened") & F.col("_early") & named & (words <= 40), "byline")
        .when(text & lead, "backmatter")
        .when(text & F.col("_flat").rlike(FIGURE_CAPTION), "caption")
        .otherwise(F.col("kind"))
    )
    return rows.withColumn("kind", kind).select(*stream.columns)


def marker_sections(stream: DataFrame) -> DataFrame:
    """(doc, no, marker, section) of the markers in stream(doc, no, marker, section): the section that was opened last before each."""
    last = F.last("section", ignorenulls=True).over(Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    return stream.withColumn("section", last).where("marker IS NOT NULL").select("doc", "no", "marker", "section")
