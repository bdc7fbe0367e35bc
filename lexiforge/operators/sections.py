"""Sections, equations and captions from blocks in reading order: gaps and islands over a document's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.mathtext import EQUATION_NUMBER, ascii_words, equation_placeholder, is_equation, is_math_line
from lexiforge.functions.text import heading_level, is_heading, section_label

ABSTRACT_PREFIX = r"^\s*(Abstract|ABSTRACT)\s*[.:—–-]?\s*"


def body_size(blocks: DataFrame) -> DataFrame:
    """(doc, body_size): the size with the most characters, among blocks of 3 lines or more that are mostly letters; 10 without any."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    rows = blocks.where((F.col("lines") >= 3) & (letters > 0.6 * F.length("text")))
    each = rows.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    best = each.groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("body_size"))
    return blocks.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def classified(blocks: DataFrame) -> DataFrame:
    """blocks(doc, no, kind, text, raw, size, bold, lines) with heading, equation, level and label."""
    rows = blocks.join(body_size(blocks), "doc")
    rows = rows.withColumn("heading", is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("lines"), F.col("body_size"), F.col("kind")))
    return rows.withColumns({"equation": ~F.col("heading") & (F.col("kind") == "text") & is_equation(F.col("text"), F.col("raw")), "level": F.when(F.col("heading"), heading_level(F.col("text"), F.col("bold"))), "label": F.when(F.col("heading"), section_label(F.col("text")))})


def assembled(blocks: DataFrame) -> DataFrame:
    """Each classified block with its section: section_no, section_label, section_heading.

    A heading opens a section. A subsection whose words say nothing takes the label of its top-level section and is named after it. Once references begin
    they take all that follows but back matter and appendices. Before the first heading, a block that begins
    with "Abstract" opens the abstract; else it is front matter.
    """
    order = Window.partitionBy("doc").orderBy("no")
    starts = F.col("heading") | (F.col("text").rlike(ABSTRACT_PREFIX) & (F.length(F.regexp_replace("text", ABSTRACT_PREFIX, "")) > 40))
    rows = blocks.withColumn("starts", starts).withColumn("section_no", F.sum(F.col("starts").cast("int")).over(order))
    top = F.last(F.when(F.col("heading") & (F.col("level") == 1), F.struct("label", "text")), ignorenulls=True).over(order)
    own = F.last(F.when(F.col("starts"), F.struct(F.coalesce("label", F.lit("abstract")).alias("label"), F.when(F.col("heading"), F.col("text")).otherwise("Abstract").alias("text"), F.coalesce("level", F.lit(1)).alias("level"))), ignorenulls=True).over(order)
    rows = rows.withColumns({"top": top, "own": own})
    label = F.when(F.col("own").isNull(), "frontmatter").when((F.col("own.label") == "other") & (F.col("own.level") > 1), F.coalesce("top.label", F.lit("other"))).otherwise(F.col("own.label"))
    heading = F.when(F.col("own").isNull(), "").when((F.col("own.level") > 1) & F.col("top").isNotNull(), F.concat("top.text", F.lit(" > "), "own.text")).otherwise(F.col("own.text"))
    rows = rows.withColumns({"section_label": label, "section_heading": heading})
    swallowed = F.max((F.col("section_label") == "references").cast("int")).over(order) == 1
    rows = rows.withColumn("section_label", F.when(swallowed & (F.col("section_label") != "backmatter"), "references").otherwise(F.col("section_label")))
    return rows.drop("top", "own", "starts")


def equation_runs(blocks: DataFrame) -> DataFrame:
    """(doc, page, run, first, n, placeholder): neighbouring equation blocks of a page as one."""
    order = Window.partitionBy("doc", "page").orderBy("no")
    rows = blocks.withColumn("run", F.sum((~F.col("equation")).cast("int")).over(order)).where("equation")
    number = F.regexp_extract("text", EQUATION_NUMBER, 1)
    runs = rows.groupBy("doc", "page", "run").agg(F.min("no").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("no", number.alias("number")))).alias("numbers"))
    return runs.withColumn("placeholder", equation_placeholder(F.filter(F.transform("numbers", lambda x: x["number"]), lambda x: x != ""))).drop("numbers")


def line_islands(lines: DataFrame) -> DataFrame:
    """(doc, island, math, first, n) of lines(doc, line_no, line): runs of neighbouring lines that are all mathematics or all prose.

    Where no line has four real words nothing tells prose apart, and all stay one run of no mathematics.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    wordy = F.max((ascii_words(F.col("line")) >= 4).cast("int")).over(Window.partitionBy("doc")) == 1
    rows = lines.withColumn("math", is_math_line(F.col("line"), F.col("line")) & wordy)
    change = F.coalesce((F.col("math") != F.lag("math").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("island", F.sum("change").over(order))
    return rows.groupBy("doc", "island", "math").agg(F.min("line_no").alias("first"), F.count("*").alias("n"))


def with_captions(blocks: DataFrame) -> DataFrame:
    """Table blocks of blocks(doc, no, kind, text) with the caption that was pending, which the table before it hasn't taken."""
    order = Window.partitionBy("doc").orderBy("no")
    taken = F.sum((F.col("kind") == "table").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.withColumn("taken", F.coalesce(taken, F.lit(0)))
    pending = F.last(F.when(F.col("kind") == "caption", F.col("text")), ignorenulls=True).over(Window.partitionBy("doc", "taken").orderBy("no"))
    return rows.withColumn("caption", pending).where("kind = 'table'").drop("taken")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks(doc, page, no, box, layout, width, footnote) with place, their place on the page.

    In one column by rows of 3 points, then left to right. In two columns, full-width blocks cut bands;
    within a band the left column comes before the right. Footnotes come last.
    """
    middle = F.col("width") / 2
    full = (F.col("box.x0") < middle - 20) & (F.col("box.x1") > middle + 20)
    rows = blocks.withColumn("full", full & (F.col("layout") == "two_column"))
    above = F.sum(F.col("full").cast("int")).over(Window.partitionBy("doc", "page").orderBy("box.y0", "no"))
    column = F.when(F.col("full"), -1).when((F.col("box.x0") + F.col("box.x1")) / 2 < middle, 0).otherwise(1)
    two = F.struct("footnote", above.alias("band"), column.alias("column"), F.col("box.y0").alias("y"), F.col("box.x0").alias("x"))
    one = F.struct("footnote", F.lit(0).cast("long").alias("band"), F.lit(0).alias("column"), F.round(F.col("box.y0") / 3).alias("y"), F.col("box.x0").alias("x"))
    rows = rows.withColumn("_key", F.when(F.col("layout") == "two_column", two).otherwise(one))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc", "page").orderBy("_key", "no"))).drop("_key", "full")


def outside_regions(blocks: DataFrame, regions: DataFrame, slack: float = 1.0) -> DataFrame:
    """blocks(doc, page, box) whose centre lies in none of regions(doc, page, area)."""
    areas = regions.groupBy("doc", "page").agg(F.collect_list("area").alias("areas"))
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    inside = F.exists("areas", lambda a: x.between(a["x0"] - slack, a["x1"] + slack) & y.between(a["y0"] - slack, a["y1"] + slack))
    return blocks.join(areas, ["doc", "page"], "left").where(F.col("areas").isNull() | ~inside).drop("areas")


def references(blocks: DataFrame) -> DataFrame:
    """(doc, refs): entries of reference lines(doc, line_no, line); one begins at [n], n. or Surname, X. and others continue it; entries of 10 characters or less go."""
    order = Window.partitionBy("doc").orderBy("line_no")
    begins = F.col("line").rlike(r"^\s*(\[\d+\]|\d{1,3}\.\s|\p{Lu}[\p{L}'’-]+,\s*\p{Lu}\.)")
    rows = blocks.withColumn("entry", F.sum(begins.cast("int")).over(order))
    joined = rows.groupBy("doc", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"))
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"^(\[\d+\]|\d{1,3}\.)\s*", ""), r"(\p{Ll})- (\p{Ll})", "$1$2"))
    return joined.select("doc", "entry", text.alias("text")).where(F.length("text") > 10).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "text"))), lambda x: x["text"]).alias("refs"))
