"""Blocks from the JSON output of layout models, in the schema that all parsers share, and the registry of parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of the two formats; None drops a block (and counts it), types not listed are text (and counted).
TYPED = {"text": "text", "title": "heading", "interline_equation": "equation", "equation": "equation", "table": "table", "image": None, "figure": None, "list": "list", "header": None, "footer": None, "page_number": None, "page_footnote": "footnote", "aside_text": None, "ref_text": "reference", "code": "text"}
TREE = {"Text": "text", "TextInlineMath": "text", "SectionHeader": "heading", "Equation": "equation", "Table": "table", "Caption": "caption", "Footnote": "footnote", "ListItem": "list", "Handwriting": "text", "Code": "text", "Form": "text", "ComplexRegion": "text", "TableOfContents": None, "Picture": None, "Figure": None, "PageHeader": None, "PageFooter": None, "Reference": "reference"}
GROUPS = ("ListGroup", "TableGroup", "FigureGroup", "PictureGroup")
_TYPED = "doc string, pages array<struct<page:int,width:double,height:double,blocks:array<struct<type:string,bbox:array<double>,text:string,latex:string,html:string,level:int>>>>"
_TREE = "doc string, pages array<struct<page:int,blocks:array<struct<block_type:string,bbox:array<double>,html:string,children:array<struct<block_type:string,bbox:array<double>,html:string>>>>>>"


def kind_of(type_, kinds: dict[str, str | None]):
    known = F.create_map(*[F.lit(x) for k, v in kinds.items() if v for x in (k, v)])
    dropped = [k for k, v in kinds.items() if v is None]
    return F.when(type_.isin(dropped), None).otherwise(F.coalesce(F.element_at(known, type_), F.lit("text")))


def box(b, width=1.0, height=1.0):
    return F.struct((b[0] * width).alias("x0"), (b[1] * height).alias("y0"), (b[2] * width).alias("x1"), (b[3] * height).alias("y1"))


def typed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, no, kind, box, text, latex, html, dropped): typed blocks, whose boxes are fractions of the page."""
    rows = spark.read.schema(_TYPED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pages = rows.select("doc", F.explode("pages").alias("p"))
    blocks = pages.select("doc", "p.page", "p.width", "p.height", F.posexplode("p.blocks").alias("no", "b"))
    kind = kind_of(F.col("b.type"), TYPED)
    return blocks.select("doc", "page", "no", kind.alias("kind"), box(F.col("b.bbox"), F.col("width"), F.col("height")).alias("box"), "b.text", "b.latex", "b.html", kind.isNull().alias("dropped"))


def tree_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same from a tree of blocks: groups give their children."""
    rows = spark.read.schema(_TREE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pages = rows.select("doc", F.explode("pages").alias("p"))
    own = lambda b: F.array(F.struct(b["block_type"].alias("block_type"), b["bbox"].alias("bbox"), b["html"].alias("html")))
    flat = F.flatten(F.transform("p.blocks", lambda b: F.when(b["block_type"].isin(*GROUPS), F.coalesce(b["children"], own(b))).otherwise(own(b))))
    blocks = pages.select("doc", "p.page", F.posexplode(flat).alias("no", "b"))
    kind = kind_of(F.col("b.block_type"), TREE)
    return blocks.select("doc", "page", "no", kind.alias("kind"), box(F.col("b.bbox")).alias("box"), plain(F.col("b.html")).alias("text"), F.lit(None).cast("string").alias("latex"), "b.html", kind.isNull().alias("dropped"))


def plain(html):
    """Text of a block: formulas in dollars, breaks as spaces, no tags."""
    from lexiforge.functions.text import strip_tags

    return strip_tags(F.regexp_replace(F.regexp_replace(html, r"(?is)<math[^>]*>(.*?)</math>", r"\$$1\$"), r"(?i)<br\s*/?>", " "))


def markdown_plain(text):
    """Text without emphasis marks and tags; spaces around inline formulas' contents go."""
    t = F.regexp_replace(F.regexp_replace(text, r"\*{1,3}([^*]+)\*{1,3}", "$1"), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\$\s+([^$]*?)\s+\$", r"\$$1\$"), r"\s+", " "))


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same from plain text files: a line is a block."""
    rows = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.posexplode(F.split("value", "\n")).alias("no", "text"))
    none = F.lit(None).cast("string")
    return rows.select("doc", F.lit(1).alias("page"), "no", F.lit("text").alias("kind"), box(F.array(*[F.lit(0.0)] * 4)).alias("box"), "text", none.alias("latex"), none.alias("html"), F.lit(False).alias("dropped"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The same from pages of HTML: headings, paragraphs, list items and tables in their order."""
    from lexiforge.functions.text import strip_tags

    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<(?:h[1-6]|p|li|table|nav)\b[^>]*>.*?</(?:h[1-6]|p|li|table|nav)>)"), F.lit(1))
    rows = pages.select(F.col(id_col).cast("string").alias("doc"), F.posexplode(found).alias("no", "html"))
    tag = F.lower(F.regexp_extract("html", r"^<(\w+)", 1))
    kind = F.when(tag.rlike("^h"), "heading").when(tag == "table", "table").when(tag == "li", "list").when(tag == "nav", None).otherwise("text")
    return rows.select("doc", F.lit(1).alias("page"), "no", kind.alias("kind"), box(F.array(*[F.lit(0.0)] * 4)).alias("box"), strip_tags(F.col("html")).alias("text"), F.lit(None).cast("string").alias("latex"), "html", kind.isNull().alias("dropped"))


def attach_latex(blocks: DataFrame, recognised: DataFrame, least: float = 0.3) -> DataFrame:
    """Equation blocks with the LaTeX of the recognised(doc, page, box, latex) equation that overlaps them most; each is used once.

    Pairs are made within a page only. The best pair of a block and of an equation wins, so a block whose best
    equation goes to another block stays without.
    """
    from pyspark.sql import Window

    from lexiforge.functions.mathtext import overlap_ratio

    pairs = blocks.where("kind = 'equation'").select("doc", "page", "no", "box").join(recognised.select("doc", "page", F.col("box").alias("other"), F.col("latex").alias("found")), ["doc", "page"])
    pairs = pairs.withColumn("ratio", overlap_ratio(F.col("box"), F.col("other"))).where(F.col("ratio") >= least)
    mine = F.row_number().over(Window.partitionBy("doc", "page", "no").orderBy(F.desc("ratio"), "other"))
    theirs = F.row_number().over(Window.partitionBy("doc", "page", "other").orderBy(F.desc("ratio"), "no"))
    best = pairs.withColumns({"mine": mine, "theirs": theirs}).where("mine = 1 AND theirs = 1").select("doc", "page", "no", "found")
    return blocks.join(best, ["doc", "page", "no"], "left").withColumn("latex", F.coalesce("found", "latex")).drop("found")


#: Parsers by name; all return the same columns.
PARSERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"typed": typed_blocks, "tree": tree_blocks, "text": text_blocks, "html": lambda spark, path: html_blocks(spark.read.parquet(path))}
