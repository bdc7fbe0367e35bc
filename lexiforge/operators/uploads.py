"""What an uploaded document is called, by whom and of when, from its properties and its first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles that programs leave behind, what stands between authors, names where none are known, and limits.
NO_TITLE = r"(?i)^(microsoft word|untitled|\S+\.(docx?|pdf|tex))"
BETWEEN_AUTHORS = r";|,|\band\b|&"
UNTITLED, UNKNOWN_AUTHOR = "Uploaded document", "Unknown author"
LEAST_TITLE, MOST_TITLE, MOST_AUTHORS = 8, 200, 10


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def largest_text(spans: Column, height: Column) -> Column:
    """The text of array<struct<text, size, y>> in the largest size of a page's upper half, joined by blanks; null where there is none."""
    rounded = F.transform(spans, lambda s: F.struct(F.round(s["size"], 1).alias("size"), F.trim(s["text"]).alias("text"), s["y"].alias("y")))
    upper = F.filter(rounded, lambda s: (s["text"] != "") & (s["y"] < height / 2))
    top = F.array_max(F.transform(upper, lambda s: s["size"]))
    words = F.transform(F.filter(upper, lambda s: s["size"] == top), lambda s: s["text"])
    return F.when(F.size(upper) > 0, F.array_join(words, " "))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")


def title_of(meta: Column, largest: Column, name: Column) -> Column:
    """The stated title if it is one, else the largest text, else the file's name; null properties count as empty."""
    stated = _flat(F.coalesce(meta, F.lit("")))
    stem = F.substring(F.replace(file_stem(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit(" ")), 1, MOST_TITLE)
    return (
        F.when((F.length(stated) >= LEAST_TITLE) & ~stated.rlike(NO_TITLE), F.substring(stated, 1, MOST_TITLE))
        .when(F.length(largest) >= LEAST_TITLE, F.substring(_flat(largest), 1, MOST_TITLE))
        .when(stem != "", stem)
        .otherwise(UNTITLED)
    )


def authors_of(meta: Column) -> Column:
    names = F.filter(F.transform(F.split(F.coalesce(meta, F.lit("")), BETWEEN_AUTHORS), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(F.size(names) > 0, F.slice(names, 1, MOST_AUTHORS)).otherwise(F.array(F.lit(UNKNOWN_AUTHOR)))


def year_of(created: Column, now: Column) -> Column:
    """The year of a date like D:2021…, else the year of now."""
    stated = F.regexp_extract(F.coalesce(created, F.lit("")), r"^D:(\d{4})", 1)
    return F.when(stated != "", stated.cast("int")).otherwise(F.year(now))


def described(uploads: DataFrame, now: Column | None = None) -> DataFrame:
    """uploads(filename, meta_title, meta_author, created, spans, height, …) with title, authors and year."""
    largest = largest_text(F.col("spans"), F.col("height"))
    return uploads.withColumns(
        {
            "title": title_of(F.col("meta_title"), largest, F.col("filename")),
            "authors": authors_of(F.col("meta_author")),
            "year": year_of(F.col("created"), F.current_timestamp() if now is None else now),
        }
    )
