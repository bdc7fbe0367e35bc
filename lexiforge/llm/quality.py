"""Quality rules with thresholds learned per language and source.

Counts are taken from each whole text, inside its row. Ratios of the rows that pass the base rules go into
log-bucket quantile sketches (each bucket spans a fixed ratio, so a quantile is off by a bounded relative
error, and sketches merge by adding counts). Thresholds are read from the sketch of a row's language and
source, or from the merged sketch of its language or of everything where that one has too few rows, and
joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import SPACE, free_name, stored, text_of

#: Rows in which these fail go whatever the sketches say.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A row fails where its ratio leaves the median by more than max(slack, spread * distance of the quartile)."""

    name: str
    ratio: str  # SQL over the counts, a whole number
    slack: int
    spread: int = 3
    lower: bool = False


RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(word_chars, 1)", 50),
    Rule("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 400),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", 350),
    Rule("long_words", "100 * word_chars div greatest(n_words, 1)", 300),
    Rule("short_words", "100 * word_chars div greatest(n_words, 1)", 200, lower=True),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it within its own lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. Only where their distinct number falls short are they sorted with
    their positions; covered words are then the union of the intervals [p, p + 3).
    """
    last = F.size(words) - 3
    windows = F.when(last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<long>"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            near = lambda i: F.get(s, i)["h"]
            hit = F.transform(s, lambda x, i: F.when((x["h"] == near(i + 1)) | ((i > 0) & (x["h"] == near(F.greatest(i - 1, F.lit(0))))), x["p"]))
            at = F.sort_array(F.filter(hit, lambda p: p.isNotNull()))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, twice)).otherwise(F.lit(0))

    return let(windows, covered)


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long)."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeats")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    w, x = free_name(df, "_words"), free_name(df, "_lines")
    keep = [c for c in df.columns if c.lower() not in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    found = df.select(
        *keep,
        from_words.alias(w),
        from_lines.alias(x),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return found.select(*keep, F.col(w)["n"].alias("n_words"), "word_chars", "n_symbols", F.col(x)["n"].alias("n_lines"), F.col(x)["dup"].alias("n_dup_lines"), F.col(w)["repeats"].alias("n_repeat_words"))


def with_base(df: DataFrame) -> DataFrame:
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def sketches(df: DataFrame, groups: list[str], rules: tuple[Rule, ...], gamma: float) -> DataFrame:
    """(groups, rule, bucket, n): a log-bucket sketch of each rule's ratio; adding n merges sketches."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.ratio).alias("x")) for r in rules]))
    rows = df.where("NOT base_failed").select(*groups, ratios.alias("r")).select(*groups, "r.rule", F.when(F.col("r.x") < 1, -1).otherwise(F.ceil(F.log(F.col("r.x")) / F.log(F.lit(gamma)))).alias("bucket"))
    return rows.groupBy(*groups, "rule", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str], gamma: float) -> DataFrame:
    """(groups, rule, rows, q1, q2, q3): read off a sketch; a quartile is the middle of its bucket."""
    value = lambda b: F.when(b < 0, 0.0).otherwise(F.lit(2.0) / (1 + gamma) * F.pow(F.lit(gamma), b))
    merged = sketch.groupBy(*groups, "rule", "bucket").agg(F.sum("n").alias("n"))
    each = merged.groupBy(*groups, "rule").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))  # as many cells as the ratio has buckets, a bound that no group's rows change
    start = F.struct(F.lit(0).cast("long").alias("upto"), *[F.lit(None).cast("long").alias(f"q{k}") for k in (1, 2, 3)])

    def step(a: Column, x: Column) -> Column:
        upto = a["upto"] + x["n"]
        return F.struct(upto.alias("upto"), *[F.coalesce(a[f"q{k}"], F.when(4 * upto >= k * F.col("rows"), x["bucket"].cast("long"))).alias(f"q{k}") for k in (1, 2, 3)])

    found = each.withColumn("q", F.aggregate("cells", start, step))
    return found.select(*groups, "rule", "rows", *[value(F.col("q")[f"q{k}"]).alias(f"q{k}") for k in (1, 2, 3)])


def limits(found: DataFrame, groups: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(groups, rows, limits): the limit of each rule as a map, a whole number."""
    cases = F.lit(None).cast("double")
    for r in rules:
        off = F.greatest(F.lit(float(r.slack)), r.spread * ((F.col("q2") - F.col("q1")) if r.lower else (F.col("q3") - F.col("q2"))))
        cases = F.when(F.col("rule") == r.name, (F.col("q2") - off) if r.lower else (F.col("q2") + off)).otherwise(cases)
    flat = found.withColumn("limit", F.floor(cases))
    picks = [F.max(F.when(F.col("rule") == r.name, F.col("limit"))).alias(r.name) for r in rules]
    return flat.groupBy(*groups).agg(F.max("rows").alias("rows"), F.struct(*picks).alias("limits")) if groups else flat.agg(F.max("rows").alias("rows"), F.struct(*picks).alias("limits"))


def judge(df: DataFrame, lang_col: str = "lang", source_col: str = "source", rules: tuple[Rule, ...] = RULES, gamma: float = 1.02, min_rows: int = 100) -> DataFrame:
    """df, which has counts() and base_failed, with kept.

    Null languages and sources are groups of their own. A group with fewer than min_rows rows that pass the
    base rules takes the limits of its language, and that one those of all rows.
    """
    own_lang, own_source, own_limits = (free_name(df, x) for x in ("group_lang", "group_source", "group_limits"))
    fine = stored(sketches(df.select(F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), *[c for c in df.columns if c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")]), ["_lang", "_source"], rules, gamma), "sketch")
    both = limits(quartiles(fine, ["_lang", "_source"], gamma), ["_lang", "_source"], rules)
    lang = limits(quartiles(fine, ["_lang"], gamma), ["_lang"], rules).select(F.col("_lang").alias("_l2"), F.col("rows").alias("_n2"), F.col("limits").alias("_x2"))
    all_ = limits(quartiles(fine.withColumn("_all", F.lit(0)), ["_all"], gamma), [], rules).select(F.col("limits").alias("_x3"))
    table = both.join(lang, F.col("_lang").eqNullSafe(F.col("_l2"))).crossJoin(F.broadcast(all_))  # the right side is one row
    chosen = F.when(F.col("rows") >= min_rows, F.col("limits")).when(F.col("_n2") >= min_rows, F.col("_x2")).otherwise(F.col("_x3"))
    table = table.select(F.col("_lang").alias(own_lang), F.col("_source").alias(own_source), chosen.alias(own_limits))
    joined = df.join(table, F.col(lang_col).eqNullSafe(F.col(own_lang)) & F.col(source_col).eqNullSafe(F.col(own_source)), "left")
    fine_ = F.lit(True)
    for r in rules:
        ratio, bound = F.expr(r.ratio), F.col(own_limits)[r.name]
        fine_ = fine_ & F.coalesce((ratio >= bound) if r.lower else (ratio <= bound), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine_).drop(own_lang, own_source, own_limits)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """id_col, the counts, base_failed and kept for each row of df, repeated rows as often as they come.

    A null or empty text has no words and fails. An empty table gives no rows. The counts are stored once, so
    texts are read and counted in a single pass.
    """
    rows = df.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    found = stored(with_base(counts(rows)).drop("text"), "quality")
    return judge(found, **options).drop("lang", "source")


def drop_low_quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of df that pass, with all their columns."""
    taken = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    if taken & {c.lower() for c in df.columns}:
        renamed = {c: free_name(df, f"own_{c}") for c in df.columns if c.lower() in taken}
        found = drop_low_quality(df.withColumnsRenamed(renamed), text_col, lang_col, source_col, **options)
        return found.withColumnsRenamed({b: a for a, b in renamed.items()})
    found = judge(stored(with_base(counts(df, text_col)), "counted"), lang_col, source_col, **options)
    return found.where("kept").select(*df.columns)
