"""Mathematical characters, lines and blocks, and geometry of boxes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mathematical alphanumerics, Greek, super- and subscripts, operators, and Unicode's symbols of mathematics.
MATH_CLASS = r"[\x{1D400}-\x{1D7FF}\x{0370}-\x{03FF}⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎=+\-−×÷±∓∑∏∫∂∇√∞≈≠≤≥∈∉⊂⊆∪∩∀∃→←↔⇒⇔′″‖·∘⊗⊕^_|<>*/\p{Sm}]"
THRESHOLD = 0.25
EQUATION_NUMBER = r"\((\d{1,3}[a-z]?)\)\s*$"
#: EQUATION_NUMBER of a line, whose end is its last character, with no separator of another kind behind it.
NUMBER_AT_END = r"\(\d{1,3}[a-z]?\)[ \t\n\f\r]*\z"


def math_density(raw: Column) -> Column:
    """Mathematical characters for each other letter."""
    without = F.regexp_replace(raw, MATH_CLASS, "")
    return (F.length(raw) - F.length(without)) / F.greatest(F.lit(1), F.length(F.regexp_replace(without, r"[^\p{L}]", "")))


def real_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b[A-Za-z]{3,}\b"))


def ascii_words(text: Column) -> Column:
    """real_words of lines: letters and digits beyond ASCII bound a word as blanks do, whatever the Java version takes for a boundary."""
    return F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z]{3,}(?![A-Za-z0-9_])"))


def is_equation(text: Column, raw: Column) -> Column:
    """A block that is an equation or what is left of one."""
    words = real_words(text)
    marks = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    single = F.size(F.filter(marks, lambda t: F.length(t) == 1))
    return (
        (math_density(raw) > THRESHOLD)
        | ((words <= 1) & (F.length(text) <= 60) & text.rlike(r"[=+\-−()\d^_βαγδσμλθ]"))
        | ((words == 0) & (F.length(F.trim(text)) <= 15))
        | ((F.size(marks) >= 6) & (2 * single > F.size(marks)))
        | (text.rlike(EQUATION_NUMBER) & (words <= 3) & (F.length(text) < 80))
    )


def is_math_line(text: Column, raw: Column) -> Column:
    words = ascii_words(text)
    return (math_density(raw) > THRESHOLD) | (text.rlike(NUMBER_AT_END) & (words <= 3)) | ((words <= 1) & text.rlike(r"[=+\-−^_βαγδσμλθ∑∫]|\(\d"))


def equation_placeholder(numbers: Column) -> Column:
    """[equation omitted], with its number, or the first and last of a run."""
    first, last = F.get(numbers, 0), F.element_at(numbers, -1)
    return F.when(F.size(numbers) == 0, "[equation omitted]").when(F.size(numbers) == 1, F.concat(F.lit("[equation ("), first, F.lit(") omitted]"))).otherwise(F.concat(F.lit("[equations ("), first, F.lit(")-("), last, F.lit(") omitted]")))


def centre_in(box: Column, area: Column, slack: float = 0.0) -> Column:
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return x.between(area["x0"] - slack, area["x1"] + slack) & y.between(area["y0"] - slack, area["y1"] + slack)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, w * h / smaller).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def union_box(boxes: Column) -> Column:
    pick = lambda f, k: f(F.transform(boxes, lambda b: b[k])).alias(k)
    return F.struct(pick(F.array_min, "x0"), pick(F.array_min, "y0"), pick(F.array_max, "x1"), pick(F.array_max, "y1"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Price of a call; prices are for a million tokens, in and out."""
    def price(i: int) -> Column:
        table = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(v[i]))]) if prices else None
        return F.coalesce(F.element_at(table, model), F.lit(default[i])) if prices else F.lit(default[i])

    return (tokens_in * price(0) + tokens_out * price(1)) / 1e6


def unit(vector: Column) -> Column:
    """A vector scaled to length 1, as float."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vector)
