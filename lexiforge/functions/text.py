"""Text as Column expressions: everything here runs in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search query drops.
STOP_WORDS = (
    "a an and are as at be by did do does for from how in is it of on or that the their them these this those to "
    "was were what when where which who why with paper papers study studies corpus"
).split()
#: Questions that ask for breadth over many papers.
BREADTH = (
    r"(?i)\b((which|what)\s+(papers|studies|articles|works)|papers|across\s+(the\s+)?(corpus|collection|papers|studies)"
    r"|compar\w*|(each|every|all)\s+(paper|stud)\w*|corpus|collection|consensus|show up)\b"
)
#: Lines that publishers print on every page.
BOILERPLATE = (
    r"Downloaded from https://onlinelibrary\.wiley\.com",
    r"Electronic copy available at: ?https://ssrn\.com",
    r"Volume \d+, Issue \d+, .*Pages \d+-\d+",
    r"^IAENG International Journal of",
    r"^\s*\d{2} \w+ \d{4} \d{2}:\d{2}:\d{2}\s*$",
    r"\b030005-\d+",
    r"Permission to make digital or hard copies",
    r"^\s*a1{10}\s*$",
    r"<\s*Insert (Figure|Table) \d+\s*>",
    r"Publisher[’']s Note",
    r"Creative Commons",
    r"Copyright ©",
    r"This article is licensed under",
    r"^_{10,}\s*$",
    r"\bISSN\W{0,3}\d{4}\W?\d{3}[\dX]",
    r"open access article",
    r"Corresponding author|^\s*\*?\s*Correspondence:",
    r"^\s*E-?mail( address)?:",
    r"^\s*(doi:\s*|https?://doi\.org/)\S+\s*$",
    r"^\s*Academic Editors?:",
)
#: A block with one of these is a licence notice if it is short.
LICENCE = r"(?i)Creative Commons|creativecommons\.org|Publisher[’']s Note|jurisdictional claims|Licensee [A-Z]|open access article|This article is licensed under|Copyright ©"
LICENCE_WORDS = 120
#: Section labels and what their headings contain, in order of precedence.
LABELS = {
    "abstract": "abstract",
    "backmatter": "acknowledg|author contribution|funding|conflict|data availability|availability of data|appendix|publisher|competing interest|institutional review|informed consent|declaration|abbreviations|supporting information|authors’ information|author details|ethics|credit authorship|orcid",
    "frontmatter": "keywords|index terms|article info|jel|ccs concepts|acm reference|highlights",
    "introduction": "introduction",
    "literature_review": "literature|related work|review",
    "data": "data|sample|dataset",
    "methodology": "method|methodology|model|approach|algorithm|framework|solution|numerical",
    "results": "result|simulation|empirical|experiment|forecast|fit|analysis",
    "discussion": "discussion",
    "conclusion": "conclusion|concluding",
    "references": "references|bibliography|daftar pustaka",
}
#: Abbreviations after which no sentence ends.
ABBREVIATIONS = (r"\bet al\.", r"\bFig\.", r"\bEq\.", r"\be\.g\.", r"\bi\.e\.", r"\bvs\.", r"\bNo\.", r"\bpp\.", r"\bal\.")
SENTENCE_END = "".join(f"(?<!{a})" for a in ABBREVIATIONS) + r"(?<=[.!?])\s+(?=[A-Z0-9(\[$])"
REFUSAL = "The corpus doesn't cover this."


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def query_terms(question: Column) -> Column:
    """Distinct words of a question but the stop words, in the order of their first use. Distinct before any stemming."""
    return F.array_distinct(F.filter(tokens(question), lambda t: ~t.isin(STOP_WORDS)))


def match_expression(question: Column) -> Column:
    """The words as a quoted OR expression; empty if no word is left."""
    return F.array_join(F.transform(query_terms(question), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def is_breadth(question: Column) -> Column:
    return question.rlike(BREADTH)


def per_paper_cap(question: Column, n_named: Column, top_k: int, mode: str = "adaptive", base: int = 3) -> Column:
    """The most chunks that one paper may have among top_k."""
    other = F.when(is_breadth(question), F.lit(min(base, 2))).otherwise(F.lit(top_k)) if mode == "adaptive" else F.lit(base)
    return F.when(n_named == 1, F.lit(top_k)).otherwise(other)


def line_key(line: Column) -> Column:
    """Lower case, digit runs as #, single spaces: what makes running headers equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def is_boilerplate(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(BOILERPLATE))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_licence_block(block: Column) -> Column:
    return block.rlike(LICENCE) & (n_words(block) <= LICENCE_WORDS)


def is_page_number(line: Column, y: Column, height: Column, margin: float = 0.08) -> Column:
    return line.rlike(r"^\s*\d{1,4}\s*$") & ((y < margin * height) | (y > (1 - margin) * height))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def despace(text: Column) -> Column:
    """'A B S T R A C T' as 'ABSTRACT', in each part between wider gaps."""
    parts = F.split(F.trim(text), r"\s{2,}")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^(?:[A-Z] )+[A-Z]$"), F.replace(p, F.lit(" "), F.lit(""))).otherwise(p)), " ")


def section_label(heading: Column) -> Column:
    """The first label whose words begin a word of the heading. An explicit result(s) wins over all but back matter."""
    h = F.regexp_replace(despace(heading), r"^(\d+(\.\d+)*\.?|[IVX]+\.)\s*", "")
    hits = {label: h.rlike(rf"(?i)\b({words})") for label, words in LABELS.items()}
    first = F.when(h.rlike(r"(?i)\bresults?\b") & ~hits["backmatter"], F.lit("results"))
    return reduce(lambda c, x: c.when(x[1], F.lit(x[0])), hits.items(), first).otherwise(F.lit("other"))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


#: Headings that stand alone whatever their style, and words that begin unnumbered headings.
STRUCTURAL = r"(?i)^(abstract|article info|keywords|references|bibliography|acknowledge?ments?|data availability( statement)?|conflicts? of interest|funding)\s*:?$"
KNOWN_START = (
    r"(?i)^(abstract|introduction|background|literature|related work|data|methods?|methodology|materials|model|results?|discussion|conclusions?|concluding|references|bibliography|"
    r"acknowledg|appendix|funding|author contributions?|conflicts? of interest|data availability|availability of data|competing interests|declarations?|keywords|abbreviations|empirical|findings|summary|limitations)\b"
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
#: A number whose first part is above 20, of however many digits.
ABOVE_20 = r"^0*(2[1-9]|[3-9]\d|[1-9]\d{2,})(\.|$)"
NUMBERED, ROMAN = r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]", r"^([IVX]+)\.\s+\S"
CAPTION = r"^\s*(Table|TABLE|Fig\.?|Figure|FIGURE)\s*[\dIVX]+"


def heading_level(heading: Column, bold: Column) -> Column:
    """Depth of the number; 1 for Roman, bold, capital or structural headings; else 2."""
    number = F.regexp_extract(heading, NUMBERED, 1)
    top = heading.rlike(ROMAN) | bold | is_upper(heading) | heading.rlike(STRUCTURAL)
    return F.when(number != "", F.size(F.split(number, r"\.")) ).when(top, F.lit(1)).otherwise(F.lit(2)).cast("int")


def is_heading(text: Column, size: Column, bold: Column, lines: Column, body_size: Column, kind: Column) -> Column:
    """Whether a block of text is a heading, from its words and its style."""
    t = despace(F.regexp_replace(F.trim(text), r"\s+", " "))
    words = n_words(text)
    number = F.regexp_extract(t, NUMBERED, 1)
    numbered, roman = number != "", t.rlike(ROMAN)
    caps = is_upper(F.regexp_replace(t, r"[^\p{L}]", "")) & t.rlike("[A-Z]{4,}")
    never = (
        (kind != "text") | t.rlike(r"^[^:]{2,40}:\s+\S") | (t == "") | (words > 12) | (lines > 3) | t.rlike(CAPTION) | t.rlike("[,;]$")
        | t.rlike(r"(?i)\b(the|of|for|and|in|to|a|an|with|on|by)$")
        | (numbered & (number.rlike(ABOVE_20) | t.rlike(rf"^\d+(?:\.\d+)*\.?\s+({MONTHS})\b")))
    )
    styled = (size >= 1.1 * body_size) | bold
    prominent = (lines == 1) & (size >= 1.15 * body_size) & words.between(1, 8) & t.rlike(r"^\p{Lu}") & ~t.rlike(r"\.$") & t.rlike("[A-Za-z]{3,}")
    yes = t.rlike(STRUCTURAL) | (roman & caps) | (styled & (numbered | roman | caps | (t.rlike(KNOWN_START) & (words <= 6)) | prominent))
    return ~never & yes


def eval_norm(text: Column) -> Column:
    """For comparing answers: lower case, one kind of dash and space, no thousands separators."""
    t = F.translate(F.lower(text), "−– ", "-- ")
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\d),(?=\d{3}\b)", ""), r"\s+", " ")


def parser_norm(text: Column) -> Column:
    """For comparing parsers: as eval_norm, but every comma goes."""
    return F.regexp_replace(F.translate(F.lower(text), "−– ,", "-- "), r"\s+", " ")


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]*\[\d{1,2}(?:\s*[,;]\s*\d{1,2})*\]", "")


def snippet(text: Column, limit: int = 300) -> Column:
    """At most limit characters, cut before a word, with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), r"\s\S*$", ""), F.lit("…")))


def strip_tags(html: Column) -> Column:
    """Plain text of simple markup: tags go, the commonest entities are decoded, spaces collapse."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def context_header(cite: Column, title: Column, heading: Column) -> Column:
    return F.concat(cite, F.lit(" — "), title, F.lit(" > "), heading, F.lit("\n\n"))


def short_cite(authors: Column, year: Column, title: Column) -> Column:
    """Surname, et al. for several authors, and year; without authors the title, shortened."""
    surname = F.element_at(F.split(F.trim(F.get(authors, 0)), r"\s+"), -1)
    named = F.concat(surname, F.when(F.size(authors) > 1, " et al.").otherwise(""), F.coalesce(F.concat(F.lit(" "), year.cast("string")), F.lit("")))
    return F.when(F.size(authors) > 0, named).otherwise(snippet(title, 40))


def transcript(turns: Column, last: int = 6, chars: int = 600) -> Column:
    """The last turns of array<struct<role, text>> as lines, markers stripped, each cut to chars."""
    recent = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), F.lit(last))
    return F.array_join(F.transform(recent, lambda t: F.concat(t["role"], F.lit(": "), F.substring(strip_markers(t["text"]), 1, chars))), "\n")


def rewrite_line(reply: Column) -> Column:
    """The query of a line SEARCH: …, or null (a line SAME, or neither)."""
    found = F.regexp_extract(reply, r"(?im)^\s*SEARCH:\s*(\S.*?)\s*$", 1)
    return F.when(found != "", found)


def wants_same(reply: Column) -> Column:
    return reply.rlike(r"(?im)^\s*SAME\s*$") & rewrite_line(reply).isNull()
