import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import mathtext, text, udfs
from lexiforge.operators.chunking import Tokens, Unit, overlap_tail, pack_units, split_table, units
from lexiforge.operators.hyphens import join_lines


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_sentences_keep_abbreviations(spark):
    found = one(spark, text.sentences(F.col("t")), t="Li et al. (2018) fit it. See Fig. 3 now. Eq. (2) holds. Next.")
    assert found == ["Li et al. (2018) fit it.", "See Fig. 3 now.", "Eq. (2) holds.", "Next."]


@pytest.mark.parametrize(("q", "want"), [("Which papers use the ARDL(4,4,1) model?", '"use" OR "ardl" OR "4" OR "1" OR "model"'), ("the of which", "")])
def test_match_expression(spark, q, want):
    assert one(spark, text.match_expression(F.col("t")), t=q) == want


def test_caps(spark):
    cap = lambda q, n, mode: one(spark, text.per_paper_cap(F.col("q"), F.lit(n), 6, mode), q=q)
    assert [cap("Which papers use GARCH?", 0, "adaptive"), cap("What is the MAPE?", 0, "adaptive"), cap("What did p12 find?", 1, "fixed"), cap("Compare the models", 0, "adaptive"), cap("What is it?", 0, "fixed")] == [2, 6, 6, 2, 3]


@pytest.mark.parametrize(
    ("heading", "label"),
    [("1. Introduction", "introduction"), ("Numerical Results", "results"), ("A B S T R A C T", "abstract"), ("Availability of data and materials", "backmatter"), ("IV. MODEL", "methodology"), ("update", "other")],
)
def test_section_label(spark, heading, label):
    assert one(spark, text.section_label(F.col("h")), h=heading) == label


def test_heading_rules(spark):
    rows = [("2.1 Euler method", 10.0, True, 1), ("Funding: This research", 10.0, True, 1), ("Table 3 Results", 12.0, True, 1), ("Method Used for the", 12.0, True, 1), ("II. DISCRETE TIME LOGISTIC MODEL", 10.0, False, 1), ("plain words here", 10.0, False, 1), ("The Heston Model", 12.0, False, 1), ("31 October 2022", 12.0, True, 1)]
    frame = spark.createDataFrame(rows, "t string, size double, bold boolean, lines int")
    found = [r[0] for r in frame.select(text.is_heading(F.col("t"), F.col("size"), F.col("bold"), F.col("lines"), F.lit(10.0), F.lit("text"))).collect()]
    assert found == [True, False, False, False, True, False, True, False]


def test_heading_numbers_of_any_length(spark):
    numbers = ["1", "20", "20.99", "020", "0", "21", "21.1", "99.1", "100", "0021", "2147483648", "4355709550244650", "9" * 400, "0" * 30 + "7"]
    frame = spark.createDataFrame([(f"{n} Euler method",) for n in numbers], "t string").repartition(1)
    found = {r[0]: r[1] for r in frame.select("t", text.is_heading(F.col("t"), F.lit(10.0), F.lit(True), F.lit(1), F.lit(10.0), F.lit("text"))).collect()}
    assert found == {f"{n} Euler method": int(n.split(".")[0]) <= 20 for n in numbers}


def test_boilerplate(spark):
    lines = ["Downloaded from https://onlinelibrary.wiley.com", "ISSN: 2146-4553", "E-mail: a@b.c", "doi: 10.1/x", "the model is fitted", "Volume of trade rose"]
    frame = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r[0] for r in frame.select(text.is_boilerplate(F.col("t"))).collect()] == [True, True, True, True, False, False]


def test_math_density(spark):
    assert one(spark, mathtext.math_density(F.col("t")), t="dS/dt = βS + αS²") > 0.25
    assert one(spark, mathtext.math_density(F.col("t")), t="A plain sentence about stocks.") < 0.05


def test_snippet(spark):
    s = one(spark, text.snippet(F.col("t")), t="word " * 200)
    assert len(s) <= 300 and s.endswith("…") and s[-2] != " "


def test_citations():
    assert udfs.markers("Rain fell [3] [7]; snow [1; 3, 8] later [0].", 5) == ("Rain fell [3]; snow [1][3] later.", [3, 1], [7, 8, 0])


def test_latex():
    assert udfs.tidy_latex(r"\begin{aligned} { y _ { k } = \mathbf { A } x _ { k } + \omega b ( k ) , } \end{aligned} \tag { 7a }") == r"y_k = Ax_k+\omega b(k)  (7a)"
    assert udfs.tidy_latex(r"\left ( u ^ { 2 } \right ) \leq v , \quad (12)") == r"(u^2)\leq v  (12)"
    assert udfs.tidy_latex(r"\mathrm { \mathbf { q } } _ { i j } ~ \in \text { Z }") == r"q_{ij}\in Z"
    assert udfs.tidy_latex("{ { a } + { b } }") == "{a}+{b}" and udfs.tidy_latex("{ { a b } } .") == "ab" and udfs.tidy_latex("} x {") == "}x{"


def test_tables():
    assert udfs.html_rows('<TABLE><tr><th colspan="3">Rain &amp; snow<td>x<br>y</tr><tr></tr><tr><td></td></tr><tr><td><b>4</b> mm</td></table><p>no</p>') == [["Rain & snow", "", "", "x y"], ["4 mm"]]
    assert udfs.html_rows("<td>loose</td>") == [["loose"]] and udfs.html_rows("") == []
    assert udfs.pipe_rows("a | &gt;3\n:--|--:\nplain\n| 1 | 2 |") == [["a", ">3"], ["1", "2"]]


def test_indel_ratio():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 200.0 * table[-1][-1] / (len(a) + len(b))

    for a, b in (("kitten", "sitting"), ("abc", "abc"), ("abc", "xyz"), ("a line of text", "a lines of texts")):
        assert abs(udfs.indel_ratio(a, b) - slow(a, b)) < 1e-9
    assert difflib.SequenceMatcher(None, "abc", "abc").ratio() * 100 == udfs.indel_ratio("abc", "abc")


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("forecasting", "forecast"), ("adjustable", "adjust"), ("generalizations", "gener"), ("controlling", "control"), ("probate", "probat"), ("rate", "rate"), ("agreed", "agre"), ("replacement", "replac")])
def test_stems(word, stem):
    assert udfs.stem_word(word) == stem


def test_hyphens():
    assert join_lines(["fore-", "casting"]) == "forecasting"
    assert join_lines(["a second-order model; second-", "order"]) == "a second-order model; second-order"


def plain_packing(all_, budget):
    """The rule, unit by unit."""
    out, now, total = [], [], 0
    for u in all_:
        if now and (total + u.tokens > budget or total >= int(0.7 * budget)):
            out.append(now)
            tail = overlap_tail(now[-1].text)
            n = len(re.findall(r"\w+|[^\w\s]", tail))
            now = [Unit(tail, now[-1].page, n)] if tail and n + u.tokens <= budget else []
            total = sum(x.tokens for x in now)
        now.append(u)
        total += u.tokens
    return out + [now] if now else out


def test_packing():
    rng = random.Random(2)
    for _ in range(500):
        all_ = []
        for page in range(rng.randint(0, 12)):
            text = " ".join(" ".join(["Word", *["w"] * rng.randint(0, 30)]) + "." for _ in range(rng.randint(1, 4)))
            all_ += units(text, page, 90)
        for budget in (90, 100, 137):
            assert pack_units(all_, budget) == plain_packing(all_, budget)
    assert overlap_tail("Rain fell. Snow too. It froze.", 3) == "It froze." and overlap_tail("Rain fell. Snow too.", 2) == ""


def test_units_fall_back():
    assert [u.text for u in units("  short one  ", 1, 9)] == ["short one"] and units(" \n ", 1, 9) == []
    assert [u.text for u in units("One two three. Four five six seven eight nine.", 2, 5)] == ["One two three.", "Four five six seven eight", "nine."]


def test_chunks_by_a_tokenizers_file(tmp_path):
    """A tokenizer made here, of words; its tokens decide, not words and punctuation."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.enable_truncation(2)
    made.save(str(tmp_path / "t.json"))
    by = Tokens(str(tmp_path / "t.json"))
    assert by.count("a,b c-d e.") == 3 and by.cut("a,b c-d e.", 2) == ["a,b c-d", "e."] and Tokens().count("a,b c-d e.") == 8


def test_table_split():
    parts = split_table("Table 4: Rain by day", [["day", "mm"]] + [[f"d{i}", str(i % 17)] for i in range(300)], 200)
    assert all(p.startswith("Table 4: Rain by day (part ") and "| day | mm |" in p for p in parts) and len(parts) > 1


def test_table_split_keeps_all_tokens():
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    long_first = [[words("h", 700)], [words("a", 30)], [words("b", 30)]]
    long_row = [["x", "y"], [words("r", 1300)], ["last", "row"]]
    for caption, rows in (("T", [[words("h", 700)]]), ("T", long_first), ("T", long_row), ("T", [["h"]]), (words("c", 600), long_first), (words("c", 600), [])):
        parts = split_table(caption, rows, 450)
        text = "\n".join(parts).split()
        assert all(len(re.findall(r"\w+|[^\w\s]", p)) <= 450 for p in parts)
        assert {w for r in [[caption], *rows] for c in r for w in c.split()} <= set(text)
    assert all("| x | y |" in p for p in split_table("T", long_row, 450))


def test_overlap(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    frame = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (2.0, 2.0, 4.0, 4.0)), ((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0))], f"a {box}, b {box}")
    assert [r[0] for r in frame.select(mathtext.overlap_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
