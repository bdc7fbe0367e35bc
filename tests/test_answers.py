from pyspark.sql import functions as F

from lexiforge.operators import answers, uploads

ASKED = "qid long, question string, type string, gold string, context string, collections array<string>, n_passages int, must_include array<string>, no_metric boolean"


def asked(spark):
    return spark.createDataFrame(
        [(1, "Which gate?", "factoid", "A lattice gate", "[1] a lattice gate", ["user"], 1, ["lattice"], False), (2, "Which moon?", "unanswerable", "", "[1] nothing", None, 1, [], False)],
        ASKED,
    )


def test_scope_is_said_of_uploads_only(spark):
    rows = spark.createDataFrame([(["core"],), (["user"],), (["user", "core"],), ([],), (None,)], "c array<string>")
    said = [r.n for r in rows.select(answers.scope_note(F.col("c")).alias("n")).collect()]
    assert said == [None, answers.SCOPE["user",], answers.SCOPE["core", "user"], None, None]


def test_dry_run_passes(spark):
    rows = {r.qid: r for r in answers.run(asked(spark), {"dry": (1.0, 2.0)}).collect()}
    assert rows[1].text == "A lattice gate [1]" and rows[1].cited == [1] and rows[1].auto_pass and rows[1].correctness == 2
    assert rows[2].refused and rows[2].auto_pass and rows[2].message.startswith("Passages:")
    assert rows[1].cost == (4500 + 2 * 350) / 1e6


def test_unreadable_verdict_is_an_error_not_a_score(spark):
    broken = lambda df: answers.dry_verdicts(df).withColumn("verdict", F.lit("I think it is fine"))
    row = answers.run(asked(spark), {}, judge=broken).first()
    assert row.correctness is None and row.error.startswith("unparseable") and row.text
    assert answers.run(asked(spark), {}, judge=None).first().correctness is None


def test_uploads_fall_back(spark):
    kind = "filename string, meta_title string, meta_author string, created string, spans array<struct<text: string, size: double, y: double>>, height double"
    rows = [
        ("a/My_paper.v2.pdf", None, None, None, None, 100.0),
        ("b.pdf", "Microsoft Word - b", "Ann Lee & Bo  and Cy, ;", "D:2019", [("Grand  things", 18.0, 5.0), ("small", 9.0, 9.0), ("of old", 18.04, 12.0), ("HUGE FOOTER", 30.0, 80.0)], 100.0),
        ("c.pdf", "  A plain   title ", "andover", "20190101", [], 100.0),
        (None, "", "", "", [("Short", 20.0, 1.0)], 100.0),
    ]
    found = uploads.described(spark.createDataFrame(rows, kind), F.lit("2023-01-01").cast("timestamp")).collect()
    assert [r.title for r in found] == ["My paper.v2", "Grand things of old", "A plain title", "Uploaded document"]
    assert [r.authors for r in found] == [["Unknown author"], ["Ann Lee", "Bo", "Cy"], ["andover"], ["Unknown author"]]
    assert [r.year for r in found] == [2023, 2019, 2023, 2023]
