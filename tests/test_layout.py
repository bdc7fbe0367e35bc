from pyspark.sql import functions as F

from lexiforge.operators import chat, layout

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_sidebar_goes(spark):
    rows = [("d", 1, 0, (20.0, 50.0, 150.0, 90.0), "Received: 1 May", 2), ("d", 1, 1, (166.0, 50.0, 580.0, 200.0), "body " * 30, 8), ("d", 1, 2, (166.0, 210.0, 580.0, 300.0), "more " * 30, 8), ("d", 3, 3, (20.0, 50.0, 150.0, 90.0), "Received: 1 May", 2)]
    blocks = spark.createDataFrame(rows, f"doc string, page int, no int, box {BOX}, text string, lines int").withColumn("width", F.lit(600.0))
    assert sorted(r["no"] for r in layout.without_sidebars(blocks).collect()) == [1, 2, 3]


def test_table_region_and_cells(spark):
    prose = "This paragraph is running text with many long words and goes on for a while so that it is prose indeed."
    rows = [(0, (50.0, 100.0, 300.0, 110.0), "Table 1. Fits", 1), (1, (50.0, 115.0, 300.0, 125.0), "A 1 2", 1), (2, (50.0, 130.0, 300.0, 140.0), "B 3 4", 1), (3, (50.0, 150.0, 550.0, 170.0), prose, 1), (4, (50.0, 180.0, 300.0, 190.0), "C 5 6", 1)]
    blocks = spark.createDataFrame([("d", 1, n, b, t, 10.0, k) for n, b, t, k in rows], f"doc string, page int, no int, box {BOX}, text string, size double, lines int").withColumns({"heading": F.lit(False), "body_size": F.lit(10.0), "width": F.lit(600.0)})
    images = spark.createDataFrame([], f"doc string, page int, box {BOX}")
    regions = layout.table_regions(blocks, images)
    assert [(r["caption"], r["members"], r["region"]["y1"]) for r in regions.collect()] == [("Table 1. Fits", 2, 140.0)]
    words = [("d", 1, (x, y, x + 10, y + 10), t) for y, line in ((115.0, "A 1 2"), (130.0, "B 3 4")) for x, t in zip((50.0, 100.0, 150.0), line.split(), strict=True)]
    assert layout.table_cells(spark.createDataFrame(words, f"doc string, page int, box {BOX}, text string"), regions).first()["rows"] == [["A", "1", "2"], ["B", "3", "4"]]


def test_missing_cells_keep_columns():
    import pandas as pd

    words = pd.DataFrame([(0, 0, 10, 10, "a"), (50, 0, 60, 10, "b"), (100, 0, 110, 10, "c"), (100, 20, 110, 30, "9")], columns=["x0", "y0", "x1", "y1", "text"])
    assert layout.cluster_cells(words) == [["a", "b", "c"], ["", "", "9"]]


def test_plan(spark):
    rows = [(1, "MAPE?", None, [], None), (2, "shorter please", "MAPE?", [5, 3], "SAME"), (3, "and RC?", "MAPE?", [5], "SEARCH: MAPE of RC"), (4, "and?", "MAPE?", [5], "hm"), (5, "shorter", "MAPE?", [], "SAME"), (6, "x", "MAPE?", [1], None)]
    turns = spark.createDataFrame(rows, "qid int, message string, last_question string, reuse_ids array<long>, reply string")
    found = chat.plan(turns)
    assert {r["qid"]: (r["reuse"], r["search"]) for r in found.collect()} == {1: (False, "MAPE?"), 2: (True, None), 3: (False, "MAPE of RC"), 4: (False, "MAPE? and?"), 5: (False, "MAPE? shorter"), 6: (False, "MAPE? x")}
    chunks = spark.createDataFrame([(3, "c"), (5, "e")], "id long, text string")
    assert [(r["n"], r["text"]) for r in chat.reused(found, chunks).orderBy("n").collect()] == [(1, "e"), (2, "c")]
    assert chat.lost(found, chat.reused(found, chunks)).isEmpty()
    assert [r["reply"] for r in chat.rule_reply(turns).orderBy("qid").limit(2).collect()] == ["SEARCH: MAPE?", "SAME"]


def test_reports(spark):
    from lexiforge.operators import reports

    pages = spark.createDataFrame([("d", 1, "two"), ("d", 2, "two"), ("d", 3, "one")], "doc string, page int, layout string")
    assert reports.layout_votes(pages, spark.createDataFrame([("d", "one")], "doc string, layout string")).first()["agrees"] is False
    texts = spark.createDataFrame([("p", "d", "It was 1,025 – so")], "parser string, doc string, text string")
    gold = spark.createDataFrame([("d", "1025"), ("d", "nothing")], "doc string, string string")
    assert tuple(reports.gold_coverage(texts, gold).first())[1:] == (1, 2)
    blocks = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "doc string, parser string")
    assert [r["doc"] for r in reports.common_documents(blocks, ["a", "b"]).collect()] == ["d"]
    estimate = reports.cost_estimate(spark.createDataFrame([("why?",)], "question string"), 1.0, 5.0, 3500)
    assert reports.guarded(estimate, 1.0) > 0
    try:
        reports.guarded(estimate, 0.0)
        raise AssertionError
    except ValueError:
        pass


def test_captions_beside_and_above_tables(spark):
    box = "box struct<x0: double, y0: double, x1: double, y1: double>"
    tables = spark.createDataFrame([("d", 1, 0, (0.0, 100.0, 90.0, 200.0)), ("d", 2, 9, (0.0, 100.0, 90.0, 200.0))], f"doc string, page int, no int, {box}")
    blocks = [
        ("d", 1, 1, "text", "Table 3. Far above", (0.0, 10.0, 90.0, 60.0)),
        ("d", 1, 2, "text", "Table 4. Just below", (0.0, 212.0, 90.0, 220.0)),
        ("d", 1, 3, "text", "Table 5. As near above", (0.0, 80.0, 90.0, 88.0)),
        ("d", 1, 4, "text", "The table shows prose", (0.0, 201.0, 90.0, 210.0)),
        ("d", 2, 5, "heading", "Table 6. No text", (0.0, 90.0, 90.0, 99.0)),
    ]
    found = layout.nearby_captions(tables, spark.createDataFrame(blocks, f"doc string, page int, no int, kind string, text string, {box}"))
    assert {(r.no, r.caption_no) for r in found.collect()} == {(0, 2), (9, None)}


def test_layout_ties_go_by_whole_name(spark):
    from lexiforge.operators import reports

    pages = spark.createDataFrame([("d", 1, "two_b"), ("d", 2, "two_a"), ("d", 3, "two_b"), ("d", 4, "two_a")], "doc string, page int, layout string")
    stated = spark.createDataFrame([("d", "two_a")], "doc string, layout string")
    assert reports.layout_votes(pages, stated).first()["voted"] == "two_a"
