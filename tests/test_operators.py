import json
import random

from pyspark.sql import functions as F

from lexiforge.functions import udfs
from lexiforge.operators import cleaning, context, evaluate, retrieve, sections, service, state, structure
from lexiforge.sources import index, layout_json, manifest, sinks
from lexiforge.streaming import state as streaming


def test_fusion_and_choice_equal_loops(spark):
    """Batch fusion, guaranteed places, cap and top-up against plain loops."""
    rng, lexical, near, papers, want = random.Random(3), [], [], [], {}
    paper = {i: f"p{i % 4}" for i in range(20)}
    papers = list(paper.items())
    for q in range(60):
        a, b = rng.sample(range(20), rng.randint(0, 12)), rng.sample(range(20), rng.randint(0, 12))
        lexical += [(q, x, i) for i, x in enumerate(a, 1)]
        near += [(q, x, i) for i, x in enumerate(b, 1)]
        score = {}
        for one in (a, b):
            for i, x in enumerate(one, 1):
                score[x] = score.get(x, 0) + 1 / (60 + i)
        order = sorted(score, key=lambda x: -score[x])
        front = list(dict.fromkeys(b[:2] + a[:2]))
        order = front + [x for x in order if x not in front]
        taken, skipped, used = [], [], {}
        for x in order:
            if used.get(paper[x], 0) < 2:
                taken.append(x)
                used[paper[x]] = used.get(paper[x], 0) + 1
            else:
                skipped.append(x)
        want[q] = (taken + skipped)[:6] if len(taken) < 6 else taken[:6]
    frame = lambda rows: spark.createDataFrame(rows, "qid int, id int, rank int")
    fused = retrieve.fuse(frame(lexical), frame(near), guaranteed=2)
    caps = spark.range(60).select(F.col("id").cast("int").alias("qid"), F.lit(2).alias("cap"))
    found = {}
    for r in retrieve.pick(fused, spark.createDataFrame(papers, "id int, paper string"), caps).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["id"])
    assert found == {q: x for q, x in want.items() if x}


def test_named_papers(spark):
    papers = spark.createDataFrame([("p01", ["Smales"], 2014), ("p02", ["Noviantri"], 2023), ("p03", ["Li"], 2018), ("p04", ["Lyócsa"], 2020)], "paper_id string, surnames array<string>, year int")
    asked = spark.createDataFrame([(1, "What did Smales find?"), (2, "Noviantri 2021?"), (3, "Li et al. fit"), (4, "the li ion"), (5, "see p04 and Smales"), (6, "lyocsa?")], "qid int, question string")
    found = {(r[0], r[1]) for r in retrieve.named_papers(asked, papers, udfs.fold).collect()}
    assert found == {(1, "p01"), (3, "p03"), (5, "p04"), (6, "p04")}


def chunk_rows(spark):
    rows = [("p1", i, "A" if i < 4 else "B", "prose", f"text {i} see Table 2") for i in range(8)] + [("p1", 9, "Table 2. Fits", "table", "| x |"), ("p1", 10, "TABLE 3 Other", "table", "| y |")]
    return spark.createDataFrame(rows, "paper_id string, seq int, heading string, kind string, text string")


def test_neighbours_and_tables(spark):
    chunks = chunk_rows(spark)
    hits = spark.createDataFrame([(1, 1, "p1", "A", 3), (1, 2, "p1", "A", 2)], "qid int, n int, paper_id string, heading string, seq int")
    shown = context.neighbours(hits, chunks)
    assert sorted((r["n"], r["seq"]) for r in shown.collect()) == [(1, 3), (2, 1), (2, 2)]  # 4 has another heading, 2 and 3 are hits
    tables = context.referenced_tables(context.widened(shown), chunks, shown).collect()
    assert [(r["n"], r["seq"], r["number"]) for r in tables] == [(1, 9, "2")]


def test_history(spark):
    turns = [("assistant", "hi"), ("user", "MAPE?"), ("user", "of RC?"), ("assistant", "It was 5.067%."), ("assistant", "More."), ("user", "why?")]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
    found = context.history(frame).orderBy("pos").collect()
    assert [(r["role"], r["text"]) for r in found] == [("user", "MAPE?\n\nof RC?"), ("assistant", "It was 5.067%.\n\nMore.")]


def test_sections(spark):
    rows = [(0, "Journal of X", False), (1, "Abstract. " + "We study it at length and find much of note here. " * 2, False), (2, "1. Introduction", True), (3, "Some words of prose that run on.", False), (4, "1.1 Scope", True), (5, "More prose.", False), (6, "References", True), (7, "[1] A. Author. A title of it.", False)]
    blocks = spark.createDataFrame([("d", n, "text", t, t, 10.0, b, 1) for n, t, b in rows], "doc string, no int, kind string, text string, raw string, size double, bold boolean, lines int")
    found = {r["no"]: (r["section_label"], r["section_heading"]) for r in sections.assembled(sections.classified(blocks)).collect()}
    assert [found[i][0] for i in (0, 1, 3, 5, 7)] == ["frontmatter", "abstract", "introduction", "introduction", "references"]
    assert found[5][1] == "1. Introduction > 1.1 Scope"


def test_references(spark):
    lines = ["[1] A. Author. A title of some", "length, 2001.", "[2] B. Other. Fore-", "casting of it, 2002.", "[3] x"]
    frame = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string")
    assert sections.references(frame).first()["refs"] == ["A. Author. A title of some length, 2001.", "B. Other. Forecasting of it, 2002."]


def test_reading_order(spark):
    box = lambda x, y: (float(x), float(y), float(x) + 200, float(y) + 10)
    rows = [("d", 1, 0, (20.0, 10.0, 580.0, 20.0), False), ("d", 1, 1, box(320, 50), False), ("d", 1, 2, box(20, 60), False), ("d", 1, 3, box(20, 90), True), ("d", 1, 4, (20.0, 200.0, 580.0, 210.0), False), ("d", 1, 5, box(320, 220), False), ("d", 1, 6, box(20, 230), False)]
    frame = spark.createDataFrame(rows, "doc string, page int, no int, box struct<x0:double,y0:double,x1:double,y1:double>, footnote boolean").withColumns({"layout": F.lit("two_column"), "width": F.lit(600.0)})
    assert [r["no"] for r in sections.reading_order(frame).orderBy("place").collect()] == [0, 2, 1, 4, 6, 5, 3]


def test_drop_reasons(spark):
    rows = [("d", p, 0, 0, "text", "Running header", 5.0) for p in range(4)] + [("d", 0, 1, 1, "text", "7", 99.0), ("d", 0, 2, 2, "text", "Creative Commons", 50.0), ("d", 0, 2, 3, "text", "tail of it", 51.0), ("d", 0, 3, 4, "text", "prose", 60.0), ("d", 0, 4, 5, "equation", "Copyright ©", 60.0)]
    lines = spark.createDataFrame(rows, "doc string, page int, block int, line_no int, kind string, line string, y double").withColumn("height", F.lit(100.0))
    reasons = cleaning.drop_reasons(lines, cleaning.repeated_lines(lines))
    assert cleaning.dropped_counts(reasons).first()["dropped"] == {"licence": 2, "page_number": 1, "repeated": 4}
    assert sorted(r["line"] for r in reasons.where("reason IS NULL").collect()) == ["Copyright ©", "prose"]


def test_near_repeats(spark):
    t = "this is a line of text, twice\nthis is a line of text, twice.\nshort\nshort\nother words altogether"
    assert cleaning.near_repeats_removed(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()["n_kept"] == 4


def test_evidence(spark):
    gold = spark.createDataFrame([(1, ["1,025"]), (2, []), (3, ["nothing"])], "qid int, must_include array<string>")
    ctx = spark.createDataFrame([(1, "It was 1025 – so"), (3, "text")], "qid int, context string")
    assert {r[0]: r[1] for r in evaluate.evidence(ctx, gold).collect()} == {1: 1, 2: None, 3: 0}


def test_uploads(spark):
    registered = spark.createDataFrame([("u01", "a", "ready"), ("u02", "b", "failed")], "paper_id string, sha256 string, status string")
    uploads = spark.createDataFrame([("a", "x.pdf", 1), ("b", "y.pdf", 2), ("c", "z.pdf", 3), ("c", "z2.pdf", 4)], "sha256 string, filename string, uploaded_at int")
    assert sorted(r["filename"] for r in state.new_uploads(uploads, registered).collect()) == ["y.pdf", "z.pdf"]
    assert state.smallest_free_id(registered).first()[0] == "u03"
    files = spark.createDataFrame([(bytearray(b"%PDF-1"), False, 3, 500), (bytearray(b"GIF8"), False, 3, 500), (bytearray(b"%PDF-1"), True, 3, 500), (bytearray(b"%PDF-1"), False, 61, 500), (bytearray(b"%PDF-1"), False, 1, 5)], "content binary, encrypted boolean, n_pages int, letters int")
    assert [r["reason"] for r in state.admission(files).collect()] == [None, "not a PDF", "encrypted", "too many pages", "no text layer"]
    table = spark.createDataFrame([("u01", "user"), ("p01", "core")], "paper_id string, collection string")
    assert state.without_document(table, table.select("paper_id")).first()["paper_id"] == "p01"


def test_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    rows = [{"id": "p01", "file": "a.pdf", "sha256": "0" * 64, "authors": ["A B"], "year": 2001}, {"id": "p02", "file": "b.pdf", "sha256": "0" * 64, "authors": ["A B"], "year": 2001}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    table = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    found = manifest.problems(table, manifest.read_files(spark, str(tmp_path))).collect()
    assert sorted((r["id"], r["problem"]) for r in found) == [("p01", "other content"), ("p02", "missing file")]


def test_layout_json(spark, tmp_path):
    doc = {"doc": "d", "pages": [{"page": 1, "width": 100.0, "height": 200.0, "blocks": [{"type": "title", "bbox": [0.1, 0.1, 0.5, 0.2], "text": "T"}, {"type": "header", "bbox": [0, 0, 1, 1], "text": "h"}, {"type": "equation", "bbox": [0.1, 0.5, 0.5, 0.6], "text": "x"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    blocks = layout_json.typed_blocks(spark, str(tmp_path / "t.json"))
    assert [(r["kind"], r["dropped"], round(r["box"]["x1"])) for r in blocks.orderBy("no").collect()] == [("heading", False, 50), (None, True, 100), ("equation", False, 50)]
    seen = spark.createDataFrame([("d", 1, (10.0, 100.0, 50.0, 118.0), "x_n")], "doc string, page int, box struct<x0:double,y0:double,x1:double,y1:double>, latex string")
    assert layout_json.attach_latex(blocks, seen).where("kind = 'equation'").first()["latex"] == "x_n"


def test_index(spark, tmp_path):
    chunks = chunk_rows(spark).withColumns({"collection": F.lit("core"), "embed_text": F.col("text"), "content_hash": F.sha2("text", 256)})
    papers = spark.createDataFrame([("p1", "T")], "paper_id string, title string")
    numbered = index.numbered(chunks).cache()
    vectors = numbered.select("id", F.array(F.lit(1.0)).alias("vec"))
    path = str(tmp_path / "index")
    for _ in range(2):  # building again replaces it
        index.build(numbered, papers, vectors, path, "m1", 4)
    tables = index.open_index(spark, path, "m1")
    assert tables["chunks"].count() == 10 and index.orphans(tables["vectors"], tables["chunks"]).isEmpty()
    try:
        index.open_index(spark, path, "m2")
        raise AssertionError
    except ValueError:
        pass


def test_report(spark):
    assert "| a |" in sinks.report(spark.createDataFrame([(1,)], "a int"), "T")


def test_stream_quota_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = streaming.quota(source, 5).writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {(r["key"], r["nth"], r["admitted"]) for r in spark.table("quota").collect()}
    assert found == {(r["event_id"], r["nth"], r["admitted"]) for r in state.daily_quota(events, 5).collect()}


def test_ingest_counts_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        streaming.ingest(source, str(tmp_path / "out"), str(tmp_path / "c"), lambda b: b).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    assert streaming.windowed_counts(events, "1 hour").agg(F.sum("n")).first()[0] == events.count()
    assert streaming.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_search_reads_the_index(spark, sf_dir, tmp_path):
    """The index's postings give what the texts give, and only the partitions of asked terms are read; a new build takes over at once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    chunks = docs.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("embed_text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit("core").alias("collection"))
    chunks = index.numbered(chunks)
    want = {(r["paper_id"], r["seq"]): i for i, r in enumerate(sorted(chunks.select("paper_id", "seq").collect()), 1)}
    assert {(r["paper_id"], r["seq"]): r["id"] for r in chunks.collect()} == want
    papers, vectors = chunks.select("paper_id").distinct(), chunks.select("id")
    for _ in range(2):
        index.build(chunks, papers, vectors, str(tmp_path), "m")
    opened = index.open_index(spark, str(tmp_path), "m")
    asked = spark.createDataFrame([(1, "the and of heat"), (2, "zu und der"), (3, "nothing xyzzy")], "qid int, question string")
    found = index.search_words(opened, asked, k=5)
    plain = retrieve.bm25(asked, chunks, "id", "embed_text", k=5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() > 0
    assert "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().toString() or "PartitionFilters: [part" in found._jdf.queryExecution().toString()
    ids = [r["content_hash"] for r in chunks.orderBy("seq").collect() if r["paper_id"] == "src1"]
    import hashlib

    sums = {r["paper_id"]: r["fingerprint"] for r in state.fingerprint(chunks, "paper_id", "seq").collect()}
    assert not ids or sums["src1"] == hashlib.sha256("".join(ids).encode()).hexdigest()


def test_ablation_equals_single_runs(spark):
    rows = lambda xs: spark.createDataFrame([(1, x, i) for i, x in enumerate(xs, 1)], "qid int, id int, rank int")
    lexical, near = rows([1, 2, 3, 4, 5, 6, 7]), rows([9, 8, 1])
    papers = spark.createDataFrame([(i, f"p{i % 2}") for i in range(10)], "id int, paper string")
    caps = spark.createDataFrame([(1, 1)], "qid int, cap int")
    found = {}
    for r in retrieve.ablation(lexical, near, papers, caps).orderBy("config", "rank").collect():
        found.setdefault(r["config"], []).append(r["id"])
    assert found["bm25"] == [1, 2, 3, 4, 5, 6] and found["dense"] == [9, 8, 1] and len(found) == 6
    one = [r["id"] for r in retrieve.pick(retrieve.fuse(lexical, near, guaranteed=2), papers, caps).orderBy("rank").collect()]
    assert found["hybrid_adaptive"] == one


def test_drop_caps_and_leading_headings(spark):
    rows = [(0, 0, "I. INTRODUCTION", 10.0, "heading"), (0, 1, "S", 30.0, "heading"), (1, 0, "TOCKS are", 10.0, "text"), (1, 1, "risky", 10.0, "text"), (2, 0, "A", 30.0, "text"), (3, 0, "plain", 10.0, "text")]
    lines = spark.createDataFrame([("d", *r, 10.0) for r in rows], "doc string, block int, line int, text string, size double, kind string, body_size double")
    found = [r["text"] for r in structure.without_drop_caps(lines).orderBy("block", "line").collect()]
    assert found == ["I. INTRODUCTION", "STOCKS are", "risky", "A", "plain"]
    line = "array<struct<text:string,size:double,bold:boolean>>"
    blocks = spark.createDataFrame([(1, "text", [("2.1 Euler method", 10.0, True), ("We use it.", 10.0, False)], 10.0), (2, "text", [("2.1 Euler method", 10.0, True), ("Bold too", 10.0, True)], 10.0), (3, "text", [("plain words", 10.0, False), ("more", 10.0, False)], 10.0)], f"no int, kind string, lines {line}, body_size double")
    parts = structure.split_leading_headings(blocks).groupBy("no").count()
    assert {r["no"]: r["count"] for r in parts.collect()} == {1: 2, 2: 1, 3: 1}


def test_classes_of_blocks(spark):
    rows = [(0, 1, "heading", "A Study of Rain and Snow"), (1, 1, "text", "Ann Smith and Bo Li"), (2, 1, "heading", "1 Introduction"), (3, 1, "text", "Smith says it rains."), (4, 2, "text", "Funding: none."), (5, 2, "text", "Fig. 2 Rain"), (6, 3, "heading", "Funding: this work was paid for by nobody at all")]
    stream = spark.createDataFrame([("d", *r) for r in rows], "doc string, no int, page int, kind string, text string")
    papers = spark.createDataFrame([("d", "A study of rain and snow", ["Smith", "Li"])], "doc string, title string, surnames array<string>")
    found = [r["kind"] for r in structure.classified(stream, papers).orderBy("no").collect()]
    assert found == ["title", "byline", "heading", "text", "backmatter", "caption", "backmatter"]


def test_embedder_and_events(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Rain and snow"), (2, "rain AND snow"), (3, "stock prices"), (4, None)], "id long, text string")
    vec = {r["id"]: r["vec"] for r in service.embedded(texts).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b], strict=True))
    assert abs(dot(1, 2) - 1) < 1e-9 and dot(1, 3) < 0.5 and set(vec[4]) == {0.0}
    assert [r["vec"] for r in service.embedded(texts.where("id = 1"), questions=True).collect()] != [vec[1]]
    names = [n for n, _ in sinks.events({"text": "It rains [1].", "cited": [1]}, [{"n": 1}])]
    assert names == ["sources", "token", "token", "token", "done"] and next(sinks.events({"error": "no"}, []))[0] == "error"
    sinks.write_chunks(chunk_rows(spark), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == chunk_rows(spark).count()
