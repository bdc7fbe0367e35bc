"""Registered queries, each over its whole tables, with DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import mathtext, text, udfs
from lexiforge.operators import answers, chunking, cleaning, context, evaluate, layout, reports, retrieve, sections, service, state, structure, uploads
from lexiforge.sources import layout_json, manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def fill(sql: str, **values) -> str:
    """sql with {name} replaced; all other braces are the regular expressions' own."""
    for name, value in values.items():
        sql = sql.replace(f"{{{name}}}", str(value))
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Retrieval. Questions are the benchmark's items; item i asks with the vector i as well. A document's paper is its source.

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TERMS = f"asked AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({STOP})))) AS term FROM benchmark)"
BM25 = f"""
{TERMS},
words AS (SELECT doc_id AS id, source, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM words),
tf AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM words) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM df, stats),
scored AS (SELECT qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM asked JOIN idf USING (term) JOIN tf USING (term) GROUP BY qid, id)"""
LEXICAL = BM25 + ",\nlexical AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"
NEAR = """
asking AS (SELECT item_id AS qid, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
near AS (SELECT * FROM (SELECT qid, vec_id AS id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM
  (SELECT qid, vec_id, round(1 - list_dot_product(q, embedding::DOUBLE[]), 6) AS distance FROM asking, embeddings)) WHERE rank <= {k})"""
FUSED = """
ranks AS (SELECT coalesce(l.qid, n.qid) AS qid, coalesce(l.id, n.id) AS id, l.rank AS bm25_rank, n.rank AS dense_rank FROM lexical l FULL JOIN near n ON l.qid = n.qid AND l.id = n.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN dense_rank <= {g} THEN dense_rank WHEN bm25_rank <= {g} THEN {g} + bm25_rank END NULLS LAST, rrf DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST) AS pos
  FROM (SELECT *, coalesce(1 / (60 + bm25_rank), 0) + coalesce(1 / (60 + dense_rank), 0) AS rrf FROM ranks))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return questions(spark, sf_dir).join(vectors, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("vec"))


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _lexical(spark: SparkSession, sf_dir: str, k: int = 30, **options) -> DataFrame:
    return retrieve.bm25(questions(spark, sf_dir), table(spark, sf_dir, "documents"), k=k, **options)


def _near(spark: SparkSession, sf_dir: str, k: int = 30, **options) -> DataFrame:
    return retrieve.dense(asking(spark, sf_dir), table(spark, sf_dir, "embeddings"), k=k, **options)


@query(f"WITH {fill(LEXICAL, k=10)} SELECT * FROM lexical")
def bm25_topk(spark, sf_dir):
    return long(_lexical(spark, sf_dir, 10), "rank")


@query(f"WITH {fill(LEXICAL, k=10)} SELECT * FROM lexical")
def bm25_postings(spark, sf_dir):
    """The same from postings and statistics, as a built index holds them."""
    docs = table(spark, sf_dir, "documents")
    posts = retrieve.postings(docs, "doc_id", "text").withColumn("part", retrieve.term_part(F.col("term"), 64))
    return retrieve.bm25_indexed(questions(spark, sf_dir), posts, retrieve.corpus_stats(docs, "text"), k=10)


@query(f"WITH {BM25} SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored JOIN words USING (id) WHERE source IN ('src1', 'src2')) WHERE rank <= 10")
def bm25_filtered(spark, sf_dir):
    """Statistics of all documents, hits of two collections."""
    return long(_lexical(spark, sf_dir, 10, keep=F.col("source").isin("src1", "src2")), "rank")


@query()
def bm25_stemmed(spark, sf_dir):
    """Stems on both sides; words are distinct before stemming, so two forms of a stem count twice."""
    asked = questions(spark, sf_dir).select("qid", text.query_terms(F.col("question")).alias("words"))
    asked = asked.select("qid", F.explode(udfs.stems("words")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(udfs.stems(text.tokens(F.coalesce("text", F.lit("")))), " ").alias("text"))
    return long(retrieve.bm25(questions(spark, sf_dir), docs, k=10, terms=asked), "rank")


@query(f"WITH {fill(NEAR, k=10)} SELECT qid, id, distance, rank FROM near")
def dense_topk(spark, sf_dir):
    return long(_near(spark, sf_dir, 10), "rank")


@query(f"WITH {fill(NEAR, k=60)} SELECT * FROM (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM near JOIN embeddings ON vec_id = id WHERE label IN (1, 2)) WHERE rank <= 10")
def dense_filtered_overfetch(spark, sf_dir):
    return long(_near(spark, sf_dir, 10, keep=F.col("label").isin(1, 2)), "rank")


@query(f"WITH {fill(LEXICAL, k=30)}, {fill(NEAR, k=30)}, {fill(FUSED, g=0)} SELECT qid, id, round(rrf, 6) AS rrf, bm25_rank, dense_rank, pos FROM fused")
def rrf_fusion(spark, sf_dir):
    found = retrieve.fuse(_lexical(spark, sf_dir), _near(spark, sf_dir))
    return long(found.withColumn("rrf", F.round("rrf", 6)), "bm25_rank", "dense_rank", "pos").select("qid", "id", "rrf", "bm25_rank", "dense_rank", "pos")


@query(f"WITH {fill(LEXICAL, k=30)}, {fill(NEAR, k=30)}, {fill(FUSED, g=2)} SELECT qid, id, pos FROM fused")
def hybrid_guaranteed(spark, sf_dir):
    return long(retrieve.fuse(_lexical(spark, sf_dir), _near(spark, sf_dir), guaranteed=2), "pos").select("qid", "id", "pos")


CAPPED = """
capped AS (SELECT qid, id, source AS paper, pos, row_number() OVER (PARTITION BY qid, source ORDER BY pos) > CASE WHEN qid % 2 = 0 THEN 2 ELSE 6 END AS over FROM fused JOIN documents ON doc_id = id),
hits AS (SELECT qid, id, paper, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY over, pos) AS rank FROM capped) WHERE rank <= 6)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("paper"))
    caps = questions(spark, sf_dir).select("qid", F.when(F.col("qid") % 2 == 0, 2).otherwise(6).alias("cap"))
    return retrieve.hybrid(questions(spark, sf_dir), docs, asking(spark, sf_dir), table(spark, sf_dir, "embeddings"), papers, caps)


HITS = f"{fill(LEXICAL, k=30)}, {fill(NEAR, k=30)}, {fill(FUSED, g=2)}, {CAPPED}"


@query(f"WITH {HITS} SELECT * FROM hits")
def hybrid_capped(spark, sf_dir):
    """The flagship: even questions ask for breadth, two hits of a source; the others have no cap."""
    return long(_hits(spark, sf_dir), "rank").select("qid", "id", "paper", "rank")


GOLD = "gold AS (SELECT item_id AS qid, ['src' || (item_id % 20)::VARCHAR, 'src' || ((item_id + 7) % 20)::VARCHAR] AS papers, item_id % 4 AS type FROM benchmark)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lambda x: F.concat(F.lit("src"), x.cast("string"))
    return questions(spark, sf_dir).select("qid", F.array(source(F.col("qid") % 20), source((F.col("qid") + 7) % 20)).alias("papers"), (F.col("qid") % 4).alias("type"))


METRICS = f"""
{GOLD},
good AS (SELECT gold.qid, any_value(type) AS type, min(CASE WHEN list_contains(papers, paper) THEN rank END) AS first,
  count(DISTINCT CASE WHEN list_contains(papers, paper) AND rank <= 6 THEN paper END) AS found, count(CASE WHEN list_contains(papers, paper) AND rank <= 6 THEN 1 END) AS deep
  FROM gold LEFT JOIN hits USING (qid) GROUP BY gold.qid),
metrics AS (SELECT qid, type, coalesce((first <= 1)::INT, 0) AS hit_at_1, coalesce((first <= 3)::INT, 0) AS hit_at_3, coalesce((first <= 6)::INT, 0) AS hit_at_6, coalesce((first <= 10)::INT, 0) AS hit_at_10,
  round(coalesce(1 / first, 0), 6) AS rr, round(found / 2, 6) AS cov_at_6, round(deep / 6, 6) AS depth_at_6 FROM good)"""


@query(f"WITH {HITS}, {METRICS} SELECT * EXCLUDE (type) FROM metrics")
def retrieval_metrics(spark, sf_dir):
    return evaluate.retrieval_metrics(_hits(spark, sf_dir), _gold(spark, sf_dir))


@query(f"WITH {HITS}, {METRICS} SELECT type, count(*) AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_6), 6) AS hit_at_6, round(avg(hit_at_10), 6) AS hit_at_10, round(avg(rr), 6) AS rr, round(avg(cov_at_6), 6) AS cov_at_6, round(avg(depth_at_6), 6) AS depth_at_6 FROM metrics GROUP BY GROUPING SETS ((type), ())")
def metrics_by_type(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return evaluate.metric_summary(evaluate.retrieval_metrics(_hits(spark, sf_dir), gold).join(gold.select("qid", "type"), "qid"), ["type"])


NORM = "regexp_replace(regexp_replace(translate(lower({x}), '−– ', '-- '), '(\\d),(\\d\\d\\d\\b)', '\\1\\2', 'g'), '\\s+', ' ', 'g')"


@query(f"""WITH {HITS}, texts AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN documents ON doc_id = id GROUP BY qid)
SELECT item_id AS qid, list_bool_and(list_transform(string_split(b.text, '.'), lambda s: contains({fill(NORM, x="coalesce(context, '')")}, {fill(NORM, x='s')})))::INT AS evidence FROM benchmark b LEFT JOIN texts ON qid = item_id""")
def evidence_recall(spark, sf_dir):
    """Are all sentences of each item in the context of its hits?"""
    hits = _hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    contexts = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    gold = questions(spark, sf_dir).select("qid", F.split("question", r"\.").alias("must_include"))
    return evaluate.evidence(contexts, gold)


# Context. Conversations are papers, turns their chunks.


@query("""
WITH hits AS (SELECT conv_id AS qid, conv_id AS paper_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations QUALIFY n <= 2),
wanted AS (SELECT qid, n, paper_id, seq + d AS seq, d = 0 AS own FROM hits, (VALUES (-1), (0), (1)) v(d)),
claimed AS (SELECT w.qid, w.n, w.seq, c.text, own FROM wanted w JOIN conversations c ON c.conv_id = w.paper_id AND c.turn = w.seq QUALIFY row_number() OVER (PARTITION BY w.qid, w.seq ORDER BY own DESC, n) = 1)
SELECT qid, n, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM claimed GROUP BY qid, n""")
def neighbour_context(spark, sf_dir):
    """The two longest turns of each conversation, with their neighbours; a turn is shown once."""
    turns = table(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))
    hits = turns.withColumn("n", n).where("n <= 2").select(F.col("conv_id").alias("qid"), F.col("n").cast("long").alias("n"), F.col("conv_id").alias("paper_id"), F.lit("chat").alias("heading"), F.col("turn").alias("seq"))
    chunks = turns.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("seq"), F.lit("chat").alias("heading"), F.lit("prose").alias("kind"), "text")
    return context.widened(context.neighbours(hits, chunks)).select("qid", "n", "text")


@query("""
WITH recent AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 8),
begun AS (SELECT *, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS users FROM recent QUALIFY users > 0),
changes AS (SELECT *, coalesce((role != lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT, 0) AS change FROM begun),
runs AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM changes),
merged AS (SELECT conv_id, pos, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM runs GROUP BY conv_id, pos, role),
ended AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM merged)
SELECT conv_id, pos::BIGINT AS pos, role, substring(text, 1, 2000) AS text FROM ended WHERE NOT (pos = last AND role = 'user')""")
def history_normalise(spark, sf_dir):
    return context.history(table(spark, sf_dir, "conversations"))


@query("""SELECT doc_id AS paper_id, coalesce('label:' || quality::VARCHAR, '') AS doi, coalesce(CASE WHEN quality = 1 THEN 'core' WHEN quality = 0 THEN 'user' END, 'core') AS collection,
  CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substring(t, 1, 299), '\\s\\S*$', '') || '…' END AS snippet
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents) LEFT JOIN labels USING (doc_id)""")
def source_cards(spark, sf_dir):
    passages = table(spark, sf_dir, "documents").select(F.lit(1).alias("qid"), F.lit(1).alias("n"), F.col("doc_id").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    papers = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("label:"), F.col("quality").cast("string")).alias("doi"), F.when(F.col("quality") == 1, "core").when(F.col("quality") == 0, "user").alias("collection"))
    return context.source_cards(passages, papers).select("paper_id", "doi", "collection", "snippet")


@query("""SELECT conv_id, turn, regexp_replace(text, '\\.( |$)', '. [' || (turn % 3 + 1)::VARCHAR || ']\\1', 'g') AS text,
  CASE WHEN regexp_matches(text, '\\.( |$)') THEN [(turn % 3 + 1)::INT] ELSE []::INT[] END AS cited, regexp_matches(text, '\\.( |$)') AS has_citation FROM conversations""")
def citation_validate(spark, sf_dir):
    """Each turn cites a good and a bad passage after each sentence; the bad one goes."""
    turns = table(spark, sf_dir, "conversations")
    good = F.col("turn") % 3 + 1
    marked = F.regexp_replace("text", F.lit(r"\.( |$)"), F.concat(F.lit(". ["), good.cast("string"), F.lit(", 9]$1")))
    rows = context.checked_answers(turns.select("conv_id", "turn", marked.alias("text"), F.lit(6).alias("n_passages")))
    return rows.select("conv_id", "turn", "text", "cited", (F.size("cited") > 0).alias("has_citation"))


NUMBERS = "regexp_extract_all(" + fill(NORM, x="{x}") + ", '\\d+(?:\\.\\d+)?')"


@query(f"""SELECT d.doc_id, list_filter({fill(NUMBERS, x="coalesce(text, '')")}, lambda n: list_contains({fill(NUMBERS, x="coalesce(url || ' ' || html, '')")}, n) AND NOT regexp_matches(n, '^(19|20)\\d\\d$') AND n NOT IN ('0', '1', '2')) AS leaked
FROM documents d LEFT JOIN pages ON page_id = doc_id""")
def leak_numbers(spark, sf_dir):
    """Numbers of a document that the page of its number has too; none where there is no page."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("passages"))
    return table(spark, sf_dir, "documents").join(pages, "doc_id", "left").select("doc_id", evaluate.leaked_numbers(F.coalesce("text", F.lit("")), F.coalesce("passages", F.lit(""))).alias("leaked"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    answer = F.when(F.col("qid") % 5 == 0, text.REFUSAL).otherwise(F.concat(F.col("question"), F.when(F.col("qid") % 3 > 0, " [1]").otherwise(" [9]")))
    rows = context.checked_answers(rows.select("qid", F.when(F.col("qid") % 4 == 0, "unanswerable").otherwise("factoid").alias("type"), "question", answer.alias("text"), F.lit(3).alias("n_passages")))
    return evaluate.auto_checks(rows.withColumns({"must_include": F.split("question", " "), "context": F.col("question"), "no_metric": F.col("qid") % 7 == 0}))


@query(f"""
WITH a AS (SELECT item_id AS qid, item_id % 4 = 0 AS un, item_id % 5 = 0 AS refused, item_id % 5 != 0 AND item_id % 3 > 0 AS cites, item_id % 5 != 0 AND item_id % 3 = 0 AS bad,
  CASE WHEN item_id % 5 = 0 THEN 'The corpus doesn''t cover this.' ELSE text END AS t, text AS question, item_id % 7 = 0 AS no_metric FROM benchmark),
c AS (SELECT *, {fill(NORM, x='t')} AS norm, list_filter({fill(NUMBERS, x="replace(t, 'The corpus doesn''t cover this.', '')")}, lambda n: list_contains({fill(NUMBERS, x='question')}, n) AND NOT regexp_matches(n, '^(19|20)\\d\\d$') AND n NOT IN ('0', '1', '2')) AS leaked FROM a),
m AS (SELECT *, NOT no_metric OR NOT (regexp_matches(norm, '\\d(?:\\.\\d+)?\\s*%') OR regexp_matches(norm, '\\b(mape|rmse)\\b[^.\\n]{{0,25}}\\d')) AS metric_ok, list_bool_and(list_transform(string_split(question, ' '), lambda w: contains(norm, {fill(NORM, x='w')}))) AS has FROM c)
SELECT qid, CASE WHEN un THEN 'unanswerable' ELSE 'factoid' END AS type, refused, NOT bad AS citations_valid,
  NOT bad AND metric_ok AND CASE WHEN un THEN refused AND len(leaked) = 0 ELSE has AND cites AND NOT refused END AS auto_pass FROM m""")
def auto_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("qid", "type", "refused", "citations_valid", "auto_pass")


@query("""SELECT CASE WHEN GROUPING(type) = 0 THEN type END AS type, count(*) AS n, round(avg((judge = 2)::INT), 6) AS accuracy, round(avg(judge), 6) AS mean_score, round(avg(refused::INT), 6) AS refusal_rate, round(sum(cost), 6) AS cost, median(latency)::DOUBLE AS median_latency
FROM (SELECT source AS type, quality * 2 - toxic AS judge, toxic = 1 AS refused, (n_chars / 4 * 1.0 + 200 * 5.0) / 1e6 AS cost, n_chars AS latency FROM documents JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((type), ())""")
def answer_summary(spark, sf_dir):
    """Labels judge, sources are question types, lengths stand for latency and cost."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cost = mathtext.cost(F.lit("m"), F.col("n_chars") / 4, F.lit(200), {"m": (1.0, 5.0)})
    return evaluate.answer_summary(rows.select(F.col("source").alias("type"), (F.col("quality") * 2 - F.col("toxic")).alias("judge"), (F.col("toxic") == 1).alias("refused"), cost.alias("cost"), F.col("n_chars").alias("latency")))


@query("""SELECT conv_id, round(sum(CASE role WHEN 'user' THEN (length(text) / 4 * 3.0) / 1e6 WHEN 'assistant' THEN (length(text) / 4 * 15.0) / 1e6 ELSE 0 END), 9) AS cost FROM conversations GROUP BY conv_id""")
def cost_report(spark, sf_dir):
    """Users' text is input, assistants' output; other roles have no price."""
    size = F.length("text") / 4
    own = mathtext.cost(F.col("role"), size, F.lit(0), {"user": (3.0, 0.0), "assistant": (15.0, 0.0)})
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.sum(own), 9).alias("cost"))


# Cleaning. A line's page is its number divided by five.

KEY = "trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))"
LINES = "lines AS (SELECT doc_id AS doc, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"""WITH {LINES}, keyed AS (SELECT doc, line_no // 5 AS page, {KEY} AS key FROM lines),
pages AS (SELECT doc, count(DISTINCT page) AS pages FROM keyed GROUP BY doc HAVING count(DISTINCT page) >= 3),
hits AS (SELECT doc, key, count(DISTINCT page) AS n FROM keyed WHERE length(key) >= 6 GROUP BY doc, key)
SELECT doc, key, n, pages FROM hits JOIN pages USING (doc) WHERE n >= 0.5 * pages""")
def repeated_lines(spark, sf_dir):
    lines = cleaning.lines_of(table(spark, sf_dir, "documents"))
    return cleaning.repeated_lines(lines.withColumn("page", F.floor(F.col("line_no") / 5)))


#: Lines that stand beside those of the documents, so that each pattern has something to find and to leave alone.
SEEDS = (
    "Downloaded from https://example.org on 3 May", "ISSN: 1234-5678", "E-mail: someone@example.org", "doi: 10.1000/182", "Received 3 May 2020; accepted 4 June 2020", "Volume 7, Issue 2, pp. 11-19",
    "Copyright 2021 by the authors. Licensee: an open press.", "This is an open access article distributed under the terms of the Creative Commons Attribution License", "© 2020 The Authors. Published by a society.",
    "All rights reserved. No part may be copied.", "The licence of the driver was renewed.", "the volume of trade rose", "Corresponding author: A. Person", "Page 3 of 12", "www.example.org/journal", "Article", "",
    "Creative Commons " + "word " * 130,
)
SEEDED = LINES + ", seeded AS (SELECT doc, line_no, line FROM lines UNION ALL SELECT -1, i, x FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SEEDS)) + ") AS v(i, x))"


def seeded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cleaning.lines_of(table(spark, sf_dir, "documents")).select(F.col("doc").cast("long"), F.col("line_no").cast("long"), "line")
    return lines.unionByName(spark.createDataFrame([(-1, i, x) for i, x in enumerate(SEEDS)], "doc long, line_no long, line string"))


PATTERN = "(?i)" + "|".join(text.BOILERPLATE).replace("'", "''")


@query(f"WITH {SEEDED} SELECT doc, line_no, line FROM seeded WHERE regexp_matches(line, '{PATTERN}')")
def boilerplate_lines(spark, sf_dir):
    return seeded_lines(spark, sf_dir).where(text.is_boilerplate(F.col("line")))


LICENCE = text.LICENCE.replace("'", "''")


@query(f"WITH {SEEDED} SELECT doc, line_no, line FROM seeded WHERE regexp_matches(line, '{LICENCE}') AND len(regexp_extract_all(line, '\\S+')) <= 120")
def licence_blocks(spark, sf_dir):
    """A line as a block."""
    return seeded_lines(spark, sf_dir).where(text.is_licence_block(F.col("line")))


LEAD = structure.BACKMATTER.replace("'", "''")
LEADS = ("Funding: none.", "Data Availability Statement. On request.", "conflict of interest: none", "Ethics approval and consent to participate: n/a", "Funding was scarce", "The acknowledgements: none")


@query(f"WITH {LINES} SELECT doc, line_no, line FROM (SELECT doc, line_no, line FROM lines UNION ALL SELECT -1, i, x FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LEADS)) + f") AS v(i, x)) WHERE regexp_matches(line, '{LEAD}')")
def backmatter_leads(spark, sf_dir):
    lines = cleaning.lines_of(table(spark, sf_dir, "documents")).select(F.col("doc").cast("long"), F.col("line_no").cast("long"), "line")
    rows = lines.unionByName(spark.createDataFrame([(-1, i, x) for i, x in enumerate(LEADS)], "doc long, line_no long, line string"))
    return rows.where(structure.is_backmatter_lead(F.col("line")))


@query(f"""WITH {LINES}, spans AS (SELECT doc, line_no // 3 AS block, length(line) AS n, 8 + line_no % 3 AS size, length(line) % 2 = 0 AS bold FROM lines),
sizes AS (SELECT doc, block, size, sum(n) AS n, sum(CASE WHEN bold THEN n ELSE 0 END) AS heavy FROM spans GROUP BY doc, block, size)
SELECT doc, block::BIGINT AS block, arg_max(size, (n, size))::DOUBLE AS size, 2 * sum(heavy) > sum(n) AS bold FROM sizes GROUP BY doc, block""")
def dominant_styles(spark, sf_dir):
    """Three lines are a block; a line is a span whose size goes with its number and whose weight goes with its length."""
    lines = cleaning.lines_of(table(spark, sf_dir, "documents"))
    spans = lines.select("doc", F.floor(F.col("line_no") / 3).alias("block"), F.col("line").alias("text"), (8.0 + F.col("line_no") % 3).alias("size"), (F.length("line") % 2 == 0).alias("bold"))
    return structure.dominant_style(spans)


@query(f"""WITH {LINES}, s AS (SELECT doc, line_no, CASE WHEN length(line) % 3 = 0 THEN line END AS section, CASE WHEN length(line) % 3 = 1 THEN line_no END AS marker FROM lines),
f AS (SELECT doc, line_no AS no, marker, last_value(section IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS section FROM s)
SELECT doc, no::BIGINT AS no, marker::BIGINT AS marker, section FROM f WHERE marker IS NOT NULL""")
def marker_sections(spark, sf_dir):
    """Lines whose length leaves 0 modulo 3 open sections, those that leave 1 are markers."""
    lines, left = cleaning.lines_of(table(spark, sf_dir, "documents")), F.length("line") % 3
    stream = lines.select("doc", F.col("line_no").alias("no"), F.when(left == 0, F.col("line")).alias("section"), F.when(left == 1, F.col("line_no")).alias("marker"))
    return long(structure.marker_sections(stream), "no", "marker")


@query("""SELECT conv_id, turn, CASE WHEN code NOT IN ('user') THEN 401 WHEN m = '' THEN 400 WHEN length(m) > 60 THEN 400 WHEN nth > 100 THEN 429 ELSE 200 END AS status,
CASE WHEN code NOT IN ('user') THEN 'code' WHEN m = '' THEN 'empty' WHEN length(m) > 60 THEN 'length' WHEN nth > 100 THEN 'budget' END AS reason
FROM (SELECT conv_id, turn, role AS code, trim(coalesce(text, '')) AS m, (conv_id + turn) % 150 AS nth FROM conversations)""")
def request_guards(spark, sf_dir):
    """A turn's role as its access code, and a number of the day from its ids."""
    turns = table(spark, sf_dir, "conversations")
    nth = (F.col("conv_id") + F.col("turn")) % 150
    return service.guarded(turns.select("conv_id", "turn", F.col("role").alias("code"), F.col("text").alias("message"), nth.alias("nth")), "user", 100, 60).select("conv_id", "turn", "status", "reason")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 != 0 THEN turn::INT END AS score, CASE WHEN turn % 3 != 0 THEN turn % 2 = 0 END AS faithful,
CASE WHEN turn % 3 = 0 THEN 'unparseable judge output: ' || left('{' || coalesce(text, ''), 120) END AS error FROM conversations""")
def judge_verdicts(spark, sf_dir):
    """Every third turn's verdict is cut off."""
    turns = table(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.col("turn").cast("int").alias("score"), (F.col("turn") % 2 == 0).alias("faithful"), F.lit("r").alias("reason")))
    replies = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, good).otherwise(F.concat(F.lit("{"), F.coalesce("text", F.lit("")))).alias("text"))
    return service.verdicts(replies).select("conv_id", "turn", "score", "faithful", "error")


@query("SELECT g.item_id AS qid, coalesce(o.text, g.text) AS needs FROM benchmark g LEFT JOIN benchmark o ON o.item_id = CASE WHEN g.item_id % 2 = 1 THEN g.item_id - 1 END WHERE g.item_id % 5 != 0")
def gold_questions(spark, sf_dir):
    """Odd items paraphrase the item before; every fifth can't be answered."""
    i = F.col("item_id")
    gold = table(spark, sf_dir, "benchmark").select(i.alias("qid"), F.when(i % 2 == 1, i - 1).alias("paraphrase_of"), F.array("text").alias("must_include"), F.when(i % 5 == 0, "unanswerable").otherwise("factoid").alias("type"), F.array(i).alias("papers"))
    return service.answerable(service.with_originals(gold)).select("qid", F.get("must_include", F.lit(0)).alias("needs"))


@query()
def near_dup_lines(spark, sf_dir):
    return cleaning.near_repeats_removed(table(spark, sf_dir, "documents"))


@query("SELECT doc_id AS doc, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) GROUP BY doc_id, word")
def doc_vocabulary(spark, sf_dir):
    return cleaning.vocabulary(table(spark, sf_dir, "documents"))


@query()
def dehyphenate(spark, sf_dir):
    return cleaning.dehyphenate(table(spark, sf_dir, "documents"))


@query(f"""WITH {LINES}, b AS (SELECT doc, line, count(*) OVER (PARTITION BY doc, line) AS n FROM lines)
SELECT doc, line AS text, n FROM b WHERE n >= 4 AND len(regexp_extract_all(line, '\\S+')) <= 3 GROUP BY ALL""")
def figure_labels(spark, sf_dir):
    rows = cleaning.lines_of(table(spark, sf_dir, "documents")).select("doc", F.lit("text").alias("kind"), F.col("line").alias("text"))
    return cleaning.figure_labels(rows).where("figure_label").groupBy("doc", "text").agg(F.count("*").alias("n"))


MATH = mathtext.MATH_CLASS


@query(f"""SELECT doc_id, round((length(t) - length(r)) / greatest(1, length(regexp_replace(r, '[^\\p{{L}}]', '', 'g'))), 6) AS density
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{MATH}', '', 'g') AS r FROM documents)""")
def math_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(mathtext.math_density(F.coalesce("text", F.lit(""))), 6).alias("density"))


ISLAND = f"(length(line) - length(r)) / greatest(1, length(regexp_replace(r, '[^\\p{{L}}]', '', 'g'))) > 0.25 OR (regexp_matches(line, '\\((\\d{{1,3}}[a-z]?)\\)\\s*$') AND w <= 3) OR (w <= 1 AND regexp_matches(line, '[=+\\-−^_βαγδσμλθ∑∫]|\\(\\d'))"


@query(f"""WITH {LINES}, m AS (SELECT doc, line_no, w, ({ISLAND}) AS math FROM (SELECT *, regexp_replace(line, '{MATH}', '', 'g') AS r, len(regexp_extract_all(line, '\\b[A-Za-z]{{3,}}\\b')) AS w FROM lines)),
g AS (SELECT doc, line_no, math AND bool_or(w >= 4) OVER (PARTITION BY doc) AS math FROM m),
c AS (SELECT *, coalesce((math != lag(math) OVER (PARTITION BY doc ORDER BY line_no))::INT, 0) AS change FROM g),
i AS (SELECT *, sum(change) OVER (PARTITION BY doc ORDER BY line_no)::BIGINT AS island FROM c)
SELECT doc, island, math, min(line_no) AS first, count(*) AS n FROM i GROUP BY doc, island, math""")
def line_islands(spark, sf_dir):
    return long(sections.line_islands(cleaning.lines_of(table(spark, sf_dir, "documents"))), "first", "island")


@query()
def section_assembly(spark, sf_dir):
    """Lines as blocks of one style: headings are bold where they are short and capitalised."""
    lines = cleaning.lines_of(table(spark, sf_dir, "documents"))
    bold = (F.length("line") <= 40) & F.col("line").rlike(r"^\p{Lu}") & ~F.col("line").rlike(r"[.]$")
    blocks = lines.select("doc", F.col("line_no").alias("no"), F.lit("text").alias("kind"), F.col("line").alias("text"), F.col("line").alias("raw"), F.lit(10.0).alias("size"), bold.alias("bold"), F.lit(1).alias("lines"))
    rows = sections.assembled(sections.classified(blocks))
    return rows.groupBy("doc", "section_no", "section_label", "section_heading").agg(F.min("no").alias("first"), F.count("*").alias("blocks"))


# Chunks, contents, pages.

@query(f"""SELECT doc_id, len(list_filter(string_split(regexp_replace(m, '([.!?])\\s+([A-Z0-9(\\[$])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(s) != '')) AS sentences
FROM (SELECT doc_id, regexp_replace(t, '\\b(et al|Fig|Eq|e\\.g|i\\.e|vs|No|pp|al)\\.(\\s)', '\\1' || chr(1) || '\\2', 'g') AS m FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("sentences"))


@query()
def chunk_pack(spark, sf_dir):
    return chunking.chunks(chunking.documents_as_parsed(table(spark, sf_dir, "documents"))).select("chunk_id", "paper_id", "seq", "section", "kind", "n_tokens", "content_hash")


@query()
def table_split(spark, sf_dir):
    """Each document's lines as rows of one table."""
    docs = table(spark, sf_dir, "documents")
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.split(x, " ", 3))
    tables = F.array(F.struct(F.concat(F.lit("Table "), F.col("doc_id").cast("string"), F.lit(". Lines")).alias("caption"), F.lit("data").alias("section"), F.lit(1).alias("page"), rows.alias("rows")))
    parsed = chunking.documents_as_parsed(docs.withColumn("_t", tables)).drop("tables")
    keyed = docs.select(F.col("doc_id").cast("string").alias("paper_id"), tables.alias("tables"))
    return chunking.chunks(parsed.withColumn("sections", F.slice("sections", 1, 0)).join(keyed, "paper_id")).where("kind = 'table'").select("paper_id", "seq", "n_tokens", "content_hash")


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY coalesce(text, '') HAVING count(*) > 1")
def content_dedup(spark, sf_dir):
    return state.content_duplicates(table(spark, sf_dir, "documents"))


@query("SELECT source, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def corpus_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return state.fingerprint(rows, "source", "doc_id")


@query("""WITH m AS (SELECT CASE WHEN doc_id % 10 = 9 THEN 'd' || (doc_id - 1) ELSE 'd' || doc_id END AS id, doc_id, coalesce(text, '') AS t FROM documents)
SELECT id, 'duplicate id' AS problem FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'missing file' FROM m WHERE doc_id % 7 = 3
UNION ALL SELECT id, 'other content' FROM m WHERE doc_id % 7 <> 3 AND sha256(t) <> CASE WHEN doc_id % 6 = 5 THEN sha256('') ELSE sha256(t) END""")
def manifest_check(spark, sf_dir):
    """Documents as files, and a manifest in which ids repeat, files are missing and hashes are those of other contents."""
    i, content = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs, file = table(spark, sf_dir, "documents"), F.concat(i.cast("string"), F.lit(".txt"))
    of_id = F.concat(F.lit("d"), F.when(i % 10 == 9, i - 1).otherwise(i).cast("string"))
    papers = docs.select(of_id.alias("id"), file.alias("file"), F.sha2(F.when(i % 6 == 5, "").otherwise(content), 256).alias("sha256"))
    files = docs.where(i % 7 != 3).select(F.concat(F.lit("papers/"), file).alias("path"), content.cast("binary").alias("content"))
    return manifest.problems(papers, files)


TAGS = "regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
ENTITIES = f"replace(replace(replace(replace(replace(replace({TAGS}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace({ENTITIES}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


# Text rules, each over whole tables.


@query("SELECT doc_id, regexp_replace(translate(lower(text), chr(8722) || chr(8211) || chr(160) || ',', '-- '), '\\s+', ' ', 'g') AS text FROM documents")
def parser_texts(spark, sf_dir):
    """Texts as parsers' outputs are compared."""
    return table(spark, sf_dir, "documents").select("doc_id", text.parser_norm(F.col("text")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, 299), '\\s\\S*$', '') || chr(8230) END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT conv_id, coalesce(string_agg(role || ': ' || substr(regexp_replace(text, '[ \\t]*\\[\\d{1,2}(?:\\s*[,;]\\s*\\d{1,2})*\\]', '', 'g'), 1, 600), chr(10) ORDER BY turn, role, text), '') AS transcript
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id""")
def transcripts(spark, sf_dir):
    """The last six turns of each conversation as lines. Ranks cut each group before its turns are gathered."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    recent = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(newest)).where("back <= 6")
    turns = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", text.transcript(F.col("turns")).alias("transcript"))


@query(fill("SELECT item_id AS qid, CASE WHEN regexp_matches(text, '{breadth}') THEN 2 ELSE 6 END::BIGINT AS cap FROM benchmark", breadth=text.BREADTH.replace("'", "''")))
def breadth_caps(spark, sf_dir):
    """The most chunks of one paper for each question that names none."""
    cap = text.per_paper_cap(F.col("question"), F.lit(0), 6).cast("long")
    return questions(spark, sf_dir).select("qid", cap.alias("cap"))


DESPACED = "array_to_string(list_transform(regexp_split_to_array(trim(line), '\\s{2,}'), lambda p: CASE WHEN regexp_full_match(p, '(?:[A-Z] )+[A-Z]') THEN replace(p, ' ', '') ELSE p END), ' ')"
LABELLED = " ".join(f"WHEN regexp_matches(h, '(?i)\\b({words})') THEN '{label}'" for label, words in text.LABELS.items())


@query(f"""WITH {LINES} SELECT doc, line_no, CASE WHEN regexp_matches(h, '(?i)\\bresults?\\b') AND NOT regexp_matches(h, '(?i)\\b({text.LABELS["backmatter"]})') THEN 'results' {LABELLED} ELSE 'other' END AS label
FROM (SELECT doc, line_no, regexp_replace({DESPACED}, '^(\\d+(\\.\\d+)*\\.?|[IVX]+\\.)\\s*', '') AS h FROM lines)""")
def heading_labels(spark, sf_dir):
    """Each line as a heading: the section that it would open."""
    lines = cleaning.lines_of(table(spark, sf_dir, "documents"))
    return long(lines.select("doc", "line_no", text.section_label(F.col("line")).alias("label")), "line_no")


@query(f"""WITH {LINES} SELECT doc, line_no, CASE WHEN number <> '' THEN len(string_split(number, '.')) WHEN regexp_matches(line, '{text.ROMAN}') OR (upper(line) = line AND lower(line) <> line)
  OR regexp_matches(line, '{text.STRUCTURAL}') THEN 1 ELSE 2 END::BIGINT AS level FROM (SELECT *, regexp_extract(line, '{text.NUMBERED}', 1) AS number FROM lines)""")
def heading_levels(spark, sf_dir):
    """Each line as a heading in plain type: its depth."""
    lines = cleaning.lines_of(table(spark, sf_dir, "documents"))
    return long(lines.select("doc", "line_no", text.heading_level(F.col("line"), F.lit(False)).alias("level")), "line_no", "level")


# State. Events are requests.


@query("SELECT event_id, nth, nth <= 50 AS admitted FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS nth FROM events)")
def daily_quota(spark, sf_dir):
    return state.daily_quota(table(spark, sf_dir, "events"), 50).select("event_id", "nth", "admitted")


@query("SELECT event_id, nth, nth <= 2 AS admitted FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events)")
def rate_limit(spark, sf_dir):
    return state.rate_limit(table(spark, sf_dir, "events"), 2, "1 hour").select("event_id", "nth", "admitted")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS")
def log_retention(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return state.retained(events.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")  # now is one row


@query("SELECT event_type AS collection, count(*) AS n FROM events GROUP BY event_type")
def counts_by_collection(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("collection")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS paper_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def job_status(spark, sf_dir):
    """The last state of each user, as of a job."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), "ts", "event_id", F.col("event_type").alias("status"))
    return state.latest(rows, tie="event_id")


@query(f"SELECT item_id AS qid, array_to_string(list_transform(list_distinct_ordered, lambda t: chr(34) || t || chr(34)), ' OR ') AS expression FROM (SELECT item_id, list(term ORDER BY first) AS list_distinct_ordered FROM (SELECT item_id, term, min(pos) AS first FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark)) WHERE term NOT IN ({STOP}) GROUP BY item_id, term) GROUP BY item_id)")
def match_expressions(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", text.match_expression(F.col("question")).alias("expression"))


@query(f"""WITH {HITS}, t AS (SELECT qid, rank AS n, text AS t, regexp_replace(text, '\\b(et al|Fig|Eq|e\\.g|i\\.e|vs|No|pp|al)\\.(\\s)', '\\1' || chr(1) || '\\2', 'g') AS m FROM hits JOIN documents ON doc_id = id WHERE rank <= 2),
p AS (SELECT qid, n, t, replace(list_filter(string_split(regexp_replace(m, '([.!?])\\s+([A-Z0-9(\\[$])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(s) != '')[1], chr(1), '.') AS s FROM t)
SELECT qid, string_agg(regexp_replace(coalesce(s, t), '[ \\t]*\\[\\d{{1,2}}(?:\\s*[,;]\\s*\\d{{1,2}})*\\]', '', 'g') || ' [' || n || ']', ' ' ORDER BY n) AS text, list(n::INT ORDER BY n) AS cited, false AS refused, false AS uncited FROM p GROUP BY qid""")
def extractive_answers(spark, sf_dir):
    """The offline answer to each question from its two first hits, with its citations checked."""
    hits = _hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("qid", F.col("rank").alias("n"), "text")
    answers = context.extractive_answers(hits).withColumn("n_passages", F.lit(6))
    return context.checked_answers(answers).select("qid", "text", "cited", "refused", "uncited")


@query(f"""WITH {LINES} SELECT source AS parser, count(*) AS blocks, sum(len(regexp_extract_all(line, '\\S+')))::BIGINT AS words,
  round(avg((100 * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) < 55 * length(regexp_replace(line, '\\s', '', 'g')) OR len(regexp_extract_all(line, '\\S+')) < 4)::INT), 6) AS junk_rate,
  sum((length(line) - length(replace(line, '$', ''))) // 2)::BIGINT AS inline_formulas, 0::BIGINT AS latex_equations FROM lines GROUP BY source""")
def parser_scores(spark, sf_dir):
    """Lines as blocks, sources as parsers."""
    docs = table(spark, sf_dir, "documents")
    lines = cleaning.lines_of(docs).join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("parser")), "doc")
    blocks = lines.select("parser", "doc", F.lit("text").alias("kind"), F.col("line").alias("text"), F.lit(None).cast("string").alias("latex"))
    return reports.parser_scores(blocks)


@query("""SELECT page_id::VARCHAR AS doc, n - 1 AS no, lower(regexp_extract(html, '^<(\\w+)', 1)) = 'p' AS paragraph FROM
(SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|table|nav)\\b[^>]*>.*?</(?:h[1-6]|p|li|table|nav)>')) AS html, generate_subscripts(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|table|nav)\\b[^>]*>.*?</(?:h[1-6]|p|li|table|nav)>'), 1) AS n FROM pages)""")
def html_blocks(spark, sf_dir):
    rows = layout_json.html_blocks(table(spark, sf_dir, "pages"))
    return long(rows.select("doc", "no", (F.coalesce("kind", F.lit("")) == "text").alias("paragraph")), "no")


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ts::DATE")
def used_by_day(spark, sf_dir):
    return state.used(table(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("string"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents),
known AS (SELECT sha256 FROM d JOIN labels USING (doc_id) WHERE quality = 1)
SELECT sha256, uploaded_at, filename FROM (SELECT sha256, doc_id % 100 AS uploaded_at, doc_id AS filename, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id % 100, doc_id) AS n FROM d)
WHERE n = 1 AND sha256 NOT IN (SELECT sha256 FROM known)""")
def new_uploads(spark, sf_dir):
    """Documents as uploads; labelled ones are registered, those of low quality as failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    registered = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("sha256", F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))
    uploads = docs.select("sha256", (F.col("doc_id") % 100).alias("uploaded_at"), F.col("doc_id").alias("filename"))
    return state.new_uploads(uploads, registered)


@query("SELECT min(printf('u%02d', i)) AS paper_id FROM range(1, 100) r(i) WHERE i NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 13 != 12)")
def smallest_free_id(spark, sf_dir):
    """Keys of nations as registered ids, two of which are free."""
    taken = table(spark, sf_dir, "nation").where("n_nationkey % 13 != 12").select(F.format_string("u%02d", "n_nationkey").alias("paper_id"))
    return state.smallest_free_id(taken)


@query("SELECT doc_id, source AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'core' ELSE 'user' END AS collection FROM documents WHERE NOT coalesce(source IN ('src1', 'src4') AND doc_id % 3 != 0, FALSE)")
def deleted_documents(spark, sf_dir):
    """What stays after two papers are deleted: core rows of theirs, and all others."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, "core").otherwise("user").alias("collection"))
    return state.without_document(rows, spark.createDataFrame([("src1",), ("src4",)], "paper_id string"))


@query(fill("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND NOT starts_with(t, '%PDF') THEN 'not a PDF' WHEN doc_id % 8 = 0 THEN 'encrypted' WHEN length(t) // 100 > 60 THEN 'too many pages'
WHEN length(regexp_replace(t, '[^\\p{L}]', '', 'g')) < 200 THEN 'no text layer' END AS reason FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""))
def upload_admission(spark, sf_dir):
    """Documents as uploads, of which every ninth has no signature and every eighth is encrypted; 100 characters are a page."""
    i, content = F.col("doc_id"), F.coalesce("text", F.lit(""))
    letters = F.length(F.regexp_replace(content, r"[^\p{L}]", ""))
    uploads = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 9 == 0, content).otherwise(F.concat(F.lit("%PDF"), content)).cast("binary").alias("content"), (i % 8 == 0).alias("encrypted"),
        F.floor(F.length(content) / 100).alias("n_pages"), letters.alias("letters"),
    )
    return state.admission(uploads).select("doc_id", "reason")


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN w < 100 THEN 0 WHEN w < 200 THEN 100 WHEN w < 300 THEN 200 WHEN w < 400 THEN 300 WHEN w < 450 THEN 400 WHEN w < 513 THEN 450 END AS bucket
FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS w FROM documents)) GROUP BY bucket""")
def size_histogram(spark, sf_dir):
    """Words of documents as tokens of chunks."""
    return evaluate.size_histogram(table(spark, sf_dir, "documents").select(text.n_words(F.coalesce("text", F.lit(""))).alias("n_tokens")))


@query("SELECT conv_id, list_sort(list(length(text)))[count(text) // 2 + 1]::BIGINT AS middle FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def upper_medians(spark, sf_dir):
    """The middle length of each conversation's turns."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.groupBy("conv_id").agg(evaluate.upper_median(F.collect_list(F.length("text"))).cast("long").alias("middle"))


@query("""WITH p AS (SELECT doc_id % 150 AS doc, lang FROM documents WHERE lang IS NOT NULL), c AS (SELECT doc, lang, count(*) AS n FROM p GROUP BY ALL),
v AS (SELECT doc, arg_min(lang, (-n, lang)) AS voted FROM c GROUP BY doc)
SELECT doc, voted, CASE WHEN doc % 5 != 0 THEN 'en' END AS stated, voted IS NOT DISTINCT FROM CASE WHEN doc % 5 != 0 THEN 'en' END AS agrees FROM v""")
def layout_votes(spark, sf_dir):
    """Documents as pages of 150 papers, languages as layouts; the manifest says en, and nothing of every fifth paper."""
    pages = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).alias("doc"), F.col("doc_id").alias("page"), F.col("lang").alias("layout")).dropna()
    stated = spark.range(150).where("id % 5 != 0").select(F.col("id").alias("doc"), F.lit("en").alias("layout"))
    return reports.layout_votes(pages, stated)


@query(f"""WITH {LINES} SELECT doc, bool_or(line ILIKE '%th%' AND line_no % 2 = 0) AND bool_or(line ILIKE '%an%' AND line_no % 2 = 1) AS complete FROM lines GROUP BY doc""")
def core_sections(spark, sf_dir):
    """Lines as sections: even ones with th are abstracts, odd ones with an are conclusions."""
    lines, low = cleaning.lines_of(table(spark, sf_dir, "documents")), F.lower("line")
    even = F.col("line_no") % 2 == 0
    label = F.when(low.contains("th") & even, "abstract").when(low.contains("an") & ~even, "conclusion").otherwise("other")
    return reports.has_core_sections(lines.select("doc", label.alias("label")))


@query("SELECT event_id // 5 AS doc FROM events WHERE event_type IN ('click', 'error') GROUP BY event_id // 5 HAVING count(DISTINCT event_type) = 2")
def common_documents(spark, sf_dir):
    """Five events in a row are a document, types of events are parsers; two of them are compared."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("doc"), F.col("event_type").alias("parser"))
    return reports.common_documents(events, ["click", "error"])


@query("SELECT round(sum((length(text) + 9000) / 3.5), 4) AS tokens_in, count(*) * 350 AS tokens_out, round((sum((length(text) + 9000) / 3.5) * 3 + count(*) * 350 * 15) / 1e6 * 1.5, 8) AS cost FROM benchmark")
def cost_estimate(spark, sf_dir):
    found = reports.cost_estimate(questions(spark, sf_dir), 3.0, 15.0, 9000, judge=0.5)
    return found.select(F.round("tokens_in", 4).alias("tokens_in"), "tokens_out", F.round("cost", 8).alias("cost"))


@query(f"""WITH {LINES}, k AS (SELECT doc, line_no, line, CASE length(line) % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'table' ELSE 'text' END AS kind FROM lines),
t AS (SELECT *, coalesce(sum((kind = 'table')::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM k),
p AS (SELECT *, last_value(CASE WHEN kind = 'caption' THEN line END IGNORE NULLS) OVER (PARTITION BY doc, taken ORDER BY line_no) AS caption FROM t)
SELECT doc, line_no AS no, caption FROM p WHERE kind = 'table'""")
def pending_captions(spark, sf_dir):
    """Lines as captions, tables and texts by what their length leaves modulo 3."""
    left = F.length("line") % 3
    kind = F.when(left == 0, "caption").when(left == 1, "table").otherwise("text")
    blocks = cleaning.lines_of(table(spark, sf_dir, "documents")).select("doc", F.col("line_no").alias("no"), kind.alias("kind"), F.col("line").alias("text"))
    return long(sections.with_captions(blocks).select("doc", "no", "caption"), "no")


@query(f"""WITH {LINES}, e AS (SELECT doc, line_no // 8 AS page, line_no AS no, line || CASE WHEN line_no % 4 = 1 THEN ' (' || (line_no % 90 + 1) || ')' ELSE '' END AS text, length(line) % 3 != 0 AS equation FROM lines),
r AS (SELECT *, sum((NOT equation)::INT) OVER (PARTITION BY doc, page ORDER BY no) AS run FROM e),
g AS (SELECT doc, page, run, min(no) AS first, count(*) AS n, list(regexp_extract(text, '{mathtext.EQUATION_NUMBER}', 1) ORDER BY no) AS all_ FROM r WHERE equation GROUP BY doc, page, run),
f AS (SELECT *, list_filter(all_, lambda x: x <> '') AS q FROM g)
SELECT doc, page::BIGINT AS page, run::BIGINT AS run, first, n, CASE WHEN len(q) = 0 THEN '[equation omitted]' WHEN len(q) = 1 THEN '[equation (' || q[1] || ') omitted]' ELSE '[equations (' || q[1] || ')-(' || q[-1] || ') omitted]' END AS placeholder FROM f""")
def equation_runs(spark, sf_dir):
    """Eight lines are a page; those whose length isn't divisible by 3 are equations, every fourth numbered."""
    lines, no = cleaning.lines_of(table(spark, sf_dir, "documents")), F.col("line_no")
    number = F.when(no % 4 == 1, F.concat(F.lit(" ("), (no % 90 + 1).cast("string"), F.lit(")"))).otherwise("")
    blocks = lines.select("doc", F.floor(no / 8).alias("page"), no.alias("no"), F.concat("line", number).alias("text"), (F.length("line") % 3 != 0).alias("equation"))
    return long(sections.equation_runs(blocks), "page", "run", "first", "n")


BOXED = """b AS (SELECT vec_id, least(embedding[1], embedding[2])::DOUBLE AS ax0, greatest(embedding[1], embedding[2])::DOUBLE AS ax1, least(embedding[3], embedding[4])::DOUBLE AS ay0, greatest(embedding[3], embedding[4])::DOUBLE AS ay1,
least(embedding[5], embedding[6])::DOUBLE AS bx0, greatest(embedding[5], embedding[6])::DOUBLE AS bx1, least(embedding[7], embedding[8])::DOUBLE AS by0, greatest(embedding[7], embedding[8])::DOUBLE AS by1 FROM embeddings)"""


@query(f"""WITH {BOXED} SELECT vec_id, ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1 AS meet, (ax0 + ax1) / 2 BETWEEN bx0 - 0.05 AND bx1 + 0.05 AND (ay0 + ay1) / 2 BETWEEN by0 - 0.05 AND by1 + 0.05 AS inside,
round(CASE WHEN least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)) > 0 THEN greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) / least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)) ELSE 0 END, 6) AS share,
least(ax0, bx0) AS x0, least(ay0, by0) AS y0, greatest(ax1, bx1) AS x1, greatest(ay1, by1) AS y1 FROM b""")
def box_tests(spark, sf_dir):
    """Two boxes from a vector's first eight numbers: whether they meet, whether one's centre is in the other, the common share, and the box around both."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")

    def corners(i: int):
        low, high = (lambda j: F.least(at(j), at(j + 1))), (lambda j: F.greatest(at(j), at(j + 1)))
        return F.struct(low(i).alias("x0"), low(i + 2).alias("y0"), high(i).alias("x1"), high(i + 2).alias("y1"))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", corners(0).alias("a"), corners(4).alias("b"))
    a, b, around = F.col("a"), F.col("b"), mathtext.union_box(F.array("a", "b"))
    return rows.select("vec_id", mathtext.overlaps(a, b).alias("meet"), mathtext.centre_in(a, b, 0.05).alias("inside"), F.round(mathtext.overlap_ratio(a, b), 6).alias("share"), around.alias("u")).select("vec_id", "meet", "inside", "share", "u.*")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS norm, round(u[1], 5) AS head FROM (SELECT vec_id, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings))")
def unit_vectors(spark, sf_dir):
    """Vectors of three times their length, brought back to length 1."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mathtext.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.get("u", F.lit(0)).cast("double"), 5).alias("head"))


FIRST_PAGE = f"""{LINES}, spans AS (SELECT doc, line_no, trim(line) AS t, 8 + length(line) % 5 AS size FROM lines WHERE line_no < 5 AND trim(line) <> ''),
largest AS (SELECT doc, string_agg(t, ' ' ORDER BY line_no) AS big FROM (SELECT *, max(size) OVER (PARTITION BY doc) AS top FROM spans) WHERE size = top GROUP BY doc)"""


@query(f"""WITH {FIRST_PAGE}, m AS (SELECT doc_id, trim(regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'Untitled draft of ' || source WHEN 1 THEN coalesce(text, '') WHEN 2 THEN 'paper_1.tex' ELSE '' END, '\\s+', ' ', 'g')) AS stated, big,
  coalesce(lang, 'xx') || ' ' || doc_id || '.v1' AS stem, doc_id % 40 + 1990 AS y FROM documents LEFT JOIN largest ON doc = doc_id)
SELECT doc_id, CASE WHEN length(stated) >= 8 AND NOT regexp_matches(stated, '{uploads.NO_TITLE}') THEN left(stated, 200) WHEN length(big) >= 8 THEN left(trim(regexp_replace(big, '\\s+', ' ', 'g')), 200) ELSE stem END AS title,
  CASE WHEN doc_id % 3 = 0 THEN 'Unknown author' ELSE 'A. ' || doc_id || '|Brandt|C' END AS authors, CASE WHEN doc_id % 6 = 5 THEN 2024 ELSE y END AS year FROM m""")
def upload_metadata(spark, sf_dir):
    """Documents as uploads: every property is missing or useless in some, a text's first lines are spans whose size goes with their length."""
    i, content = F.col("doc_id"), F.coalesce("text", F.lit(""))
    meta = F.when(i % 4 == 0, F.concat(F.lit("Untitled draft of "), "source")).when(i % 4 == 1, content).when(i % 4 == 2, "paper_1.tex").otherwise("")
    spans = F.transform(F.split(content, "\n"), lambda t, n: F.struct(t.alias("text"), (8 + F.length(t) % 5).cast("double").alias("size"), (n * 10).alias("y")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("up/"), F.coalesce("lang", F.lit("xx")), F.lit("_"), i.cast("string"), F.lit(".v1.pdf")).alias("filename"), meta.alias("meta_title"),
        F.when(i % 3 != 0, F.concat(F.lit("A. "), i.cast("string"), F.lit(" and Brandt; , C"))).alias("meta_author"),
        F.when(i % 6 != 5, F.concat(F.lit("D:"), (i % 40 + 1990).cast("string"), F.lit("0101"))).otherwise("2001").alias("created"), spans.alias("spans"), F.lit(100).alias("height"),
    )
    return uploads.described(rows, F.lit("2024-06-01").cast("timestamp")).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "year")


@query("""SELECT doc_id, CASE WHEN len(l) > 1 AND (regexp_full_match(f, '(Table|TABLE)\\s+\\S+[.:]?') OR (regexp_matches(trim(l[2]), '^\\p{Ll}') AND length(f) > 40)) THEN 2 ELSE 1 END AS n FROM
(SELECT doc_id, l, CASE WHEN doc_id % 4 = 0 THEN 'TABLE II.' ELSE trim(l[1]) END AS f FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN lower(coalesce(text, '')) ELSE coalesce(text, '') END, chr(10)) AS l FROM documents))""")
def caption_lines(spark, sf_dir):
    """Documents as caption blocks: every fourth begins with a bare label, every third is in lower case."""
    i, content = F.col("doc_id"), F.coalesce("text", F.lit(""))
    lines = F.split(F.when(i % 3 == 0, F.lower(content)).otherwise(content), "\n")
    lines = F.transform(lines, lambda t, n: F.when((i % 4 == 0) & (n == 0), "TABLE II.").otherwise(t))
    return table(spark, sf_dir, "documents").select("doc_id", layout.caption_lines(lines).alias("n"))


@query(f"""WITH {LINES}, b AS (SELECT doc, line_no // 12 AS page, line_no AS no, line_no % 12 * 20.0 + length(line) % 7 AS y0, line_no % 12 * 20.0 + length(line) % 7 + 10 AS y1, line_no % 5 AS kind FROM lines),
n AS (SELECT t.doc, t.no, c.no AS caption_no, least(abs(t.y0 - c.y1), abs(c.y0 - t.y1)) AS gap FROM b t JOIN b c ON t.doc = c.doc AND t.page = c.page AND t.kind = 0 AND c.kind = 3),
m AS (SELECT doc, no, arg_min(caption_no, (gap, caption_no)) AS caption_no FROM n WHERE gap < 40 GROUP BY doc, no)
SELECT b.doc, b.page::BIGINT AS page, b.no, m.caption_no, 'Table ' || m.caption_no || '. Lines' AS caption FROM b LEFT JOIN m USING (doc, no) WHERE kind = 0""")
def nearby_captions(spark, sf_dir):
    """Twelve lines are a page; of five lines the first is a table and the fourth a caption."""
    no = F.col("line_no")
    y = (no % 12 * 20 + F.length("line") % 7).cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 10).alias("y1"))
    says = F.when(no % 5 == 3, F.concat(F.lit("Table "), no.cast("string"), F.lit(". Lines"))).otherwise(F.concat(F.lit("- "), "line"))
    rows = cleaning.lines_of(table(spark, sf_dir, "documents")).select("doc", F.floor(no / 12).alias("page"), no.cast("long").alias("no"), F.lit("text").alias("kind"), says.alias("text"), box.alias("box"), (no % 5 == 0).alias("is_table"))
    return layout.nearby_captions(rows.where("is_table").select("doc", "page", "no", "box"), rows.where("NOT is_table")).drop("box")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a question with itself as its passage; collections go by its number."""
    i = F.col("qid")
    searched = F.when(i % 4 == 1, F.array(F.lit("user"))).when(i % 4 == 2, F.array(F.lit("user"), F.lit("core"))).when(i % 4 == 3, F.array(F.lit("core")))
    return questions(spark, sf_dir).select(
        "qid", "question", F.when(i % 6 == 0, "unanswerable").otherwise("factoid").alias("type"), F.col("question").alias("gold"), F.concat(F.lit("[1] "), "question").alias("context"), searched.alias("collections"),
        F.lit(1).alias("n_passages"), F.array(F.when(i % 5 == 0, "not in any text").otherwise(F.col("question"))).alias("must_include"), F.lit(False).alias("no_metric"),
    )


@query("""SELECT item_id AS qid, CASE item_id % 4 WHEN 1 THEN 'Scope: documents the user uploaded (ids u01, u02, ...), not the 19 core papers.' || chr(10) || chr(10)
WHEN 2 THEN 'Scope: the 19 core papers plus documents the user uploaded (ids u..).' || chr(10) || chr(10) ELSE '' END || 'Passages:' || chr(10) || chr(10) || '[1] ' || text || chr(10) || chr(10) || 'Question: ' || text AS message FROM benchmark""")
def answer_messages(spark, sf_dir):
    return answers.messages(_asked(spark, sf_dir)).select("qid", "message")


@query("""SELECT item_id AS qid, item_id % 6 = 0 AS refused, item_id % 6 = 0 OR item_id % 5 != 0 AS auto_pass, 2 AS correctness, 2 AS faithfulness, 0.00975 AS cost, 0.00725 AS judge_cost FROM benchmark""")
def answer_run(spark, sf_dir):
    """A dry run over all items: those whose asked string is in no text fail their checks."""
    rows = answers.run(_asked(spark, sf_dir), {"dry": (1.0, 15.0)})
    return rows.select("qid", "refused", "auto_pass", "correctness", "faithfulness", F.round("cost", 8).alias("cost"), F.round("judge_cost", 8).alias("judge_cost"))
