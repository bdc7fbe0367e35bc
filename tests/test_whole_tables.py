"""Queries that SQL can't express, against plain loops over the same whole tables."""

import math
import re
from collections import Counter, defaultdict

import regex

from lexiforge.functions import text, udfs
from lexiforge.plans.queries import QUERIES


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def common_length(a, b):
    """Longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def alike(a, b):
    at_most = sum((Counter(a) & Counter(b)).values())  # no common subsequence is longer
    return 200 * at_most > 95 * (len(a) + len(b)) and 200 * common_length(a, b) > 95 * (len(a) + len(b))


def test_near_dup_lines(spark, sf_dir):
    want = {}
    for r in rows_of(spark, sf_dir, "documents"):
        lines, kept, last = (r.text or "").split("\n"), [], None
        for line in lines:
            if last is None or len(line.strip()) < 15 or not alike(line.strip(), last):
                kept.append(line)
                last = line.strip()
        want[r.doc_id] = (len(lines), len(kept), "\n".join(kept))
    found = {r.doc: (r.n_lines, r.n_kept, r.text) for r in QUERIES["near_dup_lines"](spark, sf_dir).collect()}
    assert found == want and any(n > k for n, k, _ in want.values())


def test_bm25_stemmed(spark, sf_dir):
    def words(t):
        return regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower())

    stems = {}

    def stem(w):
        if w not in stems:
            stems[w] = udfs.stem_word(w)
        return stems[w]

    docs = {r.doc_id: [stem(w) for w in words(r.text)] for r in rows_of(spark, sf_dir, "documents")}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    counts = {i: Counter(d) for i, d in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for q in rows_of(spark, sf_dir, "benchmark"):
        score = defaultdict(float)
        for w in dict.fromkeys(w for w in words(q.text) if w not in text.STOP_WORDS):
            t = stem(w)
            idf = max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
            for i, c in counts.items():
                if c[t]:
                    score[i] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:10]
        want |= {(q.item_id, k): -s for k, (s, _) in enumerate(best, 1)}
    found = {(r.qid, r.rank): r.score for r in QUERIES["bm25_stemmed"](spark, sf_dir).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=2e-6) for k in want)


def test_dehyphenate(spark, sf_dir):
    """Pairs of a word's halves over a line's end are looked up one by one."""
    want = {}
    for r in rows_of(spark, sf_dir, "documents"):
        lines = [x.strip() for x in (r.text or "").split("\n")]
        whole = " ".join((r.text or "").split("\n")).lower()
        known, compounds = re.findall("[a-z]+", whole), re.findall("[a-z]+-[a-z]+", whole)
        out = ""
        for line in [x for x in lines if x]:
            tail, head = re.search("([A-Za-z]+)-$", out), re.match("[a-z]+", line)
            if tail and head:
                a, b = tail[1].lower(), head[0].lower()
                both = known.count(a) > 1 and known.count(b) > 1
                stays = a + b not in known and (f"{a}-{b}" in compounds or both)
                out = (out if stays else out[:-1]) + line
            else:
                out = f"{out} {line}" if out else line
        want[r.doc_id] = out
    found = {r[0]: r["text"] for r in QUERIES["dehyphenate"](spark, sf_dir).collect()}
    assert found == want
