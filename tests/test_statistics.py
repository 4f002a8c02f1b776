"""Matching statistics and global maximality without a window over a whole query, against plain search."""

import random

from pyspark.sql import functions as F

from gramweave.operators import mem
from gramweave.sources.texts import carried


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def brute(docs, queries, k):
    out = set()
    for q, text in queries:
        for i in range(len(text or "")):
            best = max(((n, -doc, -x) for doc, t in docs for x in range(len(t or "")) for n in [next((n for n in range(min(len(t) - x, len(text) - i) + 1) if n == min(len(t) - x, len(text) - i) or t[x + n] != text[i + n]), 0)]), default=(0, 0, 0))
            if best[0] >= k:
                out.add((q, i, best[0], -best[1], -best[2]))
    return out


def test_carried(spark):
    r = random.Random(1)
    rows = [(g, i, r.randrange(50)) for g in range(3) for i in range(60)]
    frame = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    for how, plain in ((F.max, max), (F.min, min)):
        got = {(x.g, x.i): x.p for x in carried(frame, ["g"], ["i"], F.col("v"), how, "p").collect()}
        assert got == {(g, i): plain((w for h, j, w in rows if h == g and j < i), default=None) for g, i, _ in rows}


def test_statistics_of_random_texts(spark):
    r = random.Random(2)
    docs = [(j, "".join(r.choice("ab") for _ in range(r.randrange(25)))) for j in range(12)] + [(90, None), (91, "")]
    queries = [(j, "".join(r.choice("ab") for _ in range(r.randrange(25)))) for j in range(12)] + [(90, None), (91, ""), (92, "a" * 20)]
    for k in (1, 4):
        assert {tuple(x) for x in mem.matching_statistics(*frames(spark, docs, queries), k).collect()} == brute(docs, queries, k)


def test_a_query_of_a_million_characters_is_many_tasks(spark):
    """Each place of the query has its match; the running maxima are taken in ranges, none of which holds the query."""
    r = random.Random(3)
    piece = ["".join(r.choice("abcdefgh") for _ in range(5000)) for _ in range(200)]
    docs, queries = frames(spark, list(enumerate(piece)), [(0, "#".join(piece))])
    found = mem.matching_statistics(docs, queries, 20)
    row = found.agg(F.count("*"), F.sum("ms"), F.max("ms"), F.countDistinct("doc_id")).first()
    assert tuple(row) == (200 * 4981, 200 * (5000 + 20) * 4981 // 2, 5000, 200)
    assert "Window [" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and all("__part" in x for x in plan.split("\n") if "Window" in x and "windowspecdefinition" in x)
    assert mem.mems_asymmetric(docs, queries, 20, boundary="open").count() == 200
