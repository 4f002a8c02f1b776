"""Suffix order, vectors and graphs: published values, and random texts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gramweave.operators import graph, suffix, vectors

GOLDEN = {
    "abcdabcdabcdabcdhello": ([21, 0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11, 15, 17, 16, 18, 19, 20], "o$dddaaaabbbbcccchdell", 10, 11),
    "AAAATGCCGCCGCCATAAA": ([19, 18, 17, 16, 0, 1, 2, 14, 3, 13, 12, 9, 6, 10, 7, 11, 8, 5, 15, 4], "AAAT$AACACGGGCCCCTAA", 11, 10),
    "aaaaabbbbbaaaaa": ([15, 14, 13, 12, 11, 10, 0, 1, 2, 3, 4, 9, 8, 7, 6, 5], "aaaaab$aaaabbbba", 6, 6),
}


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(9)
    rows = [(i, t) for i, t in enumerate(GOLDEN)] + [(10 + i, "".join(r.choice("abé"[: 1 + i % 3]) for _ in range(r.randrange(0, 25)))) for i in range(12)] + [(50, None), (51, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def order(t):
    return sorted(range(len(t) + 1), key=lambda i: t[i:])


@pytest.mark.parametrize("short", [0, 12, 400])
def test_suffix_array(texts, short):
    frame, text = texts
    found = {}
    for r in suffix.suffix_array(frame, short).collect():
        found.setdefault(r.doc_id, {})[r.rank] = r.sa
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: order(t) for k, t in text.items() if t is not None}
    for i, (sa, *_) in enumerate(GOLDEN.values()):
        assert [found[i][j] for j in range(len(sa))] == sa


def test_a_long_periodic_text(spark):
    frame = spark.createDataFrame([(1, "ab" * 2000 + "c")], "doc_id long, text string")
    got = [r.sa for r in suffix.suffix_array(frame).orderBy("rank").collect()]
    assert got == order("ab" * 2000 + "c")


def test_orders(texts):
    frame, text = texts
    text = {k: t for k, t in text.items() if t is not None}
    sa = {k: order(t) for k, t in text.items()}
    rank = {k: {p: i for i, p in enumerate(v)} for k, v in sa.items()}
    rows = suffix.bwt(frame).select("doc_id", "rank", suffix.shown(F.col("ch")).alias("ch")).collect()
    found = {k: "".join(c for _, c in sorted((r.rank, r.ch) for r in rows if r.doc_id == k)) for k in text}
    assert found == {k: "".join((t[p - 1] if p else "$") for p in sa[k]) for k, t in text.items()}
    assert [found[i] for i in range(3)] == [g[1] for g in GOLDEN.values()]
    assert {(r.doc_id, r.rank, r.lf) for r in suffix.lf_mapping(frame).collect()} == {(k, i, rank[k][p - 1] if p else 0) for k, v in sa.items() for i, p in enumerate(v)}
    assert {(r.doc_id, r.fl, r.rank) for r in suffix.fl_mapping(frame).collect()} == {(r.doc_id, r.rank, r.lf) for r in suffix.lf_mapping(frame).collect()}
    phi = {(r.doc_id, r.sa): (r.phi, r.phi_inv) for r in suffix.phi(frame).collect()}
    assert phi == {(k, p): (v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None) for k, v in sa.items() for i, p in enumerate(v)}
    assert [phi[0, x][0] for x in (0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7)] == [21, 0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3]
    plcp = {(r.doc_id, r.sa): r.plcp for r in suffix.plcp(frame).collect()}
    assert [plcp[2, i] for i in range(16)] == [5, 4, 3, 2, 1, 4, 3, 2, 1, 0, 4, 3, 2, 1, 0, 0]
    assert [plcp[1, i] for i in range(20)] == [3, 3, 2, 2, 1, 6, 5, 4, 3, 2, 1, 0, 1, 0, 1, 0, 2, 1, 0, 0]
    stats = {r.doc_id: r for r in suffix.index_stats(frame).collect()}
    assert [(stats[i].r, stats[i].r_rev) for i in range(3)] == [g[2:] for g in GOLDEN.values()]
    assert all((stats[k].n, stats[k].sigma) == (len(t), len(set(t)) + 1) for k, t in text.items())
    runs = suffix.bwt_runs(frame).where("doc_id = 0").orderBy("run_id").collect()
    assert "".join(r.head * r.len for r in runs) == GOLDEN["abcdabcdabcdabcdhello"][1]
    assert [(r.first_sa, r.last_sa) for r in runs] == [(sa[0][r.start], sa[0][r.start + r.len - 1]) for r in runs]
    ranges = {(r.doc_id, r.ch): (r.lo, r.hi) for r in suffix.char_range(frame).collect()}
    assert ranges == {(k, c): (min(i for i, p in enumerate(sa[k]) if t[p : p + 1] == c), max(i for i, p in enumerate(sa[k]) if t[p : p + 1] == c)) for k, t in text.items() for c in set(t)}


def test_prefixes_from_ranks(spark, texts):
    frame, text = texts
    by_text = {(r.doc_id, r.sa): r.plcp for r in suffix.plcp(frame).collect()}
    assert {(r.doc_id, r.sa): r.plcp for r in suffix.plcp(frame, short=0).collect()} == by_text
    n = 3000
    long = spark.createDataFrame([(1, "a" * n), (2, "ab" * 700 + "c" + "ab" * 650)], "doc_id long, text string")
    found = {(r.doc_id, r.sa): r.plcp for r in suffix.plcp(long).collect()}
    assert [found[1, i] for i in range(n + 1)] == [*(n - 1 - i for i in range(n)), 0]
    t = "ab" * 700 + "c" + "ab" * 650
    sa = order(t)
    shared = lambda a, b: next((k for k in range(len(t)) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or a + k >= len(t) or b + k >= len(t)), len(t))
    assert all(found[2, b] == shared(a, b) for a, b in zip(sa[::7], sa[1::7]))


def test_a_step_back(spark, texts):
    frame, text = texts
    t = text[0]
    lo, hi = min(i for i, p in enumerate(order(t)) if t[p:].startswith("bc")), max(i for i, p in enumerate(order(t)) if t[p:].startswith("bc"))
    got = suffix.lf_range(frame, spark.createDataFrame([(0, lo, hi, "a"), (0, lo, hi, "x")], "doc_id long, lo long, hi long, c string")).collect()
    want = [i for i, p in enumerate(order(t)) if t[p:].startswith("abc")]
    assert [(r.c, r.lo2, r.hi2) for r in got] == [("a", want[0], want[-1])]


def test_bits(spark):
    bits = spark.range(10_000).select(F.lit(0).alias("vec"), F.col("id").alias("pos"), F.col("id").isin(0, 5000).cast("int").alias("bit"))
    bits = bits.unionByName(spark.range(100).select(F.lit(1).alias("vec"), F.col("id").alias("pos"), F.lit(1).alias("bit"))).unionByName(spark.range(50).select(F.lit(2).alias("vec"), F.col("id").alias("pos"), F.lit(0).alias("bit")))
    got = {r.pos: r for r in vectors.bit_predecessor(bits).where("vec = 0").collect()}
    assert got[0].predecessor is None and got[0].circular_rank == 1
    assert all(got[i].predecessor == (0 if i <= 5000 else 5000) for i in range(1, 10_000))
    assert [(r.k, r.pos, r.gap) for r in vectors.bit_select(bits).where("vec = 0").orderBy("k").collect()] == [(0, 0, 1), (1, 5000, 5000)]
    assert all(r.rank == r.pos for r in vectors.bit_rank(bits).where("vec = 1").collect())
    assert {r.rank for r in vectors.bit_rank(bits).where("vec = 2").collect()} == {0}


def no_broadcast(rows):
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_characters_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """What is exploded from a small file looks small to Spark and is large."""
    spark.range(2000).select("id", F.lit("abracadabra").alias("text")).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names")).withColumnRenamed("id", "doc_id")
    chars = names.select(F.col("doc_id").alias("vec"), F.posexplode(F.split("text", "")).alias("pos", "ch"))
    no_broadcast(vectors.char_rank_select(chars))
    no_broadcast(vectors.bit_predecessor(chars.select("vec", "pos", (F.col("ch") == "a").cast("int").alias("bit"))))
    for job in (suffix.bwt, suffix.bwt_runs, suffix.lf_mapping, suffix.fl_mapping, suffix.index_stats, suffix.plcp):
        no_broadcast(job(names))


def test_columns_come_from_the_row_of_their_text(spark):
    """No task gathers the characters of many texts to count them."""
    odd = ["", "a", "zz\n\U0001f600z", "\U0001f600\uffff\x00$", "ab" * 300]
    frame = spark.createDataFrame([*enumerate(odd), (9, None)], "doc_id long, text string")
    for job in (suffix.f_column, suffix.char_range):
        plan = job(frame)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    got = sorted((r.doc_id, r.ch.encode(), r.n, r["first"]) for r in suffix.f_column(frame).collect())
    want = [(i, c.encode(), max(1, t.count(c) if c else 1), sum(x < c for x in t) + (c != "")) for i, t in enumerate(odd) for c in {"", *t}]
    assert got == sorted(want)
    for i, t in enumerate(odd):
        at = sorted(range(len(t) + 1), key=lambda p: t[p:])
        lf = {r["rank"]: r.lf for r in suffix.lf_mapping(frame.where(F.col("doc_id") == i)).collect()}
        assert lf == {rank: at.index(p - 1) if p else 0 for rank, p in enumerate(at)}
    assert suffix.lf_mapping(frame.where("doc_id = 9")).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_characters_and_runs(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    chars = spark.range(10_000).select(F.lit(0).alias("vec"), F.col("id").alias("pos"), F.when(F.col("id") % 200 < 100, "a").otherwise("b").alias("ch"))
    ranks = {(r.ch, r.pos): r.k for r in vectors.char_rank_select(chars).collect()}
    assert ranks["a", 0] == 0 and ranks["b", 100] == 0 and ranks["a", 9899] == 4999
    runs = vectors.runs(chars)
    assert sorted((r.run_id, r.head, r.start, r.len) for r in runs.collect()) == [(i, "ab"[i % 2], 100 * i, 100) for i in range(100)]
    assert all(r.run_id == r.pos // 100 and r.last == r.pos // 100 * 100 + 99 for r in vectors.run_of(runs, chars.select("vec", "pos")).collect())
    assert {r.run_id: r["rank"] for r in vectors.run_rank(runs).collect()} == {i: i // 2 * 100 for i in range(100)}
    assert vectors.run_text(runs).first().text == ("a" * 100 + "b" * 100) * 50


NODES, LINKS = [(1, "ACGT"), (2, "GG"), (3, "CC"), (4, "TACG")], [(1, 2), (1, 3), (2, 4), (3, 4)]


def test_graph(spark):
    nodes = spark.createDataFrame(NODES, "node_id int, label string")
    links = spark.createDataFrame([(a, False, b, False) for a, b in LINKS], "src int, src_rev boolean, dst int, dst_rev boolean")
    query = spark.createDataFrame([(0, "#CGTGGTAC#AGTCCTAA#")], "query_id long, text string")
    string = lambda rows: sorted((tuple(r.ids), r.lctx + ">".join(r.parts) + r.rctx) for r in rows.collect())
    assert [x for _, x in string(graph.graph_units(nodes, links, "nodes"))] == ["NACGT$", "TGGT", "TCCT", "NTACG$"]
    assert [x for _, x in string(graph.graph_units(nodes, links, "edges"))] == ["NACGT>GGT", "NACGT>CCT", "TGG>TACG$", "TCC>TACG$"]
    assert [x for x, _ in string(graph.graph_units(nodes, links, "paths"))] == [(1, 2, 4), (1, 3, 4)]
    found = lambda kind, compat=False: sorted((tuple(r.ids), r.unit_off, r.i, r.d, r.text) for r in graph.graph_mems(graph.graph_units(nodes, links, kind, compat), query, 3, "ACGT", "ACGTN#").collect())
    assert found("nodes") == [((4,), 0, 6, 3, "TAC")]
    assert found("edges") == [((1, 3), 1, 1, 3, "CGT"), ((3, 4), 2, 6, 3, "TAC")]
    assert found("paths") == [((1, 2, 4), 1, 1, 8, "CGTGGTAC"), ((1, 3, 4), 2, 11, 6, "GTCCTA")]
    assert [x for _, x in string(graph.graph_units(nodes, links, "nodes", True))] == ["NACGT$", "NGG$", "TCCT", "TTACGT"]
    assert len(string(graph.graph_units(nodes, links, "paths", True))) == 16
    assert found("nodes", True) == found("nodes") and found("edges", True) == found("edges")
    assert found("paths", True) == [((1, 2, 1), 1, 1, 5, "CGTGG"), ((1, 2, 4), 1, 1, 8, "CGTGGTAC"), ((1, 3, 1), 2, 11, 4, "GTCC"), ((1, 3, 4), 2, 11, 6, "GTCCTA"), ((4, 2, 4), 4, 4, 5, "GGTAC"), ((4, 3, 4), 4, 13, 4, "CCTA")]
    units = graph.unit_offsets(graph.graph_units(nodes, links, "nodes"))
    assert [r.offset for r in units.orderBy("ids").collect()] == [2, 9, 14, 19]
    edges = graph.graph_mems(graph.graph_units(nodes, links, "edges"), query, 3, "ACGT", "ACGTN#")
    texts = graph.unit_texts(graph.graph_units(nodes, links, "nodes"))
    assert [r.text for r in graph.only_in(edges, texts).collect()] == ["CGT", "TAC"] or sorted(r.text for r in graph.only_in(edges, texts).collect()) == ["CGT", "TAC"]
    assert graph.only_in(edges, texts, inside=False).count() == 0


def test_asymmetric_graph_matches(spark):
    nodes = spark.createDataFrame(NODES, "node_id int, label string")
    links = spark.createDataFrame([(a, False, b, False) for a, b in LINKS], "src int, src_rev boolean, dst int, dst_rev boolean")
    query = "#CGTGGTAC#AGTCCTAA#"
    frame = spark.createDataFrame([(0, query)], "query_id long, text string")
    for kind in ("nodes", "edges", "paths"):
        units = graph.graph_units(nodes, links, kind)
        want = set()
        for r in units.collect():
            t = r.lctx + "".join(r.parts) + r.rctx
            for x in range(1, len(t)):
                d = 0
                while x + d < len(t) and t[x : x + d + 1] in query:
                    d += 1
                # maximal to the right over all characters; then core, and neighbours of the context
                if d >= 3 and t[x - 1 : x + d] not in query and x + d < len(t) and set(t[x : x + d]) <= set("ACGT") and t[x - 1] in "ACGTN#" and t[x + d] in "ACGTN#":
                    want.add((tuple(r.ids), x - 1, d, t[x : x + d]))
        found = graph.graph_mems_asymmetric(units, frame, 3, "ACGT", "ACGTN#").collect()
        assert {(tuple(r.ids), r.unit_off, r.d, r.text) for r in found} == want and len(found) == len(want)
        assert all(query[r.i : r.i + r.d] == r.text for r in found)


def test_reverse_orientation(spark):
    row = spark.range(1).select(graph.oriented(F.lit("ACGN"), F.lit(True)), graph.oriented(F.lit("AC"), F.lit(True), True)).first()
    assert tuple(row) == ("NCGT", "AC_rev")
