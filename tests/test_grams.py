"""Grams that texts share with queries, found by scanning, against plain loops and against the joins that larger queries take."""

import random

import pytest

from gramweave.operators import grams, mem, repeats


def rows(spark):
    rng = random.Random(3)
    some = lambda n, of: "".join(rng.choices(of, k=n))
    docs = [(n, some(rng.choice([0, 1, 5, 40, 300]), "abß\0𝄞")) for n in range(30)] + [(30, None), (31, "a" * 90), (32, some(700, "abc"))]
    asks = [(n, some(rng.choice([3, 30, 60]), "abß\0𝄞")) for n in range(8)] + [(8, None), (9, ""), (10, "a" * 30), (11, docs[32][1][200:260])]
    return docs, asks, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asks, "query_id int, text string")


@pytest.mark.parametrize(("k", "core"), [(1, "ab"), (6, None), (7, "aß\0"), (12, None), (20, "abc")])
def test_scan_and_join_give_the_same_islands(spark, monkeypatch, k, core):
    docs, asks, t, q = rows(spark)
    want = set()
    for d, a in docs:
        for n, b in asks:
            for x in range(len(a or "")):
                for i in range(len(b or "")):
                    if (x and i and a[x - 1] == b[i - 1] and (core is None or a[x - 1] in core)) or a[x] != b[i]:
                        continue
                    size = 0
                    while x + size < len(a) and i + size < len(b) and a[x + size] == b[i + size] and (core is None or a[x + size] in core):
                        size += 1
                    if size >= k:
                        want.add((d, n, x, i, size))
    for together in (1 << 20, 100):  # texts in one part and in several
        monkeypatch.setattr(grams, "TOGETHER", together)
        got = [tuple(r) for r in mem.islands(t, q, k, core).select("doc_id", "query_id", "x", "i", "d").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(grams, "small", lambda *_: False)
    assert {tuple(r) for r in mem.islands(t, q, k, core).select("doc_id", "query_id", "x", "i", "d").collect()} == want


def test_hits_that_are_no_match_stay_in_their_task(spark):
    """A word of w characters in all texts and queries is no match of w + s - 1, so nothing of it is shuffled."""
    t = spark.createDataFrame([(n, f"{n}seven77{n}") for n in range(10)], "doc_id long, text string")
    q = spark.createDataFrame([(n, f"<seven77>{n}") for n in range(10)], "query_id long, text string")
    assert grams.hits(t, q, 7, 6).count() == 0


def test_places_that_queries_know(spark, monkeypatch):
    docs, asks, t, q = rows(spark)
    of = {b[i : i + 5] for _, b in asks for i in range(len(b or "") - 4)}
    want = sorted((d, x, a[x : x + 5], a[x - 1] if x else "") for d, a in docs for x in range(len(a or "") - 4) if a[x : x + 5] in of)
    for together in (1 << 20, 20):
        monkeypatch.setattr(grams, "TOGETHER", together)
        assert sorted(tuple(r) for r in grams.known(t, q, 5).collect()) == want
    met = [sorted(tuple(r) for r in repeats.class_pairs(t, q, 5).collect())]
    monkeypatch.setattr(grams, "small", lambda *_: False)
    assert met == [sorted(tuple(r) for r in repeats.class_pairs(t, q, 5).collect())]


@pytest.mark.parametrize("core", [None, "ab"])
def test_longest_match_by_scan_and_by_join(spark, monkeypatch, core):
    docs, asks, t, q = rows(spark)
    ok = lambda x: core is None or all(c in core for c in x)
    longest = lambda a: max((n for n in range(len(a) + 1) for x in range(len(a) - n + 1) if ok(a[x : x + n]) and any(a[x : x + n] in (b or "") for _, b in asks)), default=0)
    some = [r for r in docs if len(r[1] or "") <= 90]
    t = t.where("doc_id in ({})".format(",".join(str(d) for d, _ in some)))
    want = {d: longest(a or "") for d, a in some}
    for together in (1 << 20, 30):
        monkeypatch.setattr(grams, "TOGETHER", together)
        assert {r.doc_id: r.d for r in mem.longest_match(t, q, core, wide=4).collect()} == want
    assert {r.doc_id: r.d for r in mem.longest_match(t, q, core).collect()} == want
    monkeypatch.setattr(grams, "small", lambda *_: False)
    assert {r.doc_id: r.d for r in mem.longest_match(t, q, core, wide=4).collect()} == want


def test_two_grams_with_one_hash(monkeypatch):
    """Where hashes tell nothing apart, the characters do."""
    monkeypatch.setattr(grams, "rolling", lambda text, widths: {w: grams.np.zeros(max(0, len(text) - w + 1), "u8") for w in widths})
    own = grams.np.append(grams.codes("abcab"), grams.np.uint32(grams.APART))
    assert grams.Grams(own, 2).known(grams.codes("xbcxabxx")).tolist() == [1, 4]
