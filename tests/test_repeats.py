"""Maximal repeats and what they are made of, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from gramweave.operators import repeats


def brute(docs, k):
    places = {}
    for _, t in docs:
        for p in range(len(t or "")):
            for e in range(p + k, len(t) + 1):
                places.setdefault(t[p:e], []).append((t[p - 1] if p else None, t[e] if e < len(t) else None))
    differ = lambda chars: len(set(chars)) > 1 or chars[0] is None
    return {(w, len(w), len(at)) for w, at in places.items() if len(at) > 1 and differ([a for a, _ in at]) and differ([b for _, b in at])}


@pytest.mark.parametrize(("seed", "k", "letters"), [(1, 2, "ab"), (2, 3, "abc")])
def test_random_texts(spark, seed, k, letters):
    r = random.Random(seed)
    docs = [(j, "".join(r.choice(letters) for _ in range(r.randrange(30)))) for j in range(12)]
    docs += [(50, docs[3][1]), (51, docs[3][1]), (60, None), (61, ""), (62, letters[0] * 23), (63, "x" + docs[4][1] + "ä𝄞"), (64, "y" + docs[4][1] + "ä𝄞")]
    found = [tuple(x) for x in repeats.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(docs, k)


def test_long_repeats(spark):
    """Copies of a text of many blocks, one of them cut short and one changed in the middle."""
    r = random.Random(5)
    whole = "".join(r.choice("abcdefghijklmnop") for _ in range(5000))
    docs = [(0, whole), (1, "#" + whole[:4000]), (2, whole[:2500] + "?" + whole[2501:])]
    found = {(x.d, x.n_occ, x.text == whole[: x.d] or x.text == whole[-x.d :]) for x in repeats.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 20).collect()}
    assert found == {(4000, 2, True), (2500, 3, True), (2499, 2, True), (1499, 3, False)}
    assert repeats.maximal_repeats(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), 20).count() == 0


@pytest.mark.parametrize("together", [3, 1024])
def test_nearest_smaller_values(spark, together):
    r = random.Random(6)
    values = [r.choice([0, 1, 2, 3, 9]) for _ in range(60)] + [5] * 20 + [7] * 20 + [0]
    frame = spark.createDataFrame(list(enumerate(values)), "n long, l long").repartition(3)
    got = {tuple(x) for x in repeats.nearest_smaller(frame, together).collect()}
    lo = lambda n: next((j for j in range(n - 1, -1, -1) if values[j] < values[n]), -1)
    hi = lambda n: next((j for j in range(n + 1, len(values)) if values[j] < values[n]), len(values))
    assert got == {(n, v, lo(n), hi(n)) for n, v in enumerate(values) if v}


def test_ranks_of_keys_that_lie_in_many_ranges(spark):
    r = random.Random(7)
    rows = [(r.choice([1, 5, 5, 5, 5, 8]), j) for j in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeats.ranked(spark.createDataFrame(rows, "k long, j long").repartition(4), ["k"], ["j"], "r").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows)
    assert sorted((x.k, x.j, x.r, x.r_at) for x in got) == [(k, j, sum(o < k for o, _ in rows), order.index((k, j))) for k, j in order]


def test_matches_by_context_classes(spark):
    from gramweave.operators import mem

    r = random.Random(8)
    docs = [(j, "".join(r.choice("ab") for _ in range(r.randrange(25)))) for j in range(15)] + [(90, None), (91, ""), (92, "ä𝄞b" * 40)]
    queries = [(j, "".join(r.choice("ab") for _ in range(r.randrange(25)))) for j in range(15)] + [(90, None), (91, ""), (92, "𝄞bä𝄞b")]
    t, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(tuple(x) for x in repeats.mems_by_context(t, q, 3).collect())
    assert got == sorted(tuple(x) for x in mem.mems(t, q, 3, boundary="open").collect()) and len(got) > 500


def test_one_repeated_character_costs_its_matches(spark):
    """3000 and 2000 places of one string are 6 million pairs; there are as many matches as diagonals, and no other pair is made."""
    t, q = spark.createDataFrame([(0, "a" * 3019)], "doc_id long, text string"), spark.createDataFrame([(0, "a" * 2019)], "query_id long, text string")
    assert repeats.class_pairs(t, q, 20).count() == 3000 + 2000 - 1
    found = repeats.mems_by_context(t, q, 20).agg(F.count("*"), F.sum("d"), F.max("d")).first()
    assert tuple(found) == (4999, sum(min(3019 - x, 2019) for x in range(3000)) + sum(2019 - i for i in range(1, 2000)), 2019)


def test_only_what_both_sides_share_is_told_apart(spark, monkeypatch):
    """Copies of a long text share far more than a query has; no round of doubling is spent on them."""
    rng = random.Random(9)
    long, asked = "".join(rng.choices("abcdefgh", k=6000)), "".join(rng.choices("abcdefgh", k=60))
    docs = spark.createDataFrame([(n, long[:500] + asked + long[500:]) for n in range(3)], "doc_id long, text string")
    query = spark.createDataFrame([(7, "zz" + asked + "zz")], "query_id long, text string")
    levels, own = [], repeats.levels_of
    monkeypatch.setattr(repeats, "levels_of", lambda *a: levels.extend(own(*a)) or levels)
    assert {tuple(x) for x in repeats.mems_by_context(docs, query, 20).collect()} == {(n, 7, 500, 2, 60) for n in range(3)}
    assert [h for h, _ in levels] == [20, 40, 80]


@pytest.mark.parametrize("many", [1, 3])
def test_groups_of_many_strings_are_told_apart_in_narrow_steps(spark, many):
    r = random.Random(10)
    docs = [(j, "".join(r.choice("ab") for _ in range(r.randrange(20)))) for j in range(8)] + [(20, None), (21, ""), (22, "a𝄞b" * 4), (23, "xa𝄞b"), (24, "abab"), (25, "abab")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    own = dict(docs)
    found = [(own[x.doc_id][x.pos : x.pos + x.d], x.d, x.n_occ) for x in repeats.branches(rows.where("text is not null"), 2, many).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(docs, 2)


def test_what_repeats_itself_too_often_goes_by_order(spark, monkeypatch):
    docs = [(0, "a" * 60 + "b" + "a" * 30), (1, "xa")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeats.branches(rows, 3, budget=0) is None
    monkeypatch.setattr(repeats, "branches", lambda *_: None)
    assert {tuple(x) for x in repeats.maximal_repeats(rows, 3).collect()} == brute(docs, 3)


def test_the_inside_of_copies_takes_no_part(spark):
    """Of copies of a text only the beginning and what follows a change is looked at; all 2 * 4981 places occur twice."""
    r = random.Random(11)
    whole = "".join(r.choice("abcdefghijklmnop") for _ in range(5000))
    docs = spark.createDataFrame([(0, whole), (1, whole[:2500] + "?" + whole[2501:])], "doc_id long, text string")
    assert sorted((x.doc_id, x.pos) for x in repeats.unlike_places(docs, 20).collect()) == [(0, 0), (0, 2501), (1, 0), (1, 2501)]


@pytest.mark.parametrize(("piece", "each"), [(7, 16), (1 << 20, 1 << 20)])
def test_places_with_unlike_characters_before_them(spark, piece, each):
    """None is missing, whatever pieces texts are cut to and however many ranges there are; of others there are few."""
    r = random.Random(12)
    docs = [(j, "".join(r.choice("abcd") for _ in range(r.randrange(60)))) for j in range(12)] + [(20, None), (21, ""), (22, "ä𝄞b" * 9), (23, "abab"), (24, "abab"), (25, "aba")]
    places = {}
    for doc, t in docs:
        for p in range(len(t or "") - 2):
            places.setdefault(t[p : p + 3], []).append((doc, p, t[p - 1] if p else None))
    want = {(doc, p, w, c) for w, at in places.items() for doc, p, c in at if len(at) > 1 and (len({c for _, _, c in at}) > 1 or at[0][2] is None)}
    rows = spark.createDataFrame(docs, "doc_id long, text string").where("text is not null")
    found = [tuple(x) for x in repeats.maybe_unlike(rows, 3, piece, each).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_rounds_leave_only_what_they_found(spark):
    """A job over large texts has no room for the tables of all its rounds."""
    from gramweave.sources.tables import names_in, shared_dir

    r = random.Random(13)
    whole = "".join(r.choice("abcdefgh") for _ in range(900))
    rows = spark.createDataFrame([(0, whole), (1, "#" + whole), (2, whole[:450] + "?" + whole[450:])], "doc_id long, text string")
    folder = f"{shared_dir(spark)}/gramweave/{spark.sparkContext.applicationId}"
    before = set(names_in(spark, folder))
    assert repeats.branches(rows, 4).count() > 1
    assert {n.rsplit("-", 1)[0] for n in set(names_in(spark, folder)) - before} == {"repeat-found"}
