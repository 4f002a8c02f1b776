"""The stored gram index: its answers, its plan, and what an update builds."""

import random

import pytest
from pyspark.sql import functions as F

from gramweave.operators import locate, mem
from gramweave.operators.index import GramIndex
from gramweave.sources.tables import names_in, shared_path

LEAST = 6


def part():
    return F.floor(F.col("doc_id") / 5)


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def made(seed=0, n=60):
    r = random.Random(seed)
    return [(j, "".join(r.choice("abc") for _ in range(r.randrange(40)))) for j in range(n)] + [(n, None), (n + 1, ""), (n + 2, "ä𝄞b" * 300)]


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    patterns = [(j, "".join(r.choice("abc") for _ in range(r.randrange(LEAST, 15)))) for j in range(30)] + [(98, None), (99, "𝄞bä𝄞bä𝄞")]
    long = [(j, "".join(r.choice("abc") for _ in range(r.randrange(2 * LEAST, 20)))) for j in range(20)]
    of = lambda rows: spark.createDataFrame(rows, "pattern_id long, pattern string")
    return of(patterns), of(long), spark.createDataFrame([(j, t) for j, t in made(5, 12)], "query_id long, text string")


def got(rows):
    return sorted(map(tuple, rows.collect()))


def same_answers(texts, index, asked):
    patterns, long, queries = asked
    assert got(locate.locate(texts, patterns, 0, index)) == got(locate.locate(texts, patterns))
    assert got(locate.locate(texts, long, 1, index)) == got(locate.locate(texts, long, 1))
    assert got(mem.mems(texts, queries, LEAST, boundary="open", index=index)) == got(mem.mems(texts, queries, LEAST, boundary="open"))
    assert got(mem.mems(texts, queries, LEAST + 2, index=index)) == got(mem.mems(texts, queries, LEAST + 2))


def test_answers_are_those_without_an_index(spark, asked):
    texts, path = texts_of(spark, made()), shared_path(spark, "index")
    assert GramIndex(spark, path, LEAST).update(texts, part()) == 13
    same_answers(texts, GramIndex(spark, path), asked)
    with pytest.raises(ValueError, match="for matches of 6"):
        mem.mems(texts, asked[2], LEAST - 1, index=GramIndex(spark, path))
    with pytest.raises(ValueError, match="12 characters"):
        locate.locate(texts, asked[0], 1, GramIndex(spark, path))
    with pytest.raises(ValueError, match="for matches of 6"):
        GramIndex(spark, path, 7)
    with pytest.raises(ValueError, match="new index"):
        GramIndex(spark, shared_path(spark, "index"))


def test_an_update_builds_changed_parts_only(spark, asked):
    rows, path = made(1), shared_path(spark, "index")
    index = GramIndex(spark, path, LEAST)
    index.update(texts_of(spark, rows), part())
    assert index.update(texts_of(spark, rows[::-1]), part()) == 0
    changed = [(7, "abcabcabcabcaabb"), *[r for r in rows if r[0] not in (7, 31, 40, 41, 42, 43, 44)], (200, "cbacbacbacba")]
    texts = texts_of(spark, changed)
    assert index.update(texts, part()) == 3  # one text changed, one gone, one new; a part that is gone builds nothing
    same_answers(texts, GramIndex(spark, path), asked)
    full = GramIndex(spark, shared_path(spark, "index"), LEAST)
    full.update(texts, part())
    rows_of = lambda i: sorted(tuple(r) for t in i.builds() for r in t.select("doc_id", "x", "gram", "t_before", "t_after").collect())
    assert len(index.builds()) == 2 and rows_of(index) == rows_of(full)
    index.merge()
    assert len(index.builds()) == 1 and rows_of(GramIndex(spark, path)) == rows_of(full)


def test_a_build_without_a_manifest_is_not_used(spark, asked):
    texts, path = texts_of(spark, made(2, 20)), shared_path(spark, "index")
    index = GramIndex(spark, path, LEAST)
    index.update(texts, part())
    spark.range(3).write.parquet(f"{path}/grams-1-4")
    spark.range(3).write.parquet(f"{path}/manifest-1/part")  # no _SUCCESS beside it
    assert "_SUCCESS" not in names_in(spark, f"{path}/manifest-1")
    assert got(locate.locate(texts, asked[0], 0, GramIndex(spark, path))) == got(locate.locate(texts, asked[0]))


def test_stored_grams_are_not_moved(spark, asked, monkeypatch):
    """With queries too large to send, they are shuffled to the buckets; the index side has no exchange but for the parts' names."""
    from gramweave.operators import locate as own

    monkeypatch.setattr(own.smaller, "__defaults__", (0, None))
    path = shared_path(spark, "index")
    GramIndex(spark, path, LEAST).update(texts_of(spark, made(3)), part())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = GramIndex(spark, path)
        asked_grams = locate.kmers(asked[2], "query_id", "text", index.w)
        met = index.hits(asked_grams.withColumnRenamed("pos", "i"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("hashpartitioning(gram") == 1, plan
        assert met.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("together", [40, 8 << 20])
def test_places_of_a_gram_are_stored_together(spark, together):
    """What a row of a list holds is what a row for each place held; a long text is cut in parts, and grams of many places lie in few rows."""
    from gramweave.operators.index import LISTED, gram_lists, grams_in_context

    rows = texts_of(spark, [*made(4), (70, "ab" * 9000), (71, "ä𝄞" * 70 + "c")]).where("text is not null").withColumn("part", F.lit("p")).coalesce(1)
    lists = gram_lists(rows, 4, 3, together)
    places = lists.select("gram", F.inline(F.arrays_zip("parts", "docs", "xs", "besides")))
    near = F.least("xs", F.lit(2)).cast("int")
    found = places.select("docs", "xs", "gram", F.reverse(F.substring("besides", F.lit(1), near)), F.substring("besides", near + 1, F.lit(2)))
    assert got(found) == got(grams_in_context(rows, "doc_id", "x", 4, 3, 3, "t"))
    assert lists.agg(F.max(F.size("xs"))).first()[0] <= LISTED and (together == 40 or lists.count() < places.count() / 10)


def test_an_update_stores_lists(spark):
    path = shared_path(spark, "index")
    GramIndex(spark, path, LEAST).update(texts_of(spark, [(0, "abc" * 2000)]), F.lit(1))
    build = next(n for n in names_in(spark, path) if n.startswith("grams-"))
    assert spark.read.parquet(f"{path}/{build}").count() == 1  # 1999 places of one gram: w is 4 and s is 3


def test_what_is_asked_keeps_its_columns(spark):
    """A column of the asked grams that is named as one of the index is still there."""
    index = GramIndex(spark, shared_path(spark, "index"), LEAST)
    index.update(texts_of(spark, [(0, "abcdefgh")]), F.lit("own"))
    asked = spark.createDataFrame([("abcd", 5), ("zzzz", 6)], "gram string, part int")
    assert got(index.hits(asked).select("doc_id", "x", "gram", "part")) == [(0, 0, "abcd", 5)]


@pytest.mark.parametrize(("together", "most"), [(40, 7), (8 << 20, 1 << 20)])
def test_places_move_packed_to_their_buckets(spark, together, most):
    """What arrives are the lists of gram_lists(), each in the partition that Spark deals its gram to, and few rows move."""
    from gramweave.operators.index import gram_lists, moved_lists

    rows = texts_of(spark, [*made(6), (70, "ab" * 900), (71, "ä𝄞" * 70 + "c")]).where("text is not null").withColumn("part", (F.col("doc_id") % 7).cast("string"))
    moved = moved_lists(rows, 5, 3, 6, together, most).withColumn("at", F.spark_partition_id())
    assert moved.where(F.col("at") != F.pmod(F.hash("gram"), F.lit(6))).isEmpty() and moved.select("at").distinct().count() == 6
    places = lambda lists: got(lists.select("gram", F.inline(F.arrays_zip("parts", "docs", "xs", "besides"))))
    assert places(moved) == places(gram_lists(rows, 5, 3)) and len(places(moved)) > 1000
    names = rows.withColumn("doc_id", F.concat(F.lit("t"), "doc_id"))
    assert places(moved_lists(names, 5, 3, 6, together, most)) == places(gram_lists(names, 5, 3))


def test_an_update_of_much_text_is_built_in_turns(spark, asked, monkeypatch):
    from gramweave.operators import index as own

    monkeypatch.setattr(own, "TURN", 200)
    path, rows = shared_path(spark, "index"), made(7)
    texts = texts_of(spark, rows)
    index = GramIndex(spark, path, LEAST)
    assert index.update(texts, part()) == 13 and len(index.builds()) == own.TURNS == 4
    assert index.manifest().columns == ["part", "content", "build"] and index.update(texts, part()) == 0
    changed = texts_of(spark, [(7, "abcabcabcabcaabb"), *[r for r in rows if r[0] != 7]])
    assert index.update(changed, part()) == 1 and len(index.builds()) == 5
    same_answers(changed, GramIndex(spark, path), asked)
    index.merge()
    assert len(index.builds()) == 1
    same_answers(changed, GramIndex(spark, path), asked)
