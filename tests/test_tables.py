"""The SQL table functions: results, columns and kinds that follow from their arguments, and wrong arguments."""

import pytest

from gramweave.functions.tables import register
from gramweave.operators import locate, mem


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    texts = [(1, "abracadabra"), (2, None), (3, ""), (4, "ä𝄞xabrax"), (5, "ab" * 30), (5, "ab" * 30)]
    spark.createDataFrame([(f"t{i}", t) for i, t in texts], "name string, body string").createOrReplaceTempView("named")
    spark.createDataFrame([*texts[:-1], (6, "y" * (1 << 20) + "abra" + "z" * 10)], "doc_id long, text string").createOrReplaceTempView("docs")
    spark.createDataFrame([(0, "xabracab"), (1, "babababab")], "query_id long, text string").createOrReplaceTempView("queries")
    return spark.sql


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_locate_in(spark, sql):
    patterns = ["abra", "cad", "𝄞x", "bab", "abra"]
    listed = ", ".join(f"'{p}'" for p in patterns)
    frame = spark.createDataFrame([(p, p) for p in set(patterns)], "pattern_id string, pattern string")
    for most in (0, 1):
        got = sql(f"select * from locate_in(table(docs), array({listed}), {most})")
        assert got.columns == ["pattern", "doc_id", "x", "mismatches"]
        assert rows(got) == rows(locate.locate(spark.table("docs"), frame, most))
    named = sql("select name, x from locate_in(table(select * from named), (select array_agg(text) from queries where query_id = 1), 0)")
    assert named.dtypes == [("name", "string"), ("x", "bigint")] and named.count() == 2 * 26
    assert sql("select * from locate_in(table(docs), cast(array() as array<string>), 0)").count() == 0


def test_grams_and_runs_are_matches(spark, sql):
    for k in (1, 3):
        hits = f"select t.doc_id, q.query_id, t.pos as x, q.pos as i from grams_in(table(select * from docs where doc_id < 6), {k}) t join grams_in(table(queries), {k}) q on t.gram = q.gram"
        got = sql(f"select * from runs_in(table({hits}) partition by (doc_id, query_id, x - i) order by (x), {k})")
        assert got.columns == ["doc_id", "query_id", "x", "i", "d"]
        assert rows(got) == rows(mem.mems(spark.table("docs").where("doc_id < 6"), spark.table("queries"), k, boundary="open"))


@pytest.mark.parametrize(
    ("call", "says"),
    [
        ("locate_in(table(select doc_id from docs), array('a'), 0)", "two columns"),
        ("locate_in(table(docs), array(1), 0)", "array of strings"),
        ("locate_in(table(docs), array('a'), -1)", "0 or more"),
        ("grams_in(table(docs), 0)", "1 or more"),
        ("runs_in(table(docs), 2)", "ids, x and i"),
    ],
)
def test_wrong_arguments(sql, call, says):
    with pytest.raises(Exception, match=says):
        sql(f"select * from {call}")


def test_known_grams_are_those_that_a_join_would_keep(spark, sql):
    from gramweave.functions.tables import register_known

    spark.createDataFrame([(0, "xabracab"), (1, "babababab"), (2, None), (3, ""), (4, "a𝄞xab"), (5, "y" * 5)], "query_id long, text string").createOrReplaceTempView("asked")
    for k in (1, 3):
        register_known(spark, f"known_{k}", spark.table("asked"), k)
        got = sql(f"select * from known_{k}(table(docs))")
        assert got.columns == ["doc_id", "pos", "gram"]
        assert rows(got) == rows(sql(f"select * from grams_in(table(docs), {k}) left semi join (select gram from grams_in(table(asked), {k})) using (gram)").select("doc_id", "pos", "gram"))
    assert sql("select * from known_3(table(select * from named))").dtypes == [("name", "string"), ("pos", "bigint"), ("gram", "string")]
    with pytest.raises(Exception, match="two columns"):
        sql("select * from known_3(table(select doc_id from docs))")


def test_only_shared_grams_reach_the_join_of_sql_mems(spark, monkeypatch):
    """The texts' side of the join is the function that keeps what the queries know; larger sets of queries go by the whole join, with the same rows."""
    from gramweave.plans import queries

    asked = spark.createDataFrame([(0, "the quick brown fox jumps")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "##" + "the quick brown fox jumped over" + "z" * 200), (2, "q" * 500)], "doc_id long, text string")
    monkeypatch.setattr(queries, "passages", lambda *_: asked)
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    monkeypatch.setattr(queries, "pattern_sample", lambda *_: spark.createDataFrame([], "pattern string"))
    statements, own = [], queries.from_sql
    monkeypatch.setattr(queries, "from_sql", lambda s, d, text: statements.append(text) or own(s, d, text))
    found = queries.sql_mems(spark, "")
    assert "own_grams_in(table(own_texts))" in statements[0]
    assert spark.sql("select * from own_grams_in(table(own_texts))").count() == 5
    monkeypatch.setattr(queries.grams, "small", lambda *_: False)
    assert rows(queries.sql_mems(spark, "")) == rows(found) == [(1, 0, 2, 0, 24)]
    assert "own_grams_in" not in statements[1]
