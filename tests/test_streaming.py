import random

import pytest

from gramweave.operators import locate, mem
from gramweave.operators.index import GramIndex
from gramweave.streaming import matches


def test_a_stream_gives_what_a_table_does(spark, tmp_path):
    texts = spark.createDataFrame([(i, "abcab" * (i % 5) + "xyz") for i in range(40)], "doc_id long, text string").repartition(4)
    texts.write.parquet(str(tmp_path / "in"))
    patterns = spark.createDataFrame([(1, "bca"), (2, "bxy"), (3, "none")], "pattern_id long, pattern string")
    queries = spark.createDataFrame([(1, "cabxyz")], "query_id long, text string")
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, start, want in (
        ("a", lambda *a: matches.locate_stream(stream, patterns, *a, most=1, once=True), locate.locate(texts, patterns, 1)),
        ("b", lambda *a: matches.mem_stream(stream, queries, 3, *a, once=True, boundary="open"), mem.mems(texts, queries, 3, boundary="open")),
    ):
        out, mark = str(tmp_path / name), str(tmp_path / f"{name}-mark")
        start(out, mark).awaitTermination(120)
        found = spark.read.parquet(out)
        assert found.select("batch").distinct().count() > 1
        assert sorted(map(tuple, found.drop("batch").collect())) == sorted(map(tuple, want.collect()))
        start(out, mark).awaitTermination(120)  # nothing new to read
        assert spark.read.parquet(out).count() == found.count()


@pytest.mark.parametrize("most", [0, 1])
def test_patterns_that_arrive_are_joined_to_a_stored_index(spark, tmp_path, most):
    """Two runs from one checkpoint give what all patterns give at once, and no pattern twice."""
    r = random.Random(3)
    texts = spark.createDataFrame([(j, "".join(r.choice("ab") for _ in range(60))) for j in range(20)], "doc_id long, text string")
    index = GramIndex(spark, str(tmp_path / "index"), 4)
    index.update(texts)
    parts = [[(j, "".join(r.choice("ab") for _ in range(r.randrange(8, 12)))) for j in range(a, a + 8)] for a in (0, 8)]
    schema, out = "pattern_id long, pattern string", str(tmp_path / "out")
    for n, part in enumerate(parts):
        spark.createDataFrame([*part, (90 + n, None)], schema).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = matches.locate_pattern_stream(stream, texts, index, most)
        assert found.isStreaming
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(out).select("pattern_id", "doc_id", "x", "mismatches").collect())
    want = locate.locate(texts, spark.createDataFrame([p for part in parts for p in part], schema), most)
    assert got == sorted(tuple(x) for x in want.collect()) and got
