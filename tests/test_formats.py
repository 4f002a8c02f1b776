"""The data sources gfa and patterns: ranges of any size, round trips, commits, and files that are cut."""

import pytest

from gramweave.sources.formats import register
from gramweave.sources.tables import shared_path

LINES = ["H\tVN:Z:1.0", "S\tn1\tACGT\textra", "# no record", "S\tñ2\tä" + "x" * 40, "L\tn1\t+\tñ2\t-\t0M", "S\tn3\t*", "L\tñ2\t-\tn3\t+\t0M", ""]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    register(spark)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_graphs_in_ranges_of_any_size(spark, tmp_path, split):
    (tmp_path / "a.gfa").write_text("\n".join(LINES))
    (tmp_path / "b.gfa").write_text("S\tlast\tT")  # no line break at its end
    (tmp_path / "_c.gfa").write_text("S\tnot\tread\n")
    (tmp_path / "d.gfa").write_text("")
    read = spark.read.format("gfa").option("split", split)
    assert rows(read.load(str(tmp_path))) == sorted([("n1", "ACGT"), ("ñ2", "ä" + "x" * 40), ("n3", "*"), ("last", "T")])
    assert rows(read.option("record", "L").load(f"file://{tmp_path}")) == [("n1", False, "ñ2", True), ("ñ2", True, "n3", False)]


def test_a_graph_that_is_written_and_read(spark):
    path = shared_path(spark, "gfa")
    nodes = spark.range(100).selectExpr("concat('n', id) as name", "repeat('ACG', int(id) + 1) as label").repartition(3)
    links = spark.range(99).selectExpr("concat('n', id) as src", "id % 2 = 0 as src_rev", "concat('n', id + 1) as dst", "id % 3 = 0 as dst_rev")
    for part in (nodes, links):
        part.write.format("gfa").mode("append").save(path)
    assert rows(spark.read.format("gfa").option("split", 100).load(path)) == rows(nodes)
    assert rows(spark.read.format("gfa").option("record", "L").load(path)) == rows(links)
    with pytest.raises(Exception, match="line break"):
        nodes.selectExpr("name", "if(name = 'n50', 'A\\nB', label) as label").write.format("gfa").mode("append").save(path)
    assert spark.read.format("gfa").load(path).count() == 100  # nothing of the failed write
    with pytest.raises(Exception, match="takes the columns"):
        nodes.selectExpr("name").write.format("gfa").mode("append").save(path)


@pytest.mark.parametrize("split", [1, 10, 1 << 20])
def test_pattern_files(spark, tmp_path, split):
    (tmp_path / "one").write_text("# number=3 length=4 file=x\nabcdef\nhijklm")
    (tmp_path / "two").write_text("# number=0 length=4\n")
    found = spark.read.format("patterns").option("split", split).load(str(tmp_path))
    assert [(i, p) for _, i, p in rows(found)] == [(0, "abcd"), (1, "ef\nh"), (2, "ijkl")]


def test_cut_files_are_errors(spark, tmp_path):
    for name, text, kind in (("a", "# number=3 length=4\nabcdefghijk", "patterns"), ("b", "# number=3\nabcdefghijkl", "patterns"), ("c", "S\tn1\n", "gfa")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="pattern file needs|with 2 fields"):
            spark.read.format(kind).load(str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("gfa").load(str(tmp_path / "none")).collect()
