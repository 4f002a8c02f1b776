"""Line dedup against plain loops: nulls, repeated ids and rows, long texts, clashing columns, stores that go on, compaction, and its plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gramweave.llm import line_dedup
from gramweave.llm.shared import new_path

SCHEMA = "doc_id long, text string, n_lines int, batch string, hash string, id int, at int, __gone int"
SPACES, UPPER = " \t\n\x0b\x0c\r", str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def brute(rows, least=10):
    """rows: (id, text). The kept text, lines and dropped lines of each row, in their order."""
    order = lambda i: (i is None, i or 0)
    first = {}
    keys = lambda text: [line.strip(SPACES).translate(UPPER) for line in (text or "").split("\n")]
    for i, text in rows:
        for key in keys(text):
            if len(key) >= least and (key not in first or order(i) < order(first[key])):
                first[key] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line, key in zip(lines, keys(text), strict=True) if len(key) < least or first[key] == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def made(seed=0, n=120):
    r = random.Random(seed)
    pool = [f"line number {i} of the Pool ÄÖ" for i in range(40)] + ["short", "", "  ", "ten chars!", "nine char", "Ünïcode línes çount tôo", "a" * 300]
    dress = lambda s: r.choice(["", " ", "\t", "\x0b\r"]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", "  ", "\x0c"])
    rows = [(i, "\n".join(dress(r.choice(pool)) for _ in range(r.randrange(1, 12)))) for i in range(n)]
    rows += [(None, "line number 1 of the Pool ÄÖ\nonly with a null id"), (None, "only with a null id\nnew to all of them"), (n, None), (n + 1, ""), (n + 2, "\n\n\n")]
    rows += [rows[3], rows[3], (3, "line number 2 of the Pool ÄÖ\nanother text of one id"), (n + 3, "\n".join(f"long text line {i % 20000}" for i in range(40_000))), (n + 4, "long text line 7\r\nlong text line 8" + " " * 100_000 + "x")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", "h", 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_equals_plain_loops(spark, batches):
    rows = made()
    out = line_dedup.dedup_lines(table(spark, rows), batches=batches)
    assert out.columns == ["doc_id", "text", "batch", "hash", "id", "at", "__gone", "n_lines", "n_dropped"]
    assert result(out) == sorted(brute(rows), key=repr)


def test_digests_and_empty_table(spark):
    rows = made(1, 30)
    got = sorted(map(tuple, line_dedup.line_digests(table(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in brute(rows)), key=repr)
    assert line_dedup.line_digests(table(spark, [])).count() == 0


def test_ids_of_other_types(spark):
    rows = [(f"doc{i:03}", t) for i, (_, t) in enumerate(made(2, 40))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"))
    want = {i: (n, gone) for i, _, n, gone in brute([(int(i[3:]), t) for i, t in rows])}
    assert {int(r.doc_id[3:]): (r.n_lines, r.n_dropped) for r in out.collect()} == want


def test_large_drops_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    rows = made(3, 60)
    assert result(line_dedup.dedup_lines(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_a_store_goes_on_and_is_compacted(spark):
    """Batches in a store that is opened anew each time drop what one run over all drops; levels stay short."""
    rows = [r for r in made(4, 90) if r[0] is not None and r[0] != 3]
    folder, out = new_path(spark, "runs"), []
    for low in range(0, 100, 12):
        part = [r for r in rows if low <= r[0] < min(100, low + 12)]
        store = line_dedup.LineRuns(spark, folder, fan=2)
        out += result(line_dedup.dedup_lines(table(spark, part), batches=1, store=store))
    assert sorted(out, key=repr) == sorted((r for r in brute(rows) if r[0] < 100), key=repr)
    hashes = line_dedup.LineRuns(spark, folder).runs.values()
    levels = [level for level, _ in hashes]
    assert max(levels) >= 2 and all(levels.count(x) <= 2 for x in levels)
    assert sum(run.count() for _, run in hashes) == sum(run.select("hash").distinct().count() for _, run in hashes)


def test_half_written_runs_are_left_out(spark):
    folder = new_path(spark, "runs")
    store = line_dedup.LineRuns(spark, folder)
    store.add(line_dedup.lines_of(table(spark, [(1, "a line that counts")]), "doc_id", "text", 10))
    spark.range(3).write.parquet(f"{folder}/000-000000007-4/part")
    assert len(line_dedup.LineRuns(spark, folder).runs) == 1


def test_runs_are_read_without_a_shuffle_and_nothing_is_python(spark):
    store = line_dedup.LineRuns(spark, new_path(spark, "runs"))
    lines = line_dedup.lines_of(table(spark, made(5, 20)), "doc_id", "text", 10)
    store.add(lines)
    _, run = next(iter(store.runs.values()))
    new = lines.groupBy("hash").agg(F.min("id")).join(run.select("hash").hint("merge"), "hash", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    whole = line_dedup.line_digests(table(spark, made(5, 20)))._jdf.queryExecution().toString()
    assert "Python" not in whole and "Arrow" not in whole
