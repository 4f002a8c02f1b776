"""The pipeline and the registered queries of this subpackage, on a small fixture and on the smallest tables."""

import importlib
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from gramweave.llm import language_id, mixing, queries
from gramweave.llm.shared import written

from test_texts import PATTERN, RANKS, SCHEMA, brute_components, brute_fingerprint, rows

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")


def test_the_stages_against_brute_force(spark):
    import re

    frame = written(spark.createDataFrame([r for r in rows() if r[0] is not None], SCHEMA), "docs")
    own = [r for r in rows() if r[0] is not None]
    found = dict(corpus_pipeline.STAGES)
    assert list(found) == ["language", "exact_dedup", "simhash_dedup", "mix", "byte_bpe"]

    docs = written(found["language"](spark, frame, ""), "a")
    own = [r for r, k in zip(own, brute_identified([r[1] for r in own], [r[2] for r in own])) if k]
    assert docs.columns == frame.columns and sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, own))

    docs = written(found["exact_dedup"](spark, docs, ""), "b")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for r in own:
        if norm(r[1]) not in best or (-len(r[1]), r[0]) < (-len(best[norm(r[1])][1]), best[norm(r[1])][0]):
            best[norm(r[1])] = r
    assert docs.columns == frame.columns and sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in best.values())

    own = sorted(best.values())
    docs = written(found["simhash_dedup"](spark, docs, ""), "c")
    prints = [brute_fingerprint(r[1]) for r in own]
    names = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    kept = sorted({min(own[j][0] for j in range(len(own)) if names[j] == n) for n in names})
    assert docs.columns == frame.columns and sorted(r.doc_id for r in docs.collect()) == kept

    mixed = written(found["mix"](spark, docs, ""), "d")
    plan = mixing.mix_plan(docs).collect()
    assert mixed.columns == frame.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in plan for _ in r.shards)

    out = found["byte_bpe"](spark, mixed, "").collect()
    from gramweave.llm.byte_bpe import coder

    enc, _ = coder(RANKS, PATTERN)
    text = {r[0]: r[1] for r in own}
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, len(enc.encode_ordinary(text[r.doc_id]))) for r in mixed.collect())


def brute_scores(texts, labels):
    """Language, score and number of n-grams of each text by letter vectors in plain loops, and prototypes of the labelled ones."""
    import numpy as np

    signs = language_id.letters()[language_id.N - 1]
    symbol = lambda c: int(language_id.alphabet()[ord(c)]) if ord(c) < 0x10000 else (60 + ord(c) % 68 if c.isalpha() else 0)
    vectors, sizes = [], []
    for text in texts:
        line = [0]
        for c in (text or "").lower() + " ":
            if symbol(c) or line[-1]:
                line.append(symbol(c))
        if not any(line):
            vectors.append(None)
            sizes.append(0)
            continue
        total, seen = np.zeros(language_id.SIZE), {}
        for i in range(len(line) - 2):
            gram = tuple(line[i : i + 3])
            if gram not in seen:
                a, b, c = gram
                seen[gram] = np.roll(signs[a], 2) * np.roll(signs[b], 1).astype("i8") * signs[c]
            total += seen[gram]
        vectors.append(total)
        sizes.append(len(line) - 2)
    names = sorted({k for k, v in zip(labels, vectors) if k is not None and v is not None})
    known = {k: sum(v for v, own in zip(vectors, labels) if own == k and v is not None) for k in names}
    out = []
    for v, n in zip(vectors, sizes):
        if v is None or not names:
            out.append(("und", 0.0, n))
            continue
        cosines = [float(v @ known[k] / np.linalg.norm(v) / np.linalg.norm(known[k])) for k in names]
        out.append((names[int(np.argmax(cosines))], min(1.0, max(0.0, max(cosines))), n))
    return out


def brute_identified(texts, labels):
    """Which texts the language stage keeps: one rule for all lengths."""
    scored = brute_scores(texts, labels)
    bands = {}
    for (lang, score, n), own in zip(scored, labels):
        if own is not None and lang != "und":
            bands.setdefault((n.bit_length() - 1) // 2, []).append(int(score * 1000))
    x, y = zip(*[(2 * k + 1, sorted(v)[-(-len(v) // 2) - 1] / 1000) for k, v in sorted(bands.items())])
    return [lang != "und" and score >= 0.25 * float(np.interp(np.log2(n), x, y)) * n / (n + 512) for lang, score, n in scored]


def language_cases():
    import random

    r = random.Random(3)
    said = {"en": "the and of with that have this water stone there".split(), "fr": "les des une avec pour été était dans même où".split()}
    out = [(" ".join(r.choice(said[k]) for _ in range(r.randrange(1, 90))), k) for k in said for _ in range(40)]
    out += [("zqx vkj " * 900, None), ("ωψξ δλφ " * 600, None), ("Kkkk wwqq. " * 800, None), ("12 34", "en"), ("", None), (None, "fr"), ("the", None)]
    return [(i, t, k, "s", None) for i, (t, k) in enumerate(out)]


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_predictions_against_plain_loops(spark):
    own = language_cases()
    frame = spark.createDataFrame(own, PLAIN).repartition(3)
    found = {x.doc_id: x for x in language_id.predict(frame, language_id.prototypes(frame), ["doc_id"], count=True).collect()}
    for (i, *_), (lang, score, n) in zip(own, brute_scores([r[1] for r in own], [r[2] for r in own])):
        assert (found[i].lang_pred, found[i].n_grams) == (lang, n) and found[i].score == pytest.approx(score, abs=1e-4)


def test_language_stage_drops_what_no_language_resembles(spark):
    own = language_cases()
    kept = [r[0] for r, k in zip(own, brute_identified([r[1] for r in own], [r[2] for r in own])) if k]
    out = corpus_pipeline.language_stage(spark, spark.createDataFrame(own, PLAIN).repartition(3), "")
    assert sorted(r.doc_id for r in out.collect()) == kept
    assert {80, 81, 82} & set(kept) == set() and set(range(80)) | {86} <= set(kept)


def test_stages_on_empty_tables_and_ids_of_any_kind(spark):
    none = spark.createDataFrame([], PLAIN)
    odd = spark.createDataFrame([(None, "one two three four five six", "en", None, None), (None, None, None, "a", 1), (3, "one two three four five six", None, "a", 1), (3, "one two three four five six", None, "a", 1), (3, "", "en", "b", None)], PLAIN)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == none.columns), name
    kept = {name: stage(spark, odd, "") for name, stage in corpus_pipeline.STAGES}
    assert kept["language"].count() == 3 and kept["byte_bpe"].count() == 5
    assert sorted((r.doc_id, r.text) for r in kept["exact_dedup"].collect() if r.text) == [(3, "one two three four five six")] and kept["exact_dedup"].count() == 2
    assert sorted((r.doc_id, r.text) for r in kept["simhash_dedup"].collect()) == [(3, ""), (3, "one two three four five six")]


def test_language_stage_without_labels_keeps_what_has_letters(spark):
    frame = spark.createDataFrame([(1, "abc", None, None, 1), (2, "12", None, None, 1), (3, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, frame, "").collect()] == [1]


def test_run_over_the_smallest_tables(spark):
    from gramweave.llm.shared import new_path

    folder = Path(new_path(spark, "x").removeprefix("file://")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = corpus_pipeline.run(spark, str(SMALL))
    left = {p.name for p in folder.iterdir()} - before
    assert len([n for n in left if n.startswith(("pipeline-", "scratch-"))]) == 1, left  # the result
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < out.count() < 400


def test_registered_queries(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in found
    tables = {"op3": ("embeddings", 500), "op5": ("pages", 50), "op7": ("pages", 50)}
    for name, query in queries.QUERIES.items():
        n = tables.get(name.split("_")[0], ("documents", 200))[1]
        rows = query(spark, str(SMALL)).count()
        assert rows == n if name != "op11_source_divergence" else rows > 0, name  # op11 has rows for groups, not for documents


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert language_id.UNKNOWN not in {r.lang_pred for r in out}


def test_url_and_exact_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        rows_ = queries.QUERIES[name](spark, str(SMALL))
        cols = ", ".join(rows_.columns)
        assert sorted(map(repr, map(tuple, rows_.collect()))) == sorted(map(repr, con.execute(f"select {cols} from ({sql})").fetchall())), name


def test_an_import_error_inside_is_not_swallowed(monkeypatch):
    import builtins

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "gramweave.llm" or (name.startswith("gramweave.llm.") and "queries" in name):
            raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")
        return real(name, *args, **kw)

    import __spark_entry__

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError, match="tiktoken"):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(sys.modules["__spark_entry__"])
