"""What stands near a seed decides before whole windows are held against patterns, and before texts are read for an index's hits."""

import random

import numpy as np

from gramweave.operators import locate
from gramweave.operators.index import GramIndex


def near(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_candidates_that_differ_early_are_not_verified(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdĀ\0", k=4000))  # Ā has the lowest byte of \0
    patterns = ["".join(rng.choices("abcdĀ\0", k=n)) for n in (3, 7, 8, 9, 12, 16, 17, 40)] + [text[100:112], text[3988:], text[:20]]
    seen, own = [], locate.Scanner._verified
    monkeypatch.setattr(locate.Scanner, "_verified", lambda self, t, which, at: seen.append(len(at)) or own(self, t, which, at))
    for most in (0, 2):
        seeds = [(i, part * len(p) // (most + 1), locate.width_of(len(p) // (most + 1))) for i, p in enumerate(patterns) for part in range(most + 1)]
        scanner = locate.Scanner([locate.codes(p) for p in patterns], seeds, most, None)
        whole = np.append(locate.codes(text), np.uint32(locate.GAP))
        seen.clear()
        got = list(zip(*(x.tolist() for x in scanner.find(whole)), strict=True))
        want = {(i, x, near(p, text[x : x + len(p)])) for i, p in enumerate(patterns) for x in range(len(text) - len(p) + 1)}
        assert len(got) == len(set(got)) and set(got) == {r for r in want if r[2] <= most}
        assert not most or sum(seen) < sum(len(which) for which, _ in scanner.candidates(whole))


def test_index_settles_patterns_of_its_length_without_texts(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    docs = [(n, "".join(rng.choices("abß", k=rng.choice([0, 3, 6, 7, 300])))) for n in range(40)] + [(40, None)]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    index = GramIndex(spark, str(tmp_path / "grams"), 6)
    index.update(texts)
    own = {n: p for n, p in enumerate({t[x : x + 6] for _, t in docs[:30] for x in range(0, len(t or "") - 5, 5)})} | {9998: "zzzzzz"}
    longer = {n: p for n, p in enumerate({t[x : x + 13] for _, t in docs[:30] for x in range(0, len(t or "") - 12, 9)})}

    def found(patterns, most):
        rows = locate.locate(texts, spark.createDataFrame(list(patterns.items()), "pattern_id long, pattern string"), most, index).collect()
        assert len(rows) == len(set(rows))
        return {tuple(r) for r in rows}

    def want(patterns, most):
        every = ((i, d, x, near(p, t[x : x + len(p)])) for i, p in patterns.items() for d, t in docs for x in range(len(t or "") - len(p) + 1))
        return {r for r in every if r[3] <= most}

    assert found(longer, 0) == want(longer, 0) and found(longer, 1) == want(longer, 1)
    monkeypatch.setattr(locate, "_windows", None)  # is not called
    assert found(own, 0) == want(own, 0)


def test_occurrences_are_found_once_to_be_checked(spark, monkeypatch):
    """found may be a scan of all texts, and is read twice."""
    tables, own = [], locate.written
    monkeypatch.setattr(locate, "written", lambda rows, name: tables.append(name) or own(rows, name))
    t = spark.createDataFrame([(1, "abcabc"), (2, None)], "doc_id long, text string")
    p = spark.createDataFrame([(7, "abc")], "pattern_id long, pattern string")
    f = spark.createDataFrame([(7, 1, 0), (7, 1, 3), (7, 1, 4), (7, 2, 0), (8, 1, 0), (7, 1, -1)], "pattern_id long, doc_id long, x long")
    assert sorted(tuple(r) for r in locate.violations(t, p, f, 0).collect()) == [(7, 1, -1), (7, 1, 4), (7, 2, 0), (8, 1, 0)]
    assert tables == ["found"]
