"""The source audit against plain loops, in one piece and in many shards, tiles and rounds of slots; and its perfect hashes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gramweave.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, slot int, n int, p int, block int, base int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """rows: (text, lang, source)."""
    docs = [(TERM.findall((t or "").translate(UPPER)), g or "", s or "") for t, g, s in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for words, lang, source in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
        groups.add((lang, source))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        shares = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}  # noqa: E731, B023
        q = shares(whole)
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def made(seed=0, n=150):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "größe", "日本", "x", "İ", "naïve", "don", "t", "\u0085odd", "é"] + [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    text = lambda: "".join(r.choice(words[: r.choice([4, 14, 40])]) + r.choice([" ", "  ", "\n", "'", "123", "_", "\x00", "@[`{\x7f"]) for _ in range(r.randrange(40)))
    rows = [(text(), r.choice(["en", "en", "de", "", None, "fr"]), r.choice(["hot"] * 3 + ["a", "b", "ä", "", None, "c"])) for _ in range(n)]
    rows += [(None, "en", "nothing"), ("", "xx", "only"), ("1 2 3", "xx", "digits"), ("rare words here", "yy", "a"), ("alpha " * 30_000 + "b" * 200_000, "en", "long"), rows[0], rows[0], (None, None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, *row, "t", 1, 2, 3, 4, 5) for i, row in enumerate(rows)], SCHEMA).repartition(3)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    return sorted(map(tuple, df.collect()))


SMALL = {"shard": 4, "cells": 30, "sources": 2, "slots": 3}


@pytest.mark.parametrize("more", [{}, SMALL, {"most_bytes": 0, "shard": 4}])
def test_audit_equals_plain_loops(spark, more):
    rows = made()
    assert result(divergence.audit(table(spark, rows), least=5, top=6, **more)) == brute(rows, 5, 6)


def test_slices_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 100)
    rows = made(1, 60)
    assert result(divergence.audit(table(spark, rows), least=3)) == brute(rows, 3, 50)
    assert result(divergence.audit(table(spark, []))) == []
    assert result(divergence.audit(table(spark, rows), least=10_000)) == brute(rows, 10_000, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 10**17 + 3, 3 * 10**17 + 1, 12_345
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_perfect_hash():
    terms = [f"term{i}é" for i in range(20_000)]
    keys = divergence.keys_of("en", terms)
    hashes = divergence.PerfectHash.of(terms, keys)
    again = divergence.PerfectHash(*hashes.stored()[:2], pa.array(hashes.stored()[2]))
    assert sorted(again.find(pa.array(terms), keys).tolist()) == list(range(len(terms)))
    assert again.terms.take(pa.array(again.find(pa.array(terms), keys))).to_pylist() == terms
    others = [f"other{i}" for i in range(20_000)]
    assert (again.find(pa.array(others), divergence.keys_of("en", others)) == -1).all()
    assert (again.find(pa.array(others), keys) == -1).all()  # the same bits, other terms


def test_perfect_hash_of_terms_that_share_a_key():
    terms, keys = ["a", "b", "c", "d"], np.array([7, 7, 9, 9], "u8")
    hashes = divergence.PerfectHash.of(terms, keys)
    assert sorted(hashes.find(pa.array(terms), keys).tolist()) == [0, 1, 2, 3] and hashes.rest
    assert hashes.find(pa.array(["e"]), np.array([7], "u8")).tolist() == [-1]
    assert divergence.PerfectHash.of([], np.zeros(0, "u8")).find(pa.array(["a"]), keys[:1]).tolist() == [-1]


def test_keys_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("en", "term"), ("", "é"), ("日", "")], "lang string, term string")
    for r in rows.select("lang", "term", F.xxhash64("lang", "term").alias("k")).collect():
        assert int(divergence.keys_of(r.lang, [r.term])[0]) == r.k % 2**64
