"""The operators on texts, against brute force, on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from gramweave.llm import byte_bpe, exact_dedup, language_id, mixing, simhash, token_counts, token_files  # noqa: E402
from gramweave.llm.shared import connected, new_path  # noqa: E402

WORD, RANKS, PATTERN = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, id string, key int, block long, content string, fp int"

_words = [f"{a}{b}" for a in ("river", "stone", "Light", "ÉTÉ", "groß", "don't", "x1y2", "日本語", "<|endoftext|>", "e\u0301") for b in ("", "s", "!", "'s", "42")]


def long_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(_words) + r.choice([" ", "  ", "\n", "\t ", "\r\n", " \u00a0", "\x1c"]) for _ in range(n))


TEXTS = [None, "", " \t\n", "one", "one two three", "One  two\nthree", "a b c d e f g h", "A b c d e f g  h", "a b c d e f g h", "123 456", "!!!", "naïve café über", "no-break\u00a0space \x1c sep", long_text(1, 400), long_text(2, 6000), "y" * 70_000, long_text(1, 400).upper(), long_text(1, 400) + "end"]


def rows():
    out = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "c")[i % 4], None, "d", 1, "i", 2, 3, "c", 4) for i, t in enumerate(TEXTS)]
    return [*out, out[4], out[13], (None, "null id", "en", "a", 1, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, docs, none):
    path, encode = new_path(spark, "t"), library()
    token_files.write_tokens(docs, path, WORD)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for r in ordered:
        ids = [*encode(r[1]), 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(token_files.token_digests(spark, path)) == sorted(want, key=repr)
    few = token_files.read_tokens(spark, path, [5, 13])
    assert {r.doc_id: r.tokens for r in few.collect()} == {i: [*encode(TEXTS[i]), 1] for i in (5, 13)}
    assert "PushedFilters: [In(doc_id" in few._jdf.queryExecution().toString()
    assert token_files.read_tokens(spark, path, [99]).count() == 0
    empty = new_path(spark, "t")
    token_files.write_tokens(none, empty, WORD)
    assert token_files.token_digests(spark, empty).count() == 0


def test_token_files_have_row_indexes_and_bloom_filters(spark, docs):
    path = new_path(spark, "t")
    token_files.write_tokens(docs, path, WORD, files=1)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    file = next(p for p in Path(path.removeprefix("file://")).glob("*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    assert list(reader.getSchema().getFieldNames()) == ["doc_id", "part", "at", "n_tokens", "tokens"]
    flags = gateway.new_array(gateway.jvm.boolean, reader.getSchema().getMaximumId() + 1)
    for i in range(len(flags)):
        flags[i] = True
    index = reader.rows().readRowIndex(0, flags, flags)
    assert index.getRowGroupIndex()[1].getEntryCount() == 1
    blooms = index.getBloomFilterIndex()
    assert blooms[1] is not None and blooms[1].getBloomFilterCount() == 1 and blooms[4] is None


def test_token_files_are_skipped_by_statistics_and_bloom_filters(spark):
    """Even ids in several row groups of one file: the statistics of groups exclude far ids, Bloom filters the odd ones between."""
    path, first = new_path(spark, "t"), 1 << 40  # what is passed to the reader as a long
    docs = spark.range(first, first + 9000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(docs, path, WORD, files=1)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    file = next(p for p in Path(path.removeprefix("file://")).glob("*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    builder = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder
    kind = jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG

    def read(i):
        columns = gateway.new_array(jvm.java.lang.String, 1)
        columns[0] = "doc_id"
        rows = reader.rows(reader.options().searchArgument(builder().equals("doc_id", kind, first + i).build(), columns))
        batch, n = reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            n += batch.count()
        return n

    assert reader.getNumberOfRows() == 4500
    assert read(4000) == token_files.ROWS and read(20_000) == 0
    assert sum(read(i) == 0 for i in range(1, 2000, 100)) >= 18
    assert [r.doc_id for r in token_files.read_tokens(spark, path, [first + 4000, first + 4001]).collect()] == [first + 4000]


def test_byte_bpe(docs, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got(byte_bpe.round_trip(docs, RANKS, PATTERN)) == sorted(want, key=repr)
    coded = byte_bpe.encode(docs, RANKS, PATTERN)
    assert sorted(bytes(r.raw) for r in byte_bpe.decode(coded, RANKS, PATTERN).collect()) == sorted((r[1] or "").encode() for r in rows())
    assert byte_bpe.round_trip(none, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("most", [1, 7, 100])
def test_parts_of_a_long_text_have_the_ids_of_the_whole(most):
    enc, _ = byte_bpe.coder(RANKS, PATTERN)
    for seed in range(30):
        text = long_text(seed, 60)
        parts = list(byte_bpe.safe_parts(text, most))
        assert "".join(p for p, _ in parts) == text
        assert [i for p in parts for i in byte_bpe.part_ids(enc, *p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \n\t", "\u00a0 "])
def test_long_runs_of_white_space_have_the_ids_of_the_library(space):
    enc, _ = byte_bpe.coder(RANKS, PATTERN)
    for n in (byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1, 3 * byte_bpe.LONG):
        run = (space * n)[:n]
        for text in (run, run + "word", "word" + run, "It's" + run + "'s 12" + run, run + "!" + run + "x" * 5, "a b " * 20_000 + run + "\x1c" + run + "日本"):
            parts = list(byte_bpe.safe_parts(text))
            assert "".join(p for p, _ in parts) == text
            assert [i for p in parts for i in byte_bpe.part_ids(enc, *p)] == enc.encode_ordinary(text)


def test_white_space_that_the_library_has_no_stack_for(spark):
    texts = ["word" + " " * 5_000_000 + "word", "\n" * 2_000_000, " \n" * 1_000_000 + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, PATTERN).collect()}
    for i, text in enumerate(texts):
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_other_patterns_are_never_cut(spark):
    import tiktoken

    other = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
    text = "Hello!\nWorld 12345 " * 6000
    enc = tiktoken.Encoding("t", pat_str=other, mergeable_ranks=byte_bpe.coder(RANKS, PATTERN)[0]._mergeable_ranks, special_tokens={})
    (row,) = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, other).collect()
    assert row.ids == enc.encode_ordinary(text)
    assert PATTERN in byte_bpe.CUTS and list(byte_bpe.safe_parts(text, pattern=other)) == [(text, False)] and len(list(byte_bpe.safe_parts(text))) > 1


def test_token_counts_and_cache(spark, docs, none):
    encode, cache = library(), new_path(spark, "c")
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(encode(r[1])), n > 2048) for r in rows()), key=repr)
    assert got(token_counts.count_tokens(docs.where("doc_id < 9"), WORD, cache)) == [w for w in want if w[0] is not None and w[0] < 9]
    first = spark.read.parquet(cache).count()
    assert got(token_counts.count_tokens(docs, WORD, cache)) == want
    entries = spark.read.parquet(cache)
    assert entries.count() == entries.select("digest").distinct().count() > first
    assert got(token_counts.count_tokens(docs, WORD, cache)) == want
    assert spark.read.parquet(cache).count() == entries.count()
    assert token_counts.count_tokens(none, WORD, new_path(spark, "c")).count() == 0
    assert token_counts.count_tokens(none, WORD, cache).count() == 0


def test_the_cache_is_read_for_its_tokenizer_and_digests(spark, docs, monkeypatch):
    cache, other = new_path(spark, "c"), public_tokenizers.path("byte_bpe_50k.json")
    count = lambda path: {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(docs, path, cache).collect()}
    first, second = count(WORD), count(other)
    entries = spark.read.parquet(cache)
    assert len([p for p in Path(cache.removeprefix("file://")).iterdir() if p.name.startswith("tokenizer=")]) == 2
    for small in (token_counts.SMALL, 0):
        monkeypatch.setattr(token_counts, "SMALL", small)
        assert (count(WORD), count(other)) == (first, second)
    assert spark.read.parquet(cache).count() == entries.count()
    # A stored count is what is returned: nothing is encoded again.
    wrong = spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("long"))
    cache = new_path(spark, "c")
    wrong.write.partitionBy("tokenizer").parquet(cache)
    assert set(count(WORD).values()) == {7}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(spark, docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    found = token_counts.count_tokens(docs, path, new_path(spark, "c"))
    assert sorted(r.n_tokens for r in found.collect()) == sorted(count(r[1] or "") for r in rows())


def test_exact_dedup(spark, docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r)
    want = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], best, len(own), r[0] == best, hashlib.sha256(text.encode()).hexdigest()) for r in own]
    assert got(exact_dedup.exact_groups(docs)) == sorted(want, key=repr)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(none).count() == exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_of_other_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "x y"), ("c", "x y"), ("d", None), ("e", "")], "doc_id string, text string")
    assert got(exact_dedup.exact_groups(docs).drop("text_sha256")) == sorted([("b", "b", 4, True), ("a", "b", 4, False), (None, "b", 4, False), ("c", "b", 4, False), ("d", "d", 2, True), ("e", "d", 2, False)], key=repr)
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == ["b", "d"]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_exact_dedup_moves_a_text_twice(spark):
    texts = F.concat(*[F.sha2(F.concat("id", F.lit(f" {j}")), 256) for j in range(30)])
    docs = spark.range(0, 400, 1, 2).select(F.col("id").alias("doc_id"), texts.alias("text"))
    start = shuffled(spark)
    docs.repartition(3, "doc_id").write.format("noop").mode("overwrite").save()
    once = shuffled(spark) - start
    assert exact_dedup.exact_dedup(docs).count() == 400
    start = shuffled(spark)
    exact_dedup.exact_dedup(docs).write.format("noop").mode("overwrite").save()
    assert once > 100_000 and shuffled(spark) - start < 2.4 * once


@pytest.mark.parametrize("salted", [False, True])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_of_common_texts(spark, monkeypatch, salted, collide):
    monkeypatch.setattr(exact_dedup, "COMMON", 20 if salted else 1000)
    if collide:
        monkeypatch.setattr(exact_dedup.F, "sha2", lambda col, n: F.when(F.length(col) < 3, F.lit("00" * 32)).otherwise(F.lit("11" * 32)))
    text = F.when(F.col("id") % 2 == 0, F.lit("a b")).when(F.col("id") % 10 == 1, F.concat(F.lit("c"), F.repeat(F.lit(" "), (F.col("id") % 4).cast("int")))).otherwise(F.concat(F.lit("word"), F.col("id") % 7))
    docs = spark.range(0, 100, 1, 5).select(F.col("id").alias("doc_id"), text.alias("text"))
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text.replace(" ", ""), []).append((-len(r.text), r.doc_id))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).drop("text_sha256").collect())) == want
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == [w[0] for w in want if w[3]]


def test_exact_dedup_compares_contents_where_digests_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda col, n: F.lit("00" * 32))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "b")], "doc_id long, text string")
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).orderBy("doc_id").collect()] == [(1, 3, 2), (2, 2, 2), (3, 3, 2), (4, 2, 2)]
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == [2, 3]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_components(values, near):
    name = list(range(len(values)))
    while True:
        new = [min(name[j] for j in range(len(values)) if near(values[i], values[j])) for i in range(len(values))]
        if new == name:
            return name
        name = new


def test_simhash(docs, none):
    own = [r for r in rows() if r[0] is not None]
    prints = [brute_fingerprint(r[1]) for r in own]
    names = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = sorted(((r[0], f"{p:016x}", min(own[j][0] for j in range(len(own)) if names[j] == names[i])) for i, (r, p) in enumerate(zip(own, prints))), key=repr)
    assert got(simhash.simhash_components(docs.where("doc_id is not null"))) == want
    assert simhash.simhash_components(docs).count() == len(rows())
    assert sorted({r.doc_id for r in simhash.simhash_dedup(docs.where("doc_id is not null")).collect()}) == sorted({w[2] for w in want})
    assert simhash.simhash_components(none).count() == simhash.simhash_dedup(none).count() == 0


def test_one_row_stays_of_each_group_whatever_its_ids(spark):
    text, near, other = "a b c d e f g h i j k l m n o p", "A b c d e f g h i j k l m n o  p", "something else that is not like the first at all"
    rows_ = [(1, text, {"x": 1}), (None, near, None), (None, text, None), (7, near, None), (7, other, None), (7, other, None), (8, other, {"y": 2}), (None, "alone and of no id", None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, id map<string,int>").repartition(3)
    out = simhash.simhash_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, text), (7, other), (None, "alone and of no id")], key=repr)


def test_a_very_long_text(spark):
    r = random.Random(12)
    text = " ".join(r.choice(("the", "river", "rose", "and", "fell", "again", "été")) for _ in range(300_000))
    docs = spark.createDataFrame([(1, text, "en"), (2, text.upper(), "en")], "doc_id long, text string, lang string")
    found = {x.doc_id: x.fingerprint for x in simhash.simhash_components(docs).collect()}
    assert found[1] == f"{brute_fingerprint(text):016x}" and found[2] == f"{brute_fingerprint(text.upper()):016x}"
    out = {x.doc_id: x for x in language_id.predict(docs, language_id.prototypes(docs), ["doc_id"]).collect()}
    assert {x.lang_pred for x in out.values()} == {"en"} and out[1].score == pytest.approx(out[2].score)


@pytest.mark.parametrize("block", [3, 1000])
def test_simhash_links_reach_all_that_brute_force_does(spark, block):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype="u8")
    found = {int(b) for b in base}
    for b in base[:10]:  # chains and balls of near fingerprints
        x = int(b)
        for _ in range(30):
            for bit in r.choice(64, r.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            found.add(x)
    values = sorted(found)
    frame = spark.createDataFrame([(int(np.array(v, "u8").view("i8")),) for v in values], "fp long").repartition(3)
    edges = simhash.links(frame, block=block)
    name = {int(np.array(a.node, "i8").view("u8")): a.component for a in connected(edges).collect()}
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    by_got, by_want = {}, {}
    for v, w in zip(values, want):
        by_got.setdefault(name.get(v, ("alone", v)), set()).add(v)
        by_want.setdefault(w, set()).add(v)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_connected(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7)]
    name = {}
    for a, b in edges:
        if a != b:
            name.setdefault(a, a), name.setdefault(b, b)
    for _ in range(len(name)):
        before = dict(name)
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
        if name == before:
            break
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == name
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, docs, none):
    r = random.Random(1)
    said = {"en": "the and of with that have this water stone there".split(), "fr": "les des une avec pour été était dans même où".split(), "de": "der und nicht über mit für straße auch schön ist".split()}
    train = [(i, " ".join(r.choice(said[k]) for _ in range(30)), k) for i in range(120) for k in said]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    known = language_id.prototypes(frame)
    assert sorted(known) == ["de", "en", "fr"]
    test = spark.createDataFrame([(i, " ".join(r.choice(said[k]) for _ in range(12)), k) for i in range(50) for k in said], "doc_id long, text string, lang string")
    out = language_id.predict(test, known, ["doc_id", "lang"]).collect()
    assert sum(x.lang == x.lang_pred for x in out) >= 0.97 * len(out)
    assert all(0 <= x.score <= 1 for x in out)
    odd = language_id.predict(docs, known, ["doc_id", "text"]).collect()
    assert len(odd) == len(rows())
    assert all((x.lang_pred == "und" and x.score == 0) == (not any(c.isalpha() for c in x.text or "")) for x in odd)
    assert language_id.prototypes(none) == {}
    assert {x.lang_pred for x in language_id.predict(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(none, known, ["doc_id"]).count() == 0


def test_language_vectors_are_bound_and_bundled():
    text = "Abc"
    grams, counts = language_id.profile(text)
    signs = language_id.letters()
    a, b, c = 1, 2, 3
    vector = lambda x, y, z: np.roll(signs[2][x], 2) * np.roll(signs[2][y], 1) * signs[2][z]
    assert np.array_equal(counts @ language_id.gram_vectors(grams), vector(0, a, b) + vector(a, b, c) + vector(b, c, 0))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, set(order)
    while left:
        rest = sum(sizes.values()) - sum(fixed.values())
        each = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if each[s] > most * sizes[s]]
        if not over:
            return fixed | each
        for s in over:
            fixed[s] = most * sizes[s]
            left.remove(s)
    return fixed


def test_mixing(spark, docs, none):
    r = random.Random(2)
    data = [(i, " ".join(["w"] * r.randrange(1, 40)), r.choice(["a", "a", "a", "a", "a", "a", "b", "ü", None, "tiny"] if i % 50 == 0 else ["a", "a", "b", "ü", None])) for i in range(3000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    plan = mixing.mix_plan(frame).collect()
    sizes, taken = {}, {}
    source = {i: s for i, _, s in data}
    for x in plan:
        sizes[source[x.doc_id]] = sizes.get(source[x.doc_id], 0) + x.size
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
        assert 0 <= x.taken <= 3 * x.size and all(0 <= s < mixing.SHARDS for s in x.shards)
    want = brute_targets(sizes)
    for x in plan:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert got(mixing.mix_plan(frame.repartition(5))) == sorted(map(tuple, plan), key=repr)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert sorted(x.doc_id for x in mixed.collect()) == sorted(x.doc_id for x in plan for _ in x.shards)
    assert len(mixing.mix_plan(docs).collect()) == len(rows())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(none).count() == mixing.mix(none).count() == 0


def test_the_mix_gives_repeated_rows_their_own_decisions(spark):
    found = [(k, f"s{k % 3}", "w " * (1 + k % 7), k % 2) for k in range(60)]
    found += [(7, "s1", "w " * 8, x) for x in range(5)] + [(None, "s0", "v w", x) for x in range(4)] + [(None, None, None, 0)] * 2
    frame = spark.createDataFrame(found, "doc_id long, source string, text string, n long")
    plan = mixing.mix_plan(frame).collect()
    mixed = mixing.mix(frame).collect()
    assert sorted((repr(x.doc_id), len((x.text or "").split())) for x in mixed) == sorted((repr(x.doc_id), x.size) for x in plan for _ in x.shards)
    assert {tuple(x) for x in mixed} <= set(found)
    assert sorted(map(repr, map(tuple, mixing.mix(frame.repartition(7)).collect()))) == sorted(map(repr, map(tuple, mixed)))
    # No window on the way holds texts: rows meet their decisions in a join on the id.
    plain = mixing.mix(frame.where("doc_id is not null and doc_id <> 7"))._jdf.queryExecution().toString()
    assert "Window" not in plain


def brute_taken(data, plan, blocks, seed):
    """taken and the number of copies of each document by the rule, from sizes, targets and block hashes."""
    out = {}
    by_source = {}
    for x in plan:
        by_source.setdefault(data[x.doc_id], []).append(x)
    for rows_ in by_source.values():
        size, target = rows_[0].source_size, rows_[0].target
        passes = int(target // size) if size else 0
        due, last = max(0, round(target - passes * size)), {}
        for b in sorted({blocks[x.doc_id][0] for x in rows_}):
            own = sorted((x for x in rows_ if blocks[x.doc_id][0] == b), key=lambda x: (blocks[x.doc_id][1], x.doc_id))
            if due > 0:
                before = 0
                for x in own:
                    last[x.doc_id] = int(before + x.size / 2 <= due)
                    before += x.size
            due -= sum(x.size for x in own)
        missed = max(0, round(target - passes * size)) - sum(x.size for x in rows_ if last.get(x.doc_id))
        able = [x for x in rows_ if missed and 0 < x.size < 2 * abs(missed) and bool(last.get(x.doc_id)) == (missed < 0)]
        odd = min(able, key=lambda x: (abs(abs(missed) - x.size), blocks[x.doc_id][2], x.doc_id), default=None)
        for x in rows_:
            out[x.doc_id] = passes + last.get(x.doc_id, 0) + ((1 if missed > 0 else -1) if odd is x else 0)
    return out


@pytest.mark.parametrize("group", [mixing.GROUP, 2])
def test_the_mix_comes_through_the_tree(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    r = random.Random(5)
    data = [(i, " ".join(["w"] * r.randrange(1, 30)), r.choice("aaaabbcde")) for i in range(2500)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_plan(frame).collect()
    hashed = frame.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(mixing.BLOCKS)), F.xxhash64("doc_id", F.lit(mixing.SEED + 1)), F.xxhash64("doc_id", F.lit(mixing.SEED + 3))).collect()
    blocks = {x[0]: tuple(x[1:]) for x in hashed}
    source = {i: s for i, _, s in data}
    copies = brute_taken(source, plan, blocks, mixing.SEED)
    assert {x.doc_id: len(x.shards) for x in plan} == copies and all(x.taken == copies[x.doc_id] * x.size for x in plan)
    # Of a source, one pass's blocks go whole to one shard each, in the order of shards; shards get even numbers of blocks of all sources.
    quota = {}
    for x in plan:
        for turn, shard in enumerate(x.shards):
            quota.setdefault((source[x.doc_id], turn, blocks[x.doc_id][0]), set()).add(shard)
    for s in "abcde":
        order = [quota[k] for k in sorted(k for k in quota if k[0] == s)]
        alone = [min(x) for x in order if len(x) == 1]
        assert len(order) - len(alone) <= 2 and sum(a > b for a, b in zip(alone, alone[1:])) <= 1  # but for one document added or left out
    n = np.bincount([min(x) for x in quota.values()], minlength=mixing.SHARDS)
    assert np.ptp(n) <= 16 and (n > 0).all()
    again = {x.doc_id: x for x in mixing.mix_plan(frame, seed=mixing.SEED + 100).collect()}
    assert all(again[x.doc_id].target == pytest.approx(x.target) for x in plan) and any(again[x.doc_id].shards != x.shards for x in plan)


def test_split_quotas():
    quotas = np.array([1000, 0, 37, 5000, 1])
    out = mixing.split_quotas(quotas, 13, 4)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 4
    assert np.array_equal(out, mixing.split_quotas(quotas, 13, 4)) and not np.array_equal(out, mixing.split_quotas(quotas, 13, 5))
    due = np.array([6000, 0, 38])
    out = mixing.split_quotas(quotas, 3, 4, due)
    assert (out.sum(axis=0) == quotas).all() and (out.sum(axis=1) == due).all()
