"""The manifest against plain level-by-level hashing: all sizes around whole blocks, appends, nulls, repeated rows, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gramweave.llm import merkle
from gramweave.llm.shared import new_path

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, block string, witness int, id int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fan=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def path(tree, at, fan=3):
    """The digests beside a leaf, level by level, and where it stands in each run."""
    out = []
    for level in tree[:-1]:
        run = level[at // fan * fan : at // fan * fan + fan]
        out.append((at % fan, run[: at % fan] + run[at % fan + 1 :]))
        at //= fan
    return out


def fold(digest, steps):
    for at, beside in steps:
        digest = sha("".join([*beside[:at], digest, *beside[at:]]))
    return digest


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault("" if r[1] is None else "=" + r[1], []).append(r)
    made = {}
    for name, own in trees.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[name] = levels([leaf(r) for r in own])
    names = sorted(made, key=lambda n: n.encode())
    top = levels([made[n][-1][0] for n in names])
    out = []
    for name, own in trees.items():
        for at, r in enumerate(own):
            steps = path(made[name], at) + path(top, names.index(name))
            touched = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0 and r[4] is not None
            root = top[-1][0]
            end = fold(leaf((*r[:4], r[4].replace("\n", "")) if touched else r), steps)
            out.append((r[0], leaf(r), made[name][-1][0], root, sha("".join(d for _, s in steps for d in s)), end, end == root))
    return sorted(out, key=repr)


def made(seed=0, n=90):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot"] * 4 + ["a", "b", "", "ä", None]), r.choice(["en", None]), r.choice([None, 7]), r.choice(["one\ntwo", "é\n\n日本", "", "no break", None, "x" * 50_000 + "\n"])) for i in range(n)]
    return [*rows, rows[2], rows[2], (5, "hot", None, None, "another row of one id"), (None, "hot", None, None, "no id\n"), (None, None, None, None, None), (3, "alone", "en", 1, "a\nb")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "b", 2, 3) for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 6])
def test_equals_plain_hashing(spark, monkeypatch, height):
    monkeypatch.setattr(merkle.Manifest.__init__, "__defaults__", (3, height))
    rows = made()
    out = merkle.tamper_check(table(spark, rows))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(out) == brute(rows)


def test_small_tables(spark):
    for rows in ([], made()[:1], [(1, None, None, None, "a\nb"), (2, None, None, None, "\n")]):
        assert result(merkle.tamper_check(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 29, 80, 81, 82, 100])
def test_open_runs(n):
    """In blocks of 27 nodes and of 9, each closed at its end: witnesses and roots are those of the whole."""
    nodes = [sha(str(i)) for i in range(n)]
    want = levels(nodes)
    for height in (2, 3):
        width, below, paths = 3**height, [bytes.fromhex(x) for x in nodes], [[] for _ in nodes]
        size = 1
        while True:
            up = len(below) > width
            out = []
            for at in range(0, len(below), width):
                runs = merkle.OpenRuns()
                found = [runs.append(d) for d in below[at : at + width]]
                out.append(runs.close(height if up else None))
                for i, witness in enumerate(found):
                    for w in paths[(at + i) * size : (at + i + 1) * size]:
                        w += witness
            below, size = out, size * width
            if not up:
                break
        assert below[0].hex() == want[-1][0]
        for i, witness in enumerate(paths):
            assert [(e[0], [e[k : k + 32].hex() for k in range(1, len(e), 32)]) for e in witness] == path(want, i)
            assert merkle.folded(bytes.fromhex(nodes[i]), witness).hex() == want[-1][0]


def test_appends_give_what_one_append_gives(spark):
    rows = [r for r in made(1, 70) if r[0] is not None and r[0] < 70]
    folder = new_path(spark, "manifest")
    for low, high in ((0, 5), (5, 30), (30, 31), (31, 70)):
        part = [r for r in rows if low <= r[0] < high]
        merkle.Manifest(spark, folder, height=1).append(merkle.leaves_of(table(spark, part)))
    got = merkle.Manifest(spark, folder, height=1).witnesses()
    out = merkle.fold(got, "digest").select("id", *[F.lower(F.hex(c)).alias(c) for c in ("digest", "subroot", "root", "proof", "folded_root")])
    want = [(i, a, b, c, d, c) for i, a, b, c, d, _, _ in brute(rows)]
    assert result(out) == sorted(want, key=repr)
    with pytest.raises(Exception, match="above those"):
        merkle.Manifest(spark, folder, height=1).append(merkle.leaves_of(table(spark, [(1, "hot", None, None, "late")])))


def test_closed_blocks_stay_as_they_are(spark):
    """A later append writes no leaf again that lies in a closed block."""
    folder = new_path(spark, "manifest")
    docs = lambda a, b: table(spark, [(i, "s", None, None, str(i)) for i in range(a, b)])
    for a, b in ((0, 20), (20, 22)):
        merkle.Manifest(spark, folder, height=2).append(merkle.leaves_of(docs(a, b)))
    ids = lambda path: sorted(r.id for r in spark.read.parquet(f"{folder}/{path}").collect())
    assert ids("0/closed-0") == list(range(18)) and ids("0/open-0") == [18, 19]
    assert ids("1/closed-0") == [] and ids("1/open-0") == [18, 19, 20, 21]
