"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations are learned so that the signs of a rotated vector are a balanced binary code of 64 bits each (PCA, then alternating
signs and Procrustes). What is coded is the part of a unit vector that is orthogonal to the sample's mean direction: vectors of one
model often share a direction, and signs of the whole would then be alike for all of them. But the link is on the cosine of the
whole vectors, so tables are planned by the angle that linked vectors can have in their coded parts:

* Vectors whose share of the mean direction is at most COMMON form the first cell of their label. With shares up to s, a pair of cosine c
  has an angle of at most arccos((c - s^2) / (1 - s^2)) there, a share of bits differs accordingly, and that gives how many tables of
  how many bits leave a miss of at most MISS. The larger the cell, the more bits a table takes, so buckets keep their size.
* The others, with all that can link to one of them, form the second cell. The nearer their shares are to 1, the less their coded parts
  say, and the fewer bits a table may have; none at all (one table, each pair compared) where the shares alone make a link.

In a bucket, pairs within the Hamming radius of the first 64 bits are retrieved, those that an earlier table has are left to it, and
the rest are reranked by cosine in double precision. A vector's links are counted and linked vectors get a root within the bucket, so
a group of near copies costs rows, not pairs. A hot bucket is cut into blocks, and each two blocks are compared, so no task holds it
whole and no pair is lost.

Equal vectors with one label are one entry with a weight. The rotations are fitted to the SAMPLE vectors with the least hashes, shares
and sizes come from all. Labels of any type are told apart by their XXH64, together with the vectors' length.

Cases: a null label, or a vector that is null, empty, zero or holds a null, NaN or infinity, links with nothing; vectors of
different lengths don't link; repeated rows, and rows of one id with unlike vectors, count as vectors of their own; ids may be of any type that has an
order; a null id names no component that has another id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TILE, connected, slices, sorted_groups, tiles, written

BITS, ROTATIONS, SAMPLE, ROUNDS, SEED = 64, 4, 20_000, 50, 5
LINK, BLOCK = 0.93, 2048
#: The share of the mean direction above which vectors are searched in a cell of their own, and the chance that a pair at the limit shares no bucket.
COMMON, MISS = 0.85, 5e-4
#: The least bits of a table, the most, the most tables, and what a row in a table costs, in comparisons.
LEAST_BITS, MOST_BITS, MOST_TABLES, ROW = 3, 20, 64, 3000
#: Rows that are held against others at once, and the share of their pairs above which all of these are compared.
TOGETHER, DENSE = 256, 0.05


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    vectors = vectors.astype("f8")
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def fit(sample: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The mean direction of unit vectors, and ROTATIONS projections of what is orthogonal to it, to 64 balanced directions each."""
    axis = sample.mean(axis=0)
    axis = axis / max(float(np.sqrt(axis @ axis)), 1e-12)
    rest = sample - np.outer(sample @ axis, axis)
    _, _, axes = np.linalg.svd(rest, full_matrices=False)
    axes = axes[:BITS].T
    low = np.zeros((len(rest), BITS))
    low[:, : axes.shape[1]] = rest @ axes
    full = np.zeros((rest.shape[1], BITS))
    full[:, : axes.shape[1]] = axes
    turns = []
    for number in range(ROTATIONS):
        turn = np.linalg.qr(np.random.default_rng(seed + number).normal(size=(BITS, BITS)))[0]
        for _ in range(rounds):
            signs = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(low.T @ signs)
            turn = u @ v
        turns.append(full @ turn)
    return axis, np.hstack(turns)


def coded(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The share of the mean direction and the code (ROTATIONS x uint64) of each unit vector.

    Vectors of another length than the fitted one have no share; they are coded whole, by random directions.
    """
    axis, turn = model
    if vectors.shape[1] != len(axis):
        axis = np.zeros(vectors.shape[1])
        turn = np.random.default_rng(SEED).normal(size=(vectors.shape[1], ROTATIONS * BITS))
    share = vectors @ axis
    rest = vectors - np.outer(share, axis)
    return share, np.packbits(rest @ turn >= 0, axis=1, bitorder="little").view("<u8")


def codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return coded(vectors, model)[1]


def differing(link: float, share: float) -> float:
    """The share of bits that differ between coded parts of vectors of cosine `link`, at most; share: of the mean direction, at most."""
    least = (link - share * share) / max(1 - share * share, 1e-12)
    return float(np.arccos(np.clip(least, -1, 1)) / np.pi)


@lru_cache(4096)
def plan(n: int, p: float) -> tuple[int, int, int]:
    """Bits of a table, tables and Hamming radius for n vectors and a share p of bits that differ."""
    radius = min(BITS, int(np.ceil(BITS * p + 5 * np.sqrt(BITS * p * (1 - p)))))
    if p >= 0.5:
        return 0, 1, radius
    found = []
    for bits in range(LEAST_BITS, MOST_BITS + 1):
        tables = int(np.ceil(np.log(MISS) / np.log(1 - (1 - p) ** bits))) if p > 0 else 1
        if tables <= MOST_TABLES:
            found.append((tables * (n / 2**bits + ROW), bits, tables))
    cost, bits, tables = min(found, default=(np.inf, 0, 1))
    if p > 0.2 and n + ROW <= cost:  # tables would cost more than they spare
        return 0, 1, radius
    return bits, tables, radius


@lru_cache(64)
def places(bits: int, tables: int) -> np.ndarray:
    """tables x bits: which bits of the code a table takes. No two tables share one while there are enough."""
    rng = np.random.default_rng(SEED)
    if bits * tables <= ROTATIONS * BITS:
        return np.arange(bits * tables).reshape(tables, bits)
    return np.stack([rng.choice(ROTATIONS * BITS, bits, replace=False) for _ in range(tables)])


def keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables: the key of each code (rows x ROTATIONS) in each table."""
    if not bits:
        return np.zeros((len(code), tables), "u4")
    ones = np.unpackbits(np.ascontiguousarray(code).view("u1").reshape(len(code), -1), axis=1, bitorder="little")
    return (ones[:, places(bits, tables)].astype("u4") << np.arange(bits, dtype="u4")).sum(axis=2, dtype="u4")


def by_length(lists: list) -> list[np.ndarray]:
    """The places of the lists of each length."""
    sizes = np.array([len(x) for x in lists])
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over the edges a-b."""
    found = np.arange(n)
    while True:
        was = found.copy()
        least = np.minimum(found[a], found[b])
        np.minimum.at(found, a, least)
        np.minimum.at(found, b, least)
        found = found[found]
        if (found == was).all():
            return found


def rows_of(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def links(vectors: np.ndarray, code: np.ndarray, own: np.ndarray, radius: int, link: float, a: np.ndarray, b: np.ndarray, able: np.ndarray | None = None):
    """Links (places) between the places a and b of unit vectors, or among a if it is b: cosines of pairs within the radius that share no earlier key.

    own: the keys of earlier tables. able: if given, one of a pair at least must be.
    """
    among = a is b
    for at in range(0, len(a), TOGETHER):
        left = a[at : at + TOGETHER]
        right = b[at + 1 :] if among else b
        if not len(right):
            return
        near = np.bitwise_count(code[left, :1] ^ code[right, 0]) <= radius
        if among:
            near &= np.arange(len(left))[:, None] <= np.arange(len(right))[None, :]
        if able is not None:
            near &= able[left, None] | able[right]
        if near.mean() > DENSE:
            for k in range(own.shape[1]):
                near &= own[left, k, None] != own[right, k]
        if near.mean() > DENSE:
            near &= vectors[left] @ vectors[right].T >= link
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
        else:
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            keep = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", vectors[i[x : x + 65536]], vectors[j[x : x + 65536]]) >= link for x in range(0, len(i), 65536))])
            i, j = i[keep], j[keep]
        new = (own[i] != own[j]).all(axis=1)
        yield i[new], j[new]


def _entries(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, label, v), and one entry (node, least, weight, label, v) for each label and vector that can link; least: its least id. node is a number that holds once it is written."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    inf = float("inf")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)
    able = rows.where("label is not null and v is not null").where(F.coalesce(sound, F.lit(False)))
    entries = able.groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    return rows, entries.select(F.monotonically_increasing_id().alias("node"), "least", "weight", "label", "v")


def _coded(entries: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """entries with share and c0, c1 ... (the code)."""
    words = [f"c{i}" for i in range(ROTATIONS)]

    def work(batches):
        for batch in slices(batches, 4096):
            lists = batch.column(batch.num_columns - 1)
            share, code = np.zeros(len(lists)), np.zeros((len(lists), ROTATIONS), "u8")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                share[at], code[at] = coded(unit(rows_of(lists.take(pa.array(at)))), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share), *(pa.array(code[:, i].view("i8")) for i in range(ROTATIONS))], names=[*batch.schema.names, "share", *words])

    more = [T.StructField("share", T.DoubleType()), *(T.StructField(w, T.LongType()) for w in words)]
    return entries.mapInArrow(work, T.StructType([*entries.schema.fields, *more]))


def _plans(coded: DataFrame, link: float, common: float) -> DataFrame:
    """cell (0 or 1), label_key, bits, tables, radius: one row for each cell with two members or more."""
    share = F.abs("share")
    least = float(np.cos(min(np.arccos(common) + np.arccos(link), np.pi / 2)))
    first, second = share <= common, share >= least
    stats = coded.groupBy("label_key").agg(
        F.count(F.when(first, 1)).alias("n0"), F.max(F.when(first, share)).alias("s0"),
        F.when(F.max(share) > common, F.count(F.when(second, 1))).otherwise(0).alias("n1"), F.max(share).alias("s1"),
    )
    cells = stats.select("label_key", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"n{c}").alias("n"), F.col(f"s{c}").alias("s")) for c in (0, 1)])).alias("c")).select("label_key", "c.*").where("n > 1")

    def work(batches):
        for batch in batches:
            found = [plan(1 << (n - 1).bit_length(), round(min(1.0, 1.05 * differing(link, s)), 3)) for n, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], names=["label_key", "cell", "bits", "tables", "radius"])

    return cells.mapInArrow(work, "label_key long, cell int, bits int, tables int, radius int")


def _found(coded: DataFrame, link: float, block: int, common: float) -> DataFrame:
    """node, root, n: the links of each node in each tile, summed, with a node it is connected to."""
    plans = written(_plans(coded, link, common), "embedding-plans")
    share, words = F.abs("share"), [f"c{i}" for i in range(ROTATIONS)]
    least = float(np.cos(min(np.arccos(common) + np.arccos(link), np.pi / 2)))
    dealt = coded.join(plans, "label_key").where(F.when(F.col("cell") == 0, share <= common).otherwise(share >= least))
    dealt = dealt.select("label_key", "cell", "bits", "tables", "radius", *words, "node", "weight", (share > common).alias("common"), "v")

    def list_(batches):
        for batch in slices(batches, 2048):
            own = np.stack([batch.column(i).to_numpy() for i in range(5, 5 + ROTATIONS)], axis=1).view("u8")
            label, cell, bits, tables = (batch.column(i).to_numpy() for i in range(4))
            for w, t in np.unique(np.stack([bits, tables], axis=1), axis=0).tolist():
                at = np.flatnonzero((bits == w) & (tables == t))
                table = np.tile(np.arange(t, dtype="i4"), len(at))
                with np.errstate(over="ignore"):
                    x = (label[at].view("u8") * np.uint64(2) + cell[at].astype("u8"))[:, None] + (np.arange(t, dtype="u8") * np.uint64(1 << MOST_BITS) + keys(own[at], w, t)) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = x ^ (x >> np.uint64(29))
                some = batch.take(pa.array(np.repeat(at, t)))
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view("i8")), pa.array(table), *some.columns], names=["bucket", "t", *some.schema.names])

    listed = dealt.mapInArrow(list_, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("t", T.IntegerType()), *dealt.schema.fields]))

    def search(batches):
        for tile in sorted_groups(batches, TILE):
            tile = tile.combine_chunks()
            mark = np.stack([tile[c].to_numpy() for c in ("label_key", "cell", "t")], axis=1)
            for which in np.unique(mark, axis=0) if (mark != mark[0]).any() else mark[:1]:  # but for a collision of buckets, one
                group = tile.filter(pa.array((mark == which).all(axis=1))) if (mark != which).any() else tile
                if group.num_rows < 2:
                    continue
                node, weight, blocks = (group[c].to_numpy() for c in ("node", "weight", "block"))
                cell, table, bits, tables, radius = (group[c][0].as_py() for c in ("cell", "t", "bits", "tables", "radius"))
                own = unit(rows_of(group["v"].combine_chunks()))
                code = np.stack([group[w].to_numpy() for w in words], axis=1).view("u8")
                earlier = keys(code, bits, tables)[:, :table]
                lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
                a = np.flatnonzero(blocks == lo)
                b = a if lo == hi else np.flatnonzero(blocks == hi)
                able = group["common"].to_numpy(zero_copy_only=False) if cell else None
                counts, ends = np.zeros(len(node), "i8"), []
                for i, j in links(own, code, earlier, radius, link, a, b, able):
                    counts += np.bincount(i, weight[j], len(node)).astype("i8") + np.bincount(j, weight[i], len(node)).astype("i8")
                    ends.append((i, j))
                    if sum(len(x) for x, _ in ends) > 1 << 20:
                        ends = [_forest(len(node), ends)]
                if (linked := np.flatnonzero(counts)).size:
                    root = roots(len(node), *(np.concatenate(x) for x in zip(*ends, strict=True)))
                    yield pa.record_batch([pa.array(node[linked]), pa.array(node[root[linked]]), pa.array(counts[linked])], names=["node", "root", "n"])

    return tiles(listed, "node", block, hot_only=True).mapInArrow(search, "node long, root long, n long")


def _forest(n: int, ends: list) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect the same."""
    root = roots(n, *(np.concatenate(x) for x in zip(*ends, strict=True)))
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", link: float = LINK, block: int = BLOCK, sample: int = SAMPLE, common: float = COMMON) -> DataFrame:
    """One row per row of vectors: the id, n_links (other vectors linked directly), component_id (the least id that links reach), kept (it is the row's own id)."""
    rows, entries = _entries(vectors, id_col, vector_col, label_col)
    entries = written(entries.withColumn("label_key", F.xxhash64("label", F.size("v"))).select("node", "least", "weight", "label", "label_key", "v"), "embedding-entries")
    lists = [x[0] for x in entries.orderBy(F.xxhash64("label", "v"), "v").limit(sample).select("v").collect()]
    alone = [F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    if not lists:
        return rows.select(*alone)
    model = fit(unit(np.array([lists[i] for i in max(by_length(lists), key=len)])))
    known_codes = written(_coded(entries.select("node", "weight", "label_key", "v"), model), "embedding-codes")
    found = written(_found(known_codes, link, block, common), "embedding-links")
    parts = written(connected(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "embedding-parts")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    own = entries.select("node", "least")
    heads = written(parts.join(own, "node").groupBy("component").agg(F.min("least").alias("head")), "embedding-heads")
    placed = parts.join(heads, "component").select("node", "head", F.lit(True).alias("placed"))
    known = entries.join(counts, "node", "left").join(placed, "node", "left")
    head = F.when(F.col("placed"), F.col("head")).otherwise(F.col("least"))
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), head.alias("head"), F.lit(True).alias("able"))
    out = rows.join(known, ["label", "v"], "left")
    component = F.when(F.col("able"), F.col("head")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
