"""SimHash near-dedup through an inverted index on byte positions with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4 bytes in
place. The index lists fingerprints by bytes in place. A list for one byte in place would hold a 256th of all of them, so a
list is for three bytes in place: 20 triples of positions meet every set of 4 positions (of each two halves of the positions
the pairs of one half go with the next). Pairs that meet in a list tally their shared bytes; those with 4 or more are verified
by their bits. The tally is made where a pair meets, from both fingerprints, and not by counting in how many lists it meets: to be counted,
every pair of every list would have to be shuffled. On 0.5 GB of the check tool's documents (236,000 fingerprints) lists for single bytes would
hold some 870 million pairs, were bytes even; those for three bytes had 4.7 million entries, of which 131,000 were in a list with others.
Equal fingerprints are one entry.

A list is searched from link to link: each fingerprint reached is held against those not reached yet, so a list of near copies
costs about its length, and gives the edges of a spanning forest, not its pairs. A long list is cut into blocks, and each two
blocks are searched together, so no task holds a whole hot list and no pair is lost.

Cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; with fewer words than a
shingle the whole sequence is the one shingle; repeated rows and equal texts have equal fingerprints and so one component; a
null id is no component's name unless its component has no other; `simhash_dedup` keeps one row of each component, told by id and
text, and one of repeated rows; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TILE, connected, one_each, slices, sorted_groups, tiles, written

WORDS, BITS, SEED = 4, 4, 42
#: Fingerprints in a block of a long list.
BLOCK = 50_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions, of which each set of 4 positions holds one.

    With positions dealt to three groups in a circle, those are the triples within a group and those of two from one group and one
    from the next.
    """
    group = {p: p % 3 for p in range(8)}
    out = []
    for t in combinations(range(8), 3):
        g = sorted(group[p] for p in t)
        if g[0] == g[2] or any(g.count(k) == 2 and g.count((k + 1) % 3) == 1 for k in range(3)):
            out.append(t)
    return out


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash over the shingles of `words` words, repeats included: a bit is set if it is set in over half of their XXH64."""
    import xxhash

    # bytes.split parts exactly at the white space of ASCII
    line = b" ".join((text or b"").translate(LOWER).split())
    if not line:
        return 0
    spaces = np.flatnonzero(np.frombuffer(line, dtype="u1") == 32)
    if len(spaces) < words:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(line)]
    h = xxhash.xxh64_intdigest
    seed = SEED
    return bits_of(np.array([h(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], dtype="u8"))


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes of all shingles; zero for none."""
    found, ones = hashes.astype("<u8"), np.zeros(64, dtype="i8")
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, *more: Column) -> DataFrame:
    """id, fp (the bits of the fingerprint as a long) of each row, and more columns."""

    def work(batches):
        for batch in slices(batches):
            found = [fingerprint(t, words) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, dtype="u8").view("i8")), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    rows = docs.select(F.col(text_col).alias("fp"), F.col(id_col).alias("id"), *more)
    return rows.mapInArrow(work, T.StructType([T.StructField("fp", T.LongType()), *rows.schema.fields[1:]]))


def forest(found: np.ndarray, bits: int, blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (as places in found) of a spanning forest of the links; of those between two blocks only, if blocks are given."""
    out, rest = [], np.arange(len(found))
    least = 8 - bits
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            apart = found[rest] ^ found[at]
            near = np.count_nonzero(apart.view("u1").reshape(-1, 8) == 0, axis=1) >= least  # the tally of shared bytes in place
            near[near] = np.bitwise_count(apart[near]) <= bits
            if blocks is not None:
                near &= blocks[rest] != blocks[at]
            if near.any():
                new = rest[near]
                out += [(at, x) for x in new.tolist()]
                queue += new.tolist()
                rest = rest[~near]
    return out


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """a, b (longs): edges between the fingerprints `fp` of distinct that connect what the links of up to `bits` bits connect."""
    if not 0 <= bits <= 4:
        raise ValueError("the index is for up to 4 bits")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    triples = position_triples()
    key = lambda i, t: F.lit(i << 24) + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2])
    listed = distinct.select("fp", F.explode(F.array(*[key(i, t).cast("long") for i, t in enumerate(triples)])).alias("bucket"))

    def search(batches):
        for group in sorted_groups(batches, TILE):
            found = np.ascontiguousarray(group["fp"].to_numpy()).view("u8")
            apart = group["lo"][0].as_py() != group["hi"][0].as_py()  # the pairs of one block meet in a tile of their own
            if edges := forest(found, bits, group["block"].to_numpy() if apart else None):
                a, b = np.array(edges).T
                yield pa.record_batch([pa.array(found[a].view("i8")), pa.array(found[b].view("i8"))], names=["a", "b"])

    return tiles(listed, "fp", block).mapInArrow(search, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    parts = connected(links(distinct, bits, block)).withColumnRenamed("node", "fp")
    named = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-components")  # a plain table, for the planner to split a large component
    by_fp = named.join(first, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The rows of docs that name their component (least id, then text): one document of each group of near copies, with the columns of docs."""

    def find() -> tuple[DataFrame, DataFrame]:
        rows = written(fingerprints(docs, id_col, text_col, words, F.xxhash64(text_col).alias("text_hash")), "simhash")
        least = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("least"))
        parts = connected(links(least.select("fp"), bits, block)).withColumnRenamed("node", "fp")
        heads = least.join(parts, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("head"))
        return heads.select("head.id", "head.text_hash"), rows

    return one_each(docs, id_col, text_col, find)
