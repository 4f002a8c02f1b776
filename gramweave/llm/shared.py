"""What several operators need: tables in the shared folder and streams of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.sources.tables import remove, scratch, shared_path as new_path, written  # noqa: F401

#: The white space of ASCII, as a character class that Java, RE2 and Python read alike.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def other_columns(rows: DataFrame, *names: str) -> list[str]:
    """The columns of rows with other names than these, told apart as the session does."""
    strict = rows.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    own = (lambda c: c) if strict else str.lower
    gone = {own(n) for n in names}
    return [c for c in rows.columns if own(c) not in gone]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that a worker holds few texts as Python objects; what Arrow has no more use for goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal, non-null integer keys in a sorted stream; only the run that is open is held."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype("i8") for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(found)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(found[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(found[lo])
    if held:
        yield pa.Table.from_batches(held)


#: What names a tile; tiles() sorts by these.
TILE = ["bucket", "lo", "hi"]


def tiles(rows: DataFrame, member: str, most: int, hot_only: bool = False) -> DataFrame:
    """Deals the rows of every `bucket` (long) with two members or more to tiles of at most twice about `most` rows.

    A bucket of up to `most` rows is one tile. A larger one is cut by the hash of `member` into blocks of about `most` rows,
    and each pair of blocks is a tile, so any two members meet in some tile. Members of one block meet in several: in a tile
    with lo < hi, only pairs from two blocks count. Adds `lo`, `hi` and `block` (ints). Sorted by TILE within partitions.

    hot_only: buckets of one member are tiles too, and only those of more than `most` rows are looked up: for wide rows, few of
    which are alone, as the table of these buckets is small and the rows needn't be shuffled to meet it.
    """
    # A plain table, not an aggregate beneath the join: the planner can then split the rows of a hot bucket.
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (most if hot_only else 1))
    counts = written(sizes, "bucket-sizes")
    dealt = (
        rows.join(counts, "bucket", "left" if hot_only else "inner")
        .withColumn("__blocks", F.coalesce(F.ceil(F.col("__n") / F.lit(most)), F.lit(1)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(member, F.lit("block")), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("lo", F.least("block", "__other"))
        .withColumn("hi", F.greatest("block", "__other"))
    )
    return dealt.drop("__n", "__blocks", "__other").repartition(*TILE).sortWithinPartitions(*TILE)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b: long) reaches.

    Large-star and small-star steps alternate until the edges are stars, O(log n) rounds. Each step's minima and edges are
    written tables: a hub's neighbours are folded into a minimum before a shuffle, and as both sides of the joins are plain
    tables, the planner can split a hub's edges among tasks. Nothing comes to the driver but a count.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    # u > v throughout
    now, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large, large_path = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near, near_path = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        star = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after, new = kept(large.join(near, "u").select(F.explode(star).alias("e")).select("e.*").where("u <> v").distinct())
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (path, least_path, large_path, near_path):
            remove(spark, old)
        now, path = after, new
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())



def one_each(docs: DataFrame, id_col: str, text_col: str, find) -> DataFrame:
    """The rows of docs that find() names, one for each, with the columns of docs.

    find() gives heads (id, text_hash: XXH64 of the text) and the same of all rows. Its tables are deleted when the heads are written.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "heads")
    with scratch(spark):
        heads, names = find()
        heads.distinct().write.parquet(path)
        repeated = not names.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        schema = heads.schema
    heads = spark.read.schema(schema).parquet(path)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    met = whole.join(heads, whole["id"].eqNullSafe(heads["id"]) & (whole["text_hash"] == heads["text_hash"]), "left_semi")
    return (met.dropDuplicates(["id", "text_hash"]) if repeated else met).select("row.*")
