"""Rank and select on bit, character and run-length vectors, kept as rows.

A vector is its rows (vec, pos, bit or ch). A long vector is counted in blocks, whose totals are summed first, so that no task sees
a whole one. rank excludes its position; select and positions count from 0. Starts of blocks are as many as vectors, and Spark takes
them for as small as the file that vectors are exploded from, so their join names its kind: else they go whole to the driver, for broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _rank(rows: DataFrame, keys: list[str], amount) -> DataFrame:
    """Adds rank: the sum of amount over smaller positions with the same keys."""
    dealt = rows.withColumn("__a", amount).withColumn("__b", F.floor(F.col("pos") / BLOCK))
    totals = dealt.groupBy(*keys, "__b").agg(F.sum("__a").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inside = F.coalesce(F.sum("__a").over(Window.partitionBy(*keys, "__b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__i", inside).join(starts.hint("merge"), [*keys, "__b"]).withColumn("rank", F.col("__i") + F.col("__s")).drop("__a", "__b", "__i", "__s")


def bit_rank(bits: DataFrame) -> DataFrame:
    """vec, pos, bit, rank: ones before each position."""
    return _rank(bits, ["vec"], F.col("bit").cast("long"))


def bit_select(bits: DataFrame) -> DataFrame:
    """vec, k, pos, gap: the place of the k-th one, and how far the one before it is; for k = 0 its place plus 1."""
    ones = bit_rank(bits).where("bit = 1").select("vec", F.col("rank").alias("k"), "pos")
    before = F.lag("pos").over(Window.partitionBy("vec").orderBy("pos"))
    return ones.withColumn("gap", F.col("pos") - F.coalesce(before, F.lit(-1)))


def bit_predecessor(bits: DataFrame) -> DataFrame:
    """vec, pos, predecessor, circular_rank: the nearest one before each position (null if none) and its number, the last one's if none."""
    ranked = bit_rank(bits)
    at = Window.partitionBy("vec").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ones = F.sum(F.col("bit").cast("long")).over(Window.partitionBy("vec"))
    number = F.when(F.col("rank") > 0, F.col("rank") - 1).otherwise(ones - 1)
    return ranked.select("vec", "pos", F.last(F.when(F.col("bit") == 1, F.col("pos")), ignorenulls=True).over(at).alias("predecessor"), number.alias("circular_rank"))


def char_rank_select(chars: DataFrame) -> DataFrame:
    """vec, ch, k, pos: the place of the k-th occurrence of each character; k is also its rank there."""
    return _rank(chars.select("vec", "pos", "ch"), ["vec", "ch"], F.lit(1).cast("long")).select("vec", "ch", F.col("rank").alias("k"), "pos")


def runs(chars: DataFrame) -> DataFrame:
    """vec, run_id, head, start, len: runs of equal characters; with a column sa, also its value at both ends."""
    order = Window.partitionBy("vec").orderBy("pos")
    sa = F.col("sa") if "sa" in chars.columns else F.lit(None).cast("long")
    edge = chars.withColumn("__sa", sa).withColumn("__new", (~F.col("ch").eqNullSafe(F.lag("ch").over(order))).cast("long")).withColumn("run_id", F.sum("__new").over(order) - 1)
    out = edge.groupBy("vec", "run_id").agg(F.min("ch").alias("head"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("len"), F.min_by("__sa", "pos").alias("first_sa"), F.max_by("__sa", "pos").alias("last_sa"))
    return out if "sa" in chars.columns else out.drop("first_sa", "last_sa")


def run_of(found: DataFrame, places: DataFrame) -> DataFrame:
    """vec, pos, run_id, last: the run of each place (vec, pos), and the last place of that run."""
    dealt = found.select("vec", "run_id", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("len") - 1) / BLOCK))).alias("__b"), "start", "len")
    met = places.withColumn("__b", F.floor(F.col("pos") / BLOCK)).join(dealt, ["vec", "__b"]).where("pos >= start and pos < start + len")
    return met.select("vec", "pos", "run_id", (F.col("start") + F.col("len") - 1).alias("last"))


def run_rank(found: DataFrame) -> DataFrame:
    """vec, run_id, head, start, len, rank: how often a run's character occurs before the run."""
    before = Window.partitionBy("vec", "head").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("vec", "run_id", "head", "start", "len", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("rank"))


def run_text(found: DataFrame) -> DataFrame:
    """vec, text: the characters of the runs in order."""
    parts = F.sort_array(F.collect_list(F.struct("run_id", F.expr("repeat(head, cast(len as int))").alias("t"))))
    return found.groupBy("vec").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def alphabet_stats(texts: DataFrame) -> DataFrame:
    """ch, n, n_docs: how often and in how many texts each character occurs."""
    chars = texts.where("text is not null").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("c")).groupBy("ch").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))
