"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt to blocks by a seeded hash, which permutes them. A source's target, in words, becomes whole
passes over its blocks and a last pass that ends in the block where the target is reached; inside that block documents are
taken in hashed order while they come nearer to the target, and one document of the source is left out, or added as a block of its
own, if that comes nearer still. The exact block quotas of all sources are then split among the
output shards by a tree: at each node the left half gets as many blocks as its shards are due, drawn from the node's quotas by
one multivariate-hypergeometric draw, and the right half the rest. A shard takes its quota of each source's blocks where the
shard before stopped, so shards hold disjoint blocks, and its documents are shuffled locally by hash.

The draw factors: the tree first splits the quotas of groups of about GROUP sources, then those of each group's sources among the
shards, with what each shard is due of the group. So a task holds a row for each of GROUP sources, or for each group; sources are
ranked from totals of ranges, and the level of the targets comes from sums over all. Of each source there are at most BLOCKS rows of
totals; documents are never collected. Reruns agree: every draw is seeded, and hashes take the document's id.

Cases: a null text has size 0; a null source is a source of its own, last in order; sources of size 0 have target 0; rows with
one id lie in one block and are taken one by one; empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramweave.sources.texts import numbered

from .shared import NOT_SPACE, written

WEIGHTS, MOST, BLOCKS, SHARDS, SEED = (1, 2, 3), 3, 4096, 16, 11
#: Sources whose quotas are split in one task.
GROUP = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0)).cast("long")


def split_quotas(quotas: np.ndarray, shards: int, seed: int, due: np.ndarray | None = None) -> np.ndarray:
    """shards x sources: how many of each source's blocks each shard gets. due: how many of all each shard gets; evenly, if not given."""
    out = np.zeros((shards, len(quotas)), dtype="i8")

    def node(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        first = int(own.sum()) * (mid - lo) // (hi - lo) if due is None else int(due[lo:mid].sum())
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, first, method="marginals") if len(own) else own
        node(lo, mid, left)
        node(mid, hi, own - left)

    node(0, shards, quotas.astype("i8"))
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target (double) to a row for each source (key, source_size; a written table): the words of all sources, shared by the weights
    in the order of key, none above `most` times its source's size; what that cuts off is shared again by weight.

    A level is what is left for each unit of weight. From one that no source limits, sources above their limit are set to it and the rest
    is levelled again, until no more are: a few sums over all sources, of whole numbers, so reruns agree.
    """
    turn = numbered(sizes, ["key"], "turn").withColumn("turn", F.col("turn") - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = written(turn.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most).drop("turn"), "mix-weights")
    words_of_all, of_all = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, cut = (words_of_all or 0) / (of_all or 1), 0
    while True:
        full = ranked.where(F.col("limit") <= F.col("weight") * F.lit(level)).agg(F.count(F.lit(1)), F.sum("limit"), F.sum("weight")).first()
        if full[0] == cut or full[2] == of_all:
            break
        cut, level = full[0], (words_of_all - full[1]) / (of_all - full[2])
    return ranked.withColumn("target", F.least(F.col("limit").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("weight", "limit")


def _ends(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """key, ends: up to which of a source's blocks (key, n) each shard takes them."""
    groups = max(1, -(-quotas.count() // GROUP))
    dealt = quotas.withColumn("group", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).cast("int"))

    def of_groups(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("group")
        return pd.DataFrame({"group": found["group"], "due": list(split_quotas(found["n"].to_numpy(), shards, seed).T)})

    def of_sources(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("key")
        ends = split_quotas(found["n"].to_numpy(), shards, seed + 1 + int(found["group"].iloc[0]), np.asarray(found["due"].iloc[0])).cumsum(axis=0)
        return pd.DataFrame({"key": found["key"], "ends": list(ends.T)})

    sums = dealt.groupBy("group").agg(F.sum("n").alias("n")).groupBy(F.lit(0).alias("all")).applyInPandas(lambda found: of_groups(found[["group", "n"]]), "group int, due array<long>")
    return dealt.join(written(sums, "mix-groups"), "group").groupBy("group").applyInPandas(of_sources, "key string, ends array<long>")


def _inside(rows: DataFrame, dealt: DataFrame, seed: int) -> DataFrame:
    """rows with the columns of their block, and whether the last pass takes them."""
    before = Window.partitionBy("key", "block").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2 <= F.col("due")
    return rows.join(dealt, ["key", "block"]).withColumn("in_last", F.col("last") & near)


def _correction(sized: DataFrame, dealt: DataFrame, seed: int) -> DataFrame:
    """key, block, odd_id, odd_size, odd: for each source, the document that brings the last pass nearest to what is due if it is added (odd = 1) or left out (-1)."""
    taken = _inside(sized, dealt, seed).groupBy("key").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("in_last"), F.col("size"))), F.lit(0))).alias("missed"))
    # By way of the blocks: joined to rows by source, what a source misses would draw all its rows to one task.
    placed = _inside(sized, dealt.join(taken.where("missed <> 0"), "key"), seed)
    odd = F.signum("missed").cast("int")
    able = placed.where(F.when(F.col("missed") > 0, ~F.col("in_last")).otherwise(F.col("in_last")) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("missed")))
    best = F.min(F.struct(F.abs(F.abs("missed") - F.col("size")).alias("off"), F.xxhash64("id", F.lit(seed + 3)).alias("turn"), "id", "size", "block", odd.alias("odd"))).alias("best")
    return able.groupBy("key").agg(best).select("key", "best.block", F.col("best.id").alias("odd_id"), F.col("best.size").alias("odd_size"), "best.odd")


def _plan(sized: DataFrame, weights: Sequence[int], most: int, shards: int, seed: int) -> DataFrame:
    """sized (key, id, size, block and others; a table) with source_size, target and shards (one for each copy that the mix takes)."""
    blocks = written(sized.groupBy("key", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sizes = written(blocks.groupBy("key").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("blocks")), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = targets(sizes, weights, most).withColumn("passes", whole.cast("long")).withColumn("rest", F.greatest(F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"), F.lit(0)))
    aims = written(aims, "mix-targets")
    order = Window.partitionBy("key").orderBy("block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(aims, "key").withColumn("rank", F.row_number().over(order) - 1).withColumn("due", F.col("rest") - before)  # due: of the last pass, from here on
    placed = written(placed.withColumn("last", F.col("due") > 0).drop("words"), "mix-places")
    odd = written(_correction(sized, placed.select("key", "block", "rest", "due", "last"), seed), "mix-corrections")
    quotas = placed.groupBy("key").agg(F.max(F.col("passes") * F.col("blocks")).alias("whole"), F.count(F.when(F.col("last"), 1)).alias("more"))
    quotas = quotas.join(odd.where("odd > 0").select("key", "odd"), "key", "left").select("key", "more", (F.col("whole") + F.col("more") + F.coalesce("odd", F.lit(0))).alias("n"))
    quotas = written(quotas, "mix-quotas")
    ends = written(_ends(quotas.select("key", "n"), shards, seed).join(quotas.select("key", "more"), "key"), "mix-ends")
    shard = lambda at: F.size(F.filter("ends", lambda end: end <= at))
    copies = F.col("passes") + F.col("last").cast("long")
    all_shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda n: shard(n * F.col("blocks") + F.col("rank")))).otherwise(F.array().cast("array<int>"))
    added = shard(F.col("passes") * F.col("blocks") + F.col("more")).alias("added")  # an added document is the block after the last
    dealt = written(placed.join(ends, "key").select("key", "block", "source_size", "target", "passes", "rest", "due", "last", all_shards.alias("shards"), added), "mix-shards")
    out = _inside(sized, dealt.join(odd, ["key", "block"], "left"), seed)
    odd_one = F.when(F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("size") == F.col("odd_size")), F.col("odd")).otherwise(0)
    kept = F.slice("shards", F.lit(1), (F.col("passes") + F.col("in_last").cast("long") + F.least(odd_one, F.lit(0))).cast("int"))
    more = F.when(odd_one > 0, F.array("added")).otherwise(F.array().cast("array<int>"))
    return out.withColumn("shards", F.concat(kept, more)).drop("passes", "rest", "due", "last", "in_last", "key", "block", "odd_id", "odd_size", "odd", "added")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, *more: Column) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))  # code points, the null last
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), words(F.col(text_col)).alias("size"), F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(BLOCKS)).cast("int").alias("block"), *more)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: the id, size (words), source_size, target (of its source, in words), shards (array: where each copy goes), taken (words, repeats counted)."""
    plan = _plan(written(_keyed(docs, id_col, source_col, text_col, seed), "mix-sizes"), weights, most, shards, seed)
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", "shards", (F.col("size") * F.size("shards")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of the mix with the columns of docs, repeats included: each shard's rows together, in a shuffled order.

    Shards are decided on ids and sizes. The decisions are then joined to the rows, by the id and a hash of source and text, so whole rows are
    in no window and a source of any size is as many tasks as it has rows for.
    """
    mark = F.xxhash64(source_col, text_col).alias("mark")
    sized = written(_keyed(docs, id_col, source_col, text_col, seed, mark), "mix-sizes")
    taken = _plan(sized, weights, most, shards, seed).where(F.size("shards") > 0).select(F.col("id").alias("taken_id"), F.col("mark").alias("taken_mark"), "shards")
    taken = written(taken, "mix-taken")
    whole = docs.select(F.col(id_col).alias("id"), mark, F.struct("*").alias("row"))
    same = whole["id"].eqNullSafe(taken["taken_id"]) & (whole["mark"] == taken["taken_mark"])
    if not sized.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # Rows of one id, source and text: each gets one decision of theirs, or none where these run out.
        turns = Window.partitionBy("id", "mark").orderBy(F.xxhash64(F.to_json("row")))
        whole = whole.withColumn("turn", F.row_number().over(turns))
        taken = taken.withColumn("taken_turn", F.row_number().over(Window.partitionBy("taken_id", "taken_mark").orderBy("shards")))
        same = same & (whole["turn"] == taken["taken_turn"])
    plan = whole.join(taken, same)
    copies = plan.select("row", "id", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64("id", "copy", F.lit(seed + 2))
    # A shard is shuffled in pieces: 64, or more where the session's partitions, which are sized for the input, ask for it.
    pieces = max(64, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    spread = copies.withColumn("order", order).repartition("shard", F.pmod("order", F.lit(pieces)))
    return spread.sortWithinPartitions("shard", "order").select("row.*")
