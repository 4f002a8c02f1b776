"""Exact dedup by skew-safe combining.

Rows are first combined within their task, then digest groups are merged under a salt (the task's number, for digests that many rows have), then
the winners of the salts are combined for each digest. The digest only deals rows out: groups are of the whole normalised content, so two texts
with one digest stay apart. A text that a third of all rows hold reaches a shuffle once a task.

Digests are counted first. One of few rows has one salt only, so its contents are complete before the last stage and don't move again: there it brings
a row for each content it has. If any digest has several, all contents take part in the last stage too.

Cases: a null text counts as empty; empty texts are one group; of equal texts the one with the most code points in its original
text stays, then the smallest id (of any type that has an order; a null id comes last); repeated rows with one id and one text are members like any other, and
`dedup` keeps one of them; an empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, written

SALTS = 32
#: A digest is salted if at least so many rows have it, and one row in so many of all: at most SHARE digests.
COMMON, SHARE = 1000, 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _digest(norm: str) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _common(norms: DataFrame) -> DataFrame:
    """digest, is_common: the digests that are salted."""
    counts = written(norms.select(_digest("norm").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "exact-counts")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return written(counts.where(F.col("n") >= max(COMMON, rows // SHARE)).select("digest", F.lit(True).alias("is_common")), "exact-common")


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """digest, content (only where one digest has several contents), keep_id, keep_chars, group_size; a written table."""
    norm = normalised(F.col(text_col)).alias("norm")
    chars, digest, salt = F.length(F.coalesce(text_col, F.lit(""))), _digest("norm"), F.spark_partition_id() % salts
    rows = docs.select(F.col(id_col).alias("id"), chars.alias("chars"), norm).select("id", "chars", "norm", digest.alias("digest"), salt.alias("salt"))
    rows = rows.join(F.broadcast(_common(docs.select(norm))), "digest", "left").withColumn("salt", F.when(F.col("is_common"), F.col("salt")).otherwise(-1))
    best = F.min(F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().alias("none"), "id"))
    # The planner combines this one within each task before it shuffles.
    salted = rows.groupBy("digest", "salt", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))

    def merged(content: Column) -> DataFrame:
        parts = salted.select("digest", content.alias("content"), "best", "n", (F.col("salt") < 0).cast("long").alias("whole")).repartition("digest")
        whole = parts.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.sum("whole").alias("whole"))
        several = F.count(F.lit(1)).over(Window.partitionBy("digest"))  # over 1 only where a digest collides
        shown = ["digest", F.when(F.col("several") > 1, F.col("content")).alias("content"), F.col("best.id").alias("keep_id"), (-F.col("best.short")).alias("keep_chars"), "group_size", "whole"]
        return written(whole.withColumn("several", several).select(*shown), "exact-groups")

    groups = merged(F.when(F.col("salt") >= 0, F.col("norm")))
    if not groups.where("whole > 1").isEmpty():  # a digest that isn't salted has several contents
        groups = merged(F.col("norm"))
    return groups.drop("whole")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: the id, keep_id (of the row that stays), group_size, kept, text_sha256 (of the normalised text)."""
    groups = _groups(docs, id_col, text_col, salts)
    rows = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    shown = [F.col(id_col), "keep_id", F.col("group_size").cast("long"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    out = rows.drop("norm").join(groups.where("content is null").drop("content", "keep_chars"), "digest").select(*shown)
    mixed = groups.where("content is not null")
    if not mixed.isEmpty():
        out = out.unionByName(rows.join(mixed.withColumnRenamed("content", "norm"), ["digest", "norm"]).select(*shown))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one of each group of equal texts."""
    groups = _groups(docs, id_col, text_col, salts)
    whole = docs.select(F.struct("*").alias("row"))
    name = lambda c: F.col("row").getField(c)
    text = normalised(name(text_col))
    # Winners meet their rows by digest and id together, so a common text is no hot key here either.
    key = lambda digest, id_: F.concat(F.lower(F.hex(digest)), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null")))
    rows = whole.withColumn("key", key(F.unhex(F.sha2(text, 256)), name(id_col))).withColumn("chars", F.length(F.coalesce(name(text_col), F.lit(""))))
    winners = groups.select(key(F.col("digest"), F.col("keep_id")).alias("key"), "content", F.col("keep_chars").alias("chars"))
    met = rows.join(winners, ["key", "chars"]).where(F.col("content").isNull() | (F.col("content") == text))
    return met.dropDuplicates(["key", "chars", "content"]).select("row.*")
