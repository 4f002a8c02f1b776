"""Matching texts that arrive as a stream against patterns or queries that are at rest, and patterns that arrive as a stream against a stored index.

Each text stands for itself, so a micro-batch needs no state and no watermark: a batch is matched as a table is. Batches are written
under their number, and a batch that is repeated after a failure replaces what it wrote.

A stream of patterns is joined to the index's tables by the engine, as any stream is to tables at rest, so its result is a stream that any sink takes. An
occurrence that several pieces of a pattern lead to is kept for the first of them, so no state is needed to tell repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramweave.functions.strings import mismatches
from gramweave.operators import locate, mem
from gramweave.operators.index import GramIndex


def match_stream(stream: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that writes match(batch) for each batch of stream as Parquet to out/batch=N. once: ends when all input at hand is read."""

    def write(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def locate_stream(texts: DataFrame, patterns: DataFrame, out: str, checkpoint: str, most: int = 0, once: bool = False) -> StreamingQuery:
    """Where the patterns occur in a stream of texts (doc_id, text) with at most `most` mismatches."""
    return match_stream(texts, lambda batch: locate.locate(batch, patterns, most), out, checkpoint, once)


def mem_stream(texts: DataFrame, queries: DataFrame, k: int, out: str, checkpoint: str, once: bool = False, **more) -> StreamingQuery:
    """Maximal exact matches of the queries in a stream of texts."""
    return match_stream(texts, lambda batch: mem.mems(batch, queries, k, **more), out, checkpoint, once)


def locate_pattern_stream(patterns: DataFrame, texts: DataFrame, index: GramIndex, most: int = 0) -> DataFrame:
    """pattern_id, doc_id, x, mismatches, as a stream: where the patterns of a stream (pattern_id, pattern) occur in the texts of a stored index.

    Each of a pattern's most + 1 pieces needs the length that the index is for; a shorter pattern is an error. Null patterns have no occurrences.
    """
    w, s, length = index.w, index.s, F.length("pattern")
    checked = F.when(F.floor(length / (most + 1)) >= index.least, F.col("pattern")).otherwise(F.raise_error(F.lit(f"this index needs patterns of {index.least * (most + 1)} characters or more")))
    rows = patterns.where("pattern is not null").select("pattern_id", checked.alias("pattern"))
    begin = lambda part: F.floor(part * F.length("pattern") / F.lit(most + 1)).cast("int")
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("part"))
    seeds = parts.select("*", F.explode(F.sequence(begin(F.col("part")), begin(F.col("part")) + s - 1)).alias("at"))
    seeds = seeds.withColumn("gram", F.expr(f"substring(pattern, at + 1, {w})"))
    met = index.hits(seeds).select("pattern_id", "pattern", "doc_id", "part", (F.col("x") - F.col("at")).alias("x")).where("x >= 0")
    held = met.join(texts.select("doc_id", "text"), "doc_id").where(F.col("x") + length <= F.length("text"))
    held = held.withColumn("window", F.substring("text", F.col("x").cast("int") + 1, length)).drop("text")
    # Of a piece that begins at b, the gram at b + (-(x + b) mod s) is at a place that the index has.
    at = lambda part: begin(part) + F.pmod(-(F.col("x") + begin(part)), F.lit(s)).cast("int")
    same = lambda part: F.substring("window", at(part) + 1, F.lit(w)) == F.substring("pattern", at(part) + 1, F.lit(w))
    first = ~F.exists(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda part: part < F.col("part")), same)
    found = held.where(first).select("pattern_id", "doc_id", "x", mismatches(F.col("window"), F.col("pattern")).alias("mismatches"))
    return found.where(F.col("mismatches") <= most)
