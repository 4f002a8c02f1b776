"""Token ids in ORC: stripes of run-length coded integers, with row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of their id and sorted, so the files in order of their names hold ascending ids and the
statistics of files, stripes and row groups cut most of them off when a few ids are asked for. A large file is read by several
tasks, each its own stripes. `part` and `at` give a document's file and its place there, so that running totals need only
the totals of the parts.

Cases: a null text is an empty one, of which only the end id is written; null ids come first; rows with one id are ordered by
their text; an empty table gives files without rows; other columns are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

END = 1
STRIPE, ROWS = 64 << 20, 1000  # bytes of a stripe, rows of a row group: documents are long rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, files: int | None = None) -> None:
    """Encodes every text, appends the end id, and writes doc_id, part, at, n_tokens, tokens as ORC files in ascending order of ids.

    files: how many ranges of ids; unset, spark.sql.shuffle.partitions, which is sized for the input.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def encoded(batches):
        for batch in batches:
            starts, ids = encoder(tokenizer).encode(batch.column(1))
            ids = np.insert(ids, starts[1:], end)
            starts = starts + np.arange(len(starts))
            for at in range(0, batch.num_rows, 1024):
                own = starts[at : at + 1025]
                tokens = pa.ListArray.from_arrays(pa.array((own - own[0]).astype("i4")), pa.array(ids[own[0] : own[-1]].astype("i4")))
                yield pa.record_batch([batch.column(0).slice(at, 1024), pa.array(np.diff(own)), tokens], names=["doc_id", "n_tokens", "tokens"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    # The text's beginning too, so that rows with one id, or none, can be dealt to several tasks.
    dealt = rows.repartitionByRange(files, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    place = F.monotonically_increasing_id()  # the number of the partition, shifted by 33 bits, and the row in it
    (
        dealt.mapInArrow(encoded, f"doc_id {kind}, n_tokens long, tokens array<int>")
        .withColumn("place", place)
        .select("doc_id", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"), "n_tokens", "tokens")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROWS))
        .option("orc.stripe.size", str(STRIPE))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """What write_tokens wrote. ids: only these documents; statistics and Bloom filters keep other stripes and row groups unread."""
    out = spark.read.orc(path)
    return out if ids is None else out.where(F.col("doc_id").isin(ids))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32 bits)."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "part", "at", "tokens").mapInArrow(digest, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    # The totals are read from n_tokens alone; one row a file is left for the window over all.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(parts, "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
