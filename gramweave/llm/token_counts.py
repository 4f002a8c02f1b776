"""Token counts through a digest cache.

Texts are normalised as far as the tokenizer can't tell (for one that drops white space, runs of ASCII white space become one
space), digested, and joined to a stored table of counts by the digests of content and tokenizer. Only the distinct texts
that the table lacks are encoded; their counts are appended to it, and a later run over the same texts encodes nothing. The table is
stored by tokenizer, and of its counts only those of the run's own digests go on.

Cases: a null text counts as empty, with 0 bytes and tokens; repeated rows and equal texts share one entry and each get their
row; a cache that doesn't exist yet is made; entries that two runs append at once are read as one; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, written
from .tokens import drops_space, encoder

CACHE = "digest binary, n_tokens long, tokenizer string"
#: Bytes of a run's digests up to which they go to every executor.
SMALL = 8 << 20


def tokenizer_version(path: str) -> str:
    """Names the tokenizer by its file's content and the library's release, so that a change of either misses the cache."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    return f"{body[:32]}-{sentencepiece.__version__ if path.endswith('.model') else tokenizers.__version__}"


def content(text: Column, tokenizer: str) -> Column:
    """The text as far as the tokenizer can tell texts apart."""
    text = F.coalesce(text, F.lit(""))
    if tokenizer.endswith(".model"):
        return text
    with open(tokenizer, encoding="utf-8") as f:
        return F.regexp_replace(text, f"{SPACE}+", " ") if drops_space(json.load(f)) else text


def read_cache(spark, cache: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_tokens, over_limit (more tokens than limit). Appends to the table at cache."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    digest = F.unhex(F.sha2("content", 256))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(whole).cast("long").alias("n_bytes"), content(F.col(text_col), tokenizer).alias("content"))
    rows = written(rows.withColumn("digest", digest).drop("content"), "token-rows")
    asked = rows.select("digest").distinct()
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    known = None
    if not stored.isEmpty():
        if rows.count() * 40 <= SMALL:  # then the stored counts needn't be shuffled
            asked = F.broadcast(asked)
        met = stored.join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        known = written(met, "token-counts")

    def counted(batches):
        for batch in batches:
            ends, _ = encoder(tokenizer).encode(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends))], names=["digest", "n_tokens"])

    texts = docs.select(content(F.col(text_col), tokenizer).alias("content")).select(digest.alias("digest"), "content")
    missing = texts if known is None else texts.join(known, "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("content").alias("content"))
    counts = written(distinct.mapInArrow(counted, "digest binary, n_tokens long"), "token-counts")  # a plain table: the planner can split the rows of a common text in the join
    counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = counts if known is None else counts.unionByName(known)
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
