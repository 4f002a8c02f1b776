"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-gramweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has yet, in the application's own folder."""
    return f"{shared_dir(spark)}/gramweave/{spark.sparkContext.applicationId}/{_scope.get()}{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table: their lineage ends there, and what uses them twice reads them twice."""
    return written_to(rows, shared_path(rows.sparkSession, name))


def written_to(rows: DataFrame, path: str) -> DataFrame:
    """As written(), at a path that may be of another scope: what scratch() deletes is told by where its path was made."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver collects them as garbage, which a large heap puts off beyond the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession) -> int:
    """Into how many buckets tables are dealt: as many as the session's shuffles have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(rows: DataFrame, path: str, keys: list[str], n: int, placed: bool = False) -> DataFrame:
    """The rows from a table at path, dealt to n buckets by keys and sorted by them in each. Joins and groups on these keys read it without a shuffle. placed: the rows of each bucket already lie in one partition."""
    spark, name = rows.sparkSession, f"gramweave_{uuid.uuid4().hex}"
    dealt = rows if placed else rows.repartition(n, *keys)
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return _resolved(spark, name)


def open_bucketed(spark: SparkSession, path: str, keys: list[str], n: int) -> DataFrame:
    """A table that bucketed() wrote, in this session or in an earlier one."""
    name, by = f"gramweave_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {n} buckets location '{path}'")
    return _resolved(spark, name)


def _resolved(spark: SparkSession, name: str) -> DataFrame:
    """The table without its name in the catalog: it is external, so its files stay."""
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder of any store holds, in order; nothing if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, wherever that is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at the end: what is to stay must be written to a path from before."""
    name = f"scratch-{uuid.uuid4().hex}/"
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, f"{shared_dir(spark)}/gramweave/{spark.sparkContext.applicationId}/{name}")
