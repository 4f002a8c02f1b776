"""Line dedup against levelled sorted runs of line hashes.

A run is a table of hashes with the document that holds each, dealt to buckets by hash and sorted in them. A batch of documents finds the
first document of each of its hashes, merge-anti-joins them with all runs, which are read without a shuffle, and what is left
is a run of its own on level 0. A level with `fan` runs is compacted to one run of the level above before the next batch, so a store
of n batches has about fan * log(n) runs and a hash is rewritten log(n) times. A line stays where its document is the one that its
hash's new entry names. That is an anti-join on hash and document together, so a line that a third of all documents hold is no hot key, and
the first documents are minima that tasks combine before they shuffle.

A hash is the first 16 bytes of a key's SHA-256. All of it is SQL functions on DataFrames.

Cases: a null text is an empty one, and an empty one is one empty line; rows with one id are one document, whose texts keep each other's
lines; a null id comes after all others; a document of which all lines go has an empty text; an empty table gives an empty result; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.sources.tables import bucketed, buckets, names_in, open_bucketed

from .shared import new_path, other_columns, remove, written

#: Code points from which a key counts, batches that a table is read in, and runs that a level holds.
LEAST, BATCHES, FAN = 10, 4, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of dropped places up to which they go to every executor, so that texts aren't shuffled.
SMALL = 16 << 20


def key_of(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_only = F.octet_length(bare) == F.length(bare)  # then lower() has no other letters to change
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """id, text_hash, at, hash: the lines with keys of `least` code points or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    keyed = cut.select("id", "text_hash", "at", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("id", "text_hash", "at", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash"))


class LineRuns:
    """A store of runs in a folder: level and number of a run, and its buckets, are in its name. Opening the folder again goes on with it."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.runs: dict[str, tuple[int, DataFrame]] = {}
        self.last = -1
        for name in names_in(spark, self.folder):
            level, number, n = (int(x) for x in name.split("-"))
            self.last = max(self.last, number)
            files = names_in(spark, f"{self.folder}/{name}")
            if "_SUCCESS" in files and any(f.startswith("part-") for f in files):  # complete and not empty
                self.runs[name] = level, open_bucketed(spark, f"{self.folder}/{name}", ["hash"], n)

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        n = buckets(self.spark)
        self.last += 1
        name = f"{level:03}-{self.last:09}-{n}"
        self.runs[name] = level, bucketed(rows, f"{self.folder}/{name}", ["hash"], n)
        return self.runs[name][1]

    def compact(self) -> None:
        """Merges the runs of each level that is full to one of the level above. Runs hold different hashes, so this is their union."""
        level = 0
        while level <= max((at for at, _ in self.runs.values()), default=-1):
            full = [name for name, (at, _) in self.runs.items() if at == level]
            if len(full) >= self.fan:
                rows = self.runs[full[0]][1]
                for name in full[1:]:
                    rows = rows.unionByName(self.runs[name][1])
                self._write(rows, level + 1)
                for name in full:
                    del self.runs[name]
                    remove(self.spark, f"{self.folder}/{name}")
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the hashes of a batch (id, text_hash, at, hash) that no run has; returns the rows of the batch whose lines go."""
        self.compact()
        first = lines.groupBy("hash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
        new = first.select("hash", F.col("first.id").alias("id"))
        for _, run in self.runs.values():
            new = new.join(run.select("hash").hint("merge"), "hash", "left_anti")
        own = self._write(new, 0).select(F.col("hash").alias("__hash"), F.col("id").alias("__id"))
        return lines.join(own, (F.col("hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id")), "left_anti")


def bounds_of(docs: DataFrame, id_col: str, batches: int) -> list:
    """At most batches - 1 ids, in order, that cut the rows in about equal parts; the ids may be of any type that has an order."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").repartitionByRange(batches, "id")
    found = sorted(r.low for r in ids.groupBy(F.spark_partition_id()).agg(F.min("id").alias("low")).collect())  # a row for each range
    return sorted({found[len(found) * i // batches] for i in range(1, batches)}) if found else []


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES, store: LineRuns | None = None) -> DataFrame:
    """id, text_hash, at: the lines that go, as batches of ascending ids go through the store (a new one, if none is given). A written table."""
    spark = docs.sparkSession
    bounds = bounds_of(docs, id_col, batches)
    batch = F.lit(0)
    for low in bounds:
        batch = batch + F.when(F.col("id").isNull() | (F.col("id") >= F.lit(low)), 1).otherwise(0)
    path = new_path(spark, "lines")
    lines = lines_of(docs, id_col, text_col, least).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(path)
    store = LineRuns(spark, new_path(spark, "line-runs")) if store is None else store
    out = None
    for number in range(len(bounds) + 1):
        own = spark.read.schema(lines.schema).parquet(path).where(F.col("batch") == number).drop("batch")
        gone = written(store.add(own).select("id", "text_hash", "at"), "dropped-lines")
        out = gone if out is None else out.unionByName(gone)
    remove(spark, path)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES, store: LineRuns | None = None) -> DataFrame:
    """All rows and columns of docs, the text without the lines that go (a null text is an empty one), with n_lines (before) and n_dropped in place of columns of these names."""
    gone = dropped_lines(docs, id_col, text_col, least, batches, store)
    places = gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("__gone"))
    places = places.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    if gone.count() * 24 <= SMALL:
        places = F.broadcast(places)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__own"), F.xxhash64(text).alias("__text_hash"), F.split(text, "\n").alias("__lines"))
    met = rows.join(places, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    # The lines are cut below the join and looked up by place above it: each is touched once, however many a text has.
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    whole = [kept.alias(text_col) if c == text_col else F.col("__row").getField(c).alias(c) for c in other_columns(docs, "n_lines", "n_dropped")]
    return met.select(*whole, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_lines, n_dropped and kept_sha256 of each row."""
    rows = dedup_lines(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    return rows.select(id_col, "n_lines", "n_dropped", F.sha2(text_col, 256).alias("kept_sha256"))
