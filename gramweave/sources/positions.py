"""Places in texts that are joined to one, in the order of their ids, with a separator before each and one at the end; and back.

`with_offsets` says where each text starts. A place follows from a text's start by an addition; the way back is an as-of join: the last start that isn't after the
place. Starts and distinct places are dealt to buckets of the joined text, and a text that reaches into a bucket from before starts there too, so a bucket has a bounded
number of rows and no range of starts is compared with all places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramweave.sources.texts import numbered

#: Characters of a bucket.
WIDTH = 1 << 16


def with_offsets(rows: DataFrame, id_col: str) -> DataFrame:
    """id, offset, size: where each text starts if all are joined in the order of their ids, one separator before each and one at the end. Null texts are empty ones."""
    sized = numbered(rows.select(id_col, F.coalesce(F.length("text"), F.lit(0)).alias("n")), [id_col], "no")
    dealt = sized.withColumn("part", F.floor(F.col("no") / 4096))
    totals = dealt.groupBy("part").agg(F.sum(F.col("n") + 1).alias("c"))
    starts = totals.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inside = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("o", inside).join(starts, "part").select(id_col, (F.col("o") + F.col("s") + 1).alias("offset"), F.col("n").cast("long").alias("size"))


def to_joined(found: DataFrame, offsets: DataFrame, id_col: str, at: str) -> DataFrame:
    """found with `at` in its text replaced by the place in the joined text; rows of texts without an offset go."""
    return found.join(offsets.select(F.col(id_col), F.col("offset").alias("__o")), id_col).withColumn(at, F.col(at) + F.col("__o")).drop("__o")


def to_texts(places: DataFrame, offsets: DataFrame, id_col: str, at: str, width: int = WIDTH) -> DataFrame:
    """Adds id and x, the text that holds the place `at` of the joined text and where in it; both are null at a separator, outside, and for null. Columns of these names are replaced."""
    starts = offsets.where("size > 0").select(F.col(id_col).alias("__id"), "offset", (F.col("offset") + F.col("size")).alias("end"))
    reach = starts.select("*", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("end") - 1) / width))).alias("__b"))
    events = reach.select("__b", F.greatest("offset", F.col("__b") * width).alias("__p"), F.lit(False).alias("__asked"), F.struct("offset", "end", "__id").alias("start"))
    asked = places.where(F.col(at).isNotNull()).select(F.floor(F.col(at) / width).alias("__b"), F.col(at).cast("long").alias("__p")).distinct()
    asked = asked.select("__b", "__p", F.lit(True).alias("__asked"), F.lit(None).cast(events.schema["start"].dataType).alias("start"))
    order = Window.partitionBy("__b").orderBy("__p", "__asked").rowsBetween(Window.unboundedPreceding, 0)  # a bucket has at most `width` places
    met = events.unionByName(asked).withColumn("start", F.last("start", ignorenulls=True).over(order)).where("__asked and __p < start.end")
    found = met.select("__p", F.col("start.__id").alias(id_col), (F.col("__p") - F.col("start.offset")).alias("x"))
    return places.drop(id_col, "x").join(found, F.col(at) == F.col("__p"), "left").drop("__p")
