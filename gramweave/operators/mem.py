"""Maximal exact matches between texts and queries.

Of a match of at least k characters, some gram of w characters starts at a multiple of s in the text, if w + s - 1 <= k. So the texts
give their grams at every s-th place only, with up to s - 1 characters on either side. Grams that a text and a query share are hits
(x, i). Along a diagonal x - i, hits at consecutive multiples of s overlap and are one match, which goes on less than s characters
beyond them; those are found in what the first and the last hit have beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramweave.functions.strings import char_at, common_prefix, one_of, only_of
from gramweave.operators import grams
from gramweave.operators.index import GramIndex, grams_in_context, stride_of
from gramweave.operators.locate import SMALL, smaller
from gramweave.sources.tables import written
from gramweave.sources.texts import carried, kmers


def _leading(text: Column, core: str | None) -> Column:
    """The first characters of a text that are all of core."""
    if core is None:
        return text
    marked = F.translate(text, core, core[0] * len(core)) if core else text
    run = F.length(text) - F.length(F.ltrim(marked, F.lit(core[:1])))
    return F.substring(text, F.lit(1), run)


def islands(texts: DataFrame, queries: DataFrame, k: int, core: str | None = None, index: GramIndex | None = None) -> DataFrame:
    """doc_id, query_id, x, i, d: all maximal runs of at least k shared characters (of core, if given), ends of texts included.

    index: the stored grams of the texts, for matches of up to k characters; then the texts aren't cut.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if index is not None and index.least > k:
        raise ValueError(f"the index is for matches of {index.least} characters or more")
    w, s = (index.w, index.s) if index is not None else stride_of(k)
    if index is None and grams.small(queries, 24):
        hits = grams.hits(texts, queries, w, s, core)
    else:
        asked = grams_in_context(queries, "query_id", "i", w, s, 1, "q")
        if core is not None:
            asked = asked.where(only_of(F.col("gram"), core))
        asked = smaller(asked, F.length("text") * (4 * w + 8 * s + 64), of=queries)
        hits = grams_in_context(texts, "doc_id", "x", w, s, s, "t").join(asked, "gram") if index is None else index.hits(asked)
        sides = [common_prefix(_leading(F.col(f"t_{c}"), core), F.col(f"q_{c}")).cast("long") for c in ("before", "after")]
        hits = hits.select("doc_id", "query_id", "x", "i", sides[0].alias("b"), sides[1].alias("a"))
    # What ends on both sides within s - 1 characters is known whole here, and of the index's length at least or no match.
    hits = hits.where(F.col("a") + F.col("b") >= s - 1).withColumn("diagonal", F.col("x") - F.col("i"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "query_id", "diagonal").orderBy("x"))
    runs = hits.withColumn("island", F.col("x") / s - turn).groupBy("doc_id", "query_id", "diagonal", "island")
    found = runs.agg(F.min("x").alias("x"), F.min("i").alias("i"), F.max("x").alias("end"), F.min_by("b", "x").alias("b"), F.max_by("a", "x").alias("a"))
    grown = found.withColumn("d", F.col("end") - F.col("x") + w + F.col("b") + F.col("a")).where(F.col("d") >= k)
    return grown.select("doc_id", "query_id", (F.col("x") - F.col("b")).alias("x"), (F.col("i") - F.col("b")).alias("i"), "d")


def around(found: DataFrame, rows: DataFrame, id_col: str, at: str, before: str, after: str) -> DataFrame:
    """Adds the characters before and after each match in its text or query; null at an end."""
    text = rows.select(F.col(id_col), F.col("text").alias("__text"))
    start = F.col(at).cast("int")
    return found.join(text, id_col).withColumn(before, char_at(F.col("__text"), start - 1)).withColumn(after, char_at(F.col("__text"), start + F.col("d").cast("int"))).drop("__text")


def mems(texts: DataFrame, queries: DataFrame, k: int, core: str | None = None, context: str | None = None, boundary: str = "strict", index: GramIndex | None = None) -> DataFrame:
    """doc_id, query_id, x, i, d: matches of at least k characters that no pair of neighbouring characters extends.

    texts: doc_id, text; queries: query_id, text. core: characters that a match may hold; context: characters that may stand
    beside it (all, if not given). boundary: `strict` reports a match only where all four neighbours exist, `open` also at ends. index: a stored index of the texts.
    """
    if boundary not in ("strict", "open"):
        raise ValueError("boundary is strict or open")
    found = islands(texts, queries, k, core, index)
    if core is None and context is None and boundary == "open":
        return found
    found = around(around(found, texts, "doc_id", "x", "tb", "ta"), queries, "query_id", "i", "qb", "qa")
    for a, b in (("tb", "qb"), ("ta", "qa")):
        found = found.where(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b)))
    for c in ("tb", "ta", "qb", "qa"):
        if boundary == "strict":
            found = found.where(F.col(c).isNotNull())
        if context is not None:
            found = found.where(F.col(c).isNull() | one_of(F.col(c), context))
    return found.select("doc_id", "query_id", "x", "i", "d")


def mems_asymmetric(texts: DataFrame, queries: DataFrame, k: int, core: str | None = None, context: str | None = None, boundary: str = "strict", scope: str = "corpus", anchor: str = "query") -> DataFrame:
    """query_id, i, d, doc_id, x: stretches of a query that no occurrence in the texts extends, with the first place of each.

    scope: `corpus` looks at all texts as one, `document` at each by itself. anchor: `query` as said; `text` swaps the roles, and
    gives stretches of the texts that no occurrence in the queries extends.
    """
    if anchor == "text":
        swap = lambda rows, a, b: rows.withColumnRenamed(a, b)
        out = mems_asymmetric(swap(queries, "query_id", "doc_id"), swap(texts, "doc_id", "query_id"), k, core, context, boundary, scope)
        return out.select(F.col("doc_id").alias("query_id"), F.col("x").alias("i"), "d", F.col("query_id").alias("doc_id"), F.col("i").alias("x"))
    keys = ["query_id", *(["doc_id"] if scope == "document" else [])]
    found = islands(texts, queries, k)
    first = found.groupBy(*keys, "i", "d").agg(F.min(F.struct("doc_id", "x")).alias("at"))
    reached = carried(first.withColumn("short", -F.col("d")), keys, ["i", "short"], F.col("i") + F.col("d"), F.max, "reach")
    free = reached.where("reach is null or reach < i + d").select("query_id", "i", "d", "at.doc_id", "at.x")
    if core is None and context is None and boundary == "open":
        return free
    text = queries.select("query_id", F.col("text").alias("__text"))
    shown = around(free, queries, "query_id", "i", "qb", "qa").join(text, "query_id")
    if core is not None:
        shown = shown.where(only_of(F.substring("__text", F.col("i").cast("int") + 1, F.col("d").cast("int")), core))
    for c in ("qb", "qa"):
        if boundary == "strict":
            shown = shown.where(F.col(c).isNotNull())
        if context is not None:
            shown = shown.where(F.col(c).isNull() | one_of(F.col(c), context))
    return shown.select("query_id", "i", "d", "doc_id", "x")


def matching_statistics(texts: DataFrame, queries: DataFrame, k: int, core: str | None = None) -> DataFrame:
    """query_id, i, ms, doc_id, x: the longest match from each place of a query with any text, and its first place; places whose longest match has less than k characters have no row.

    A match from i on covers the places after it, so the longest from a place is what the matches that start up to it reach. That is a running maximum
    over the starts of a query, carried from range to range, so a long query is many tasks.
    """
    found = islands(texts, queries, k, core).withColumn("end", F.col("i") + F.col("d"))
    ends = found.groupBy("query_id", "i").agg(F.max("end").alias("end"))
    place = F.struct("doc_id", (F.col("x") + F.col("d")).alias("x_end"))
    starts = found.join(ends, ["query_id", "i", "end"]).groupBy("query_id", "i", "end").agg(F.min(place).alias("at"))
    reached = carried(starts, ["query_id"], ["i"], F.col("end"), F.max, "before")
    reached = reached.withColumn("reach", F.greatest("end", "before")).withColumn("at", F.when(F.col("end") == F.col("reach"), F.col("at")))
    # starts with one reach follow each other; the first of them has a place, and later ones may have an earlier text's
    first = carried(reached, ["query_id", "reach"], ["i"], F.col("at"), F.min, "earlier").withColumn("at", F.array_min(F.array("at", "earlier")))
    after = carried(first.withColumn("back", -F.col("i")), ["query_id"], ["back"], F.col("i"), F.min, "after")
    last = F.least(F.coalesce(F.col("after"), F.col("reach")) - 1, F.col("reach") - k)
    places = after.where(last >= F.col("i")).select("query_id", F.explode(F.sequence("i", last)).alias("i"), "reach", "at")
    ms = F.col("reach") - F.col("i")
    return places.select("query_id", "i", ms.alias("ms"), F.col("at.doc_id").alias("doc_id"), (F.col("at.x_end") - ms).alias("x"))


def longest_shared(texts: DataFrame, queries: DataFrame, least: int, core: str | None = None) -> DataFrame:
    """doc_id, query_id, d: the longest common substring of each pair that shares at least `least` characters in a row."""
    return islands(texts, queries, least, core).groupBy("doc_id", "query_id").agg(F.max("d").alias("d"))


def longest_match(texts: DataFrame, queries: DataFrame, core: str | None = None, wide: int = 16) -> DataFrame:
    """doc_id, d: the length of the longest substring that each text shares with any query; 0 if it shares no character.

    Texts that share `wide` (a power of two) characters in a row get their length from the matches. For the others it is searched by
    halves: a text that shares a gram of some length shares shorter ones too, so each round asks all of them for one length, of distinct grams. Queries of a bounded
    size are held by each task, which does all rounds over a piece of the texts, so texts are read twice; others cost a join for each length.
    """
    if wide < 2 or wide & (wide - 1):
        raise ValueError("wide is a power of two, 2 or more")
    found = islands(texts, queries, wide, core).groupBy("doc_id").agg(F.max("d").alias("d"))
    if grams.small(queries, 12 * wide, 4 * SMALL):
        below = grams.longest_below(texts, queries, wide, core)
        return below.join(found.withColumnRenamed("d", "__long"), "doc_id", "left").select("doc_id", F.coalesce("__long", "d").alias("d"))
    found = written(found, "longest")
    open_ = written(texts.select("doc_id").distinct().join(found, "doc_id", "left_anti").withColumn("d", F.lit(0).cast("long")), "longest")
    own = queries.select("query_id", "text")
    step = wide // 2
    while step:
        shared = None
        for k in range(step, wide, 2 * step):
            units = kmers(own, "query_id", "text", k).select("gram").distinct()
            if core is not None:
                units = units.where(only_of(F.col("gram"), core))
            asked = texts.join(open_.where(F.col("d") == k - step).select("doc_id"), "doc_id", "left_semi")
            hits = kmers(asked, "doc_id", "text", k).join(smaller(units, F.length("text") * (4 * k + 32), of=own), "gram", "left_semi").select("doc_id")
            shared = hits if shared is None else shared.unionByName(hits)
        shared = written(shared.distinct().withColumn("__hit", F.lit(step)), "longest")
        open_ = written(open_.join(shared, "doc_id", "left").select("doc_id", (F.col("d") + F.coalesce("__hit", F.lit(0))).alias("d")), "longest")
        step //= 2
    return found.unionByName(open_)
