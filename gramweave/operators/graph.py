"""Matches between queries and a node-labelled sequence graph.

A graph is nodes (node_id, label) and links (src, src_rev, dst, dst_rev). Units are strings to match: nodes, edges (two labels) and
paths (three), each with a context character on either side. A context is the neighbouring character if all neighbours agree on it.
`compat` gives contexts and paths as the published tool does: a node has the contexts of the node before it, an ambiguous right side
is a separator, links run both ways, and a reversed node's label gets a suffix instead of its complement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramweave.operators.locate import locate
from gramweave.operators.mem import longest_match, mems, mems_asymmetric
from gramweave.sources.tables import written

SEPARATOR, AMBIGUOUS = "$", "N"


def oriented(label: Column, reverse: Column, compat: bool = False) -> Column:
    other = F.concat(label, F.lit("_rev")) if compat else F.reverse(F.translate(label, "ACGTacgt", "TGCAtgca"))
    return F.when(reverse, other).otherwise(label)


def contexts(nodes: DataFrame, links: DataFrame, compat: bool = False) -> DataFrame:
    """node_id, lctx, rctx: the last character of all predecessors and the first of all successors, AMBIGUOUS or SEPARATOR where they differ or are missing."""
    of = lambda end, rev, x: nodes.select(F.col("node_id").alias(end), oriented(F.col("label"), F.lit(False), compat).alias(x), oriented(F.col("label"), F.lit(True), compat).alias(f"{x}_r"))
    met = links.join(of("src", "src_rev", "a"), "src").join(of("dst", "dst_rev", "b"), "dst")
    a, b = F.when(F.col("src_rev"), F.col("a_r")).otherwise(F.col("a")), F.when(F.col("dst_rev"), F.col("b_r")).otherwise(F.col("b"))
    one = lambda x, none: F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.lit(none))
    left = met.groupBy(F.col("dst").alias("node_id")).agg(one(F.substring(a, -1, 1), AMBIGUOUS).alias("lctx"))
    right = met.groupBy(F.col("src").alias("node_id")).agg(one(F.substring(b, 1, 1), SEPARATOR).alias("rctx"))
    if compat:  # looked up one place too low; the first node has none
        left, right = (x.withColumn("node_id", F.col("node_id") + 1) for x in (left, right))
    out = nodes.select("node_id").join(left, "node_id", "left").join(right, "node_id", "left")
    return out.select("node_id", F.coalesce("lctx", F.lit(AMBIGUOUS)).alias("lctx"), F.coalesce("rctx", F.lit(SEPARATOR)).alias("rctx"))


def node_units(nodes: DataFrame, links: DataFrame, compat: bool = False) -> DataFrame:
    """ids, parts, lctx, rctx."""
    return nodes.join(contexts(nodes, links, compat), "node_id").select(F.array("node_id").alias("ids"), F.array("label").alias("parts"), "lctx", "rctx")


def edge_units(nodes: DataFrame, links: DataFrame, compat: bool = False) -> DataFrame:
    around = contexts(nodes, links)  # of the right nodes in either mode
    a = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("a")).join(around.select(F.col("node_id").alias("src"), "lctx"), "src")
    b = nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("b")).join(around.select(F.col("node_id").alias("dst"), "rctx"), "dst")
    met = links.join(a, "src").join(b, "dst")
    parts = F.array(oriented(F.col("a"), F.col("src_rev"), compat), oriented(F.col("b"), F.col("dst_rev"), compat))
    return met.select(F.array("src", "dst").alias("ids"), parts.alias("parts"), "lctx", "rctx").distinct()


def path_units(nodes: DataFrame, links: DataFrame, compat: bool = False, undirected: bool = False) -> DataFrame:
    """Walks over three nodes that keep the orientation of the middle one; contexts are separators."""
    steps = links.select("src", "src_rev", "dst", "dst_rev")
    if compat or undirected:
        back = steps.where("not dst_rev").select(F.col("dst").alias("src"), F.col("dst_rev").alias("src_rev"), F.col("src").alias("dst"), F.col("src_rev").alias("dst_rev"))
        steps = steps.unionByName(back).distinct()
    first = steps.select(F.col("src").alias("a"), F.col("src_rev").alias("ar"), F.col("dst").alias("b"), F.col("dst_rev").alias("br"))
    second = steps.select(F.col("src").alias("b"), F.col("src_rev").alias("br"), F.col("dst").alias("c"), F.col("dst_rev").alias("cr"))
    walks = first.join(second, ["b", "br"])
    for x in "abc":
        walks = walks.join(nodes.select(F.col("node_id").alias(x), F.col("label").alias(f"l{x}")), x)
    parts = F.array(*[oriented(F.col(f"l{x}"), F.col(f"{x}r"), compat) for x in "abc"])
    return walks.select(F.array("a", "b", "c").alias("ids"), parts.alias("parts"), F.lit(SEPARATOR).alias("lctx"), F.lit(SEPARATOR).alias("rctx")).distinct()


def graph_units(nodes: DataFrame, links: DataFrame, kind: str, compat: bool = False) -> DataFrame:
    """ids, parts, lctx, rctx of all units of a kind: nodes, edges or paths."""
    return {"nodes": node_units, "edges": edge_units, "paths": path_units}[kind](nodes, links, compat)


def unit_offsets(units: DataFrame) -> DataFrame:
    """Adds offset: where a unit's string starts if all, each with its contexts and a separator, are joined in the order of ids."""
    from gramweave.sources.texts import numbered

    key = F.array_join(F.transform("ids", lambda i: F.lpad(i.cast("string"), 20, "0")), ",")
    sized = numbered(units.withColumn("key", key), ["key"], "no").withColumn("n", F.length(F.array_join("parts", "")) + 3)
    dealt = sized.withColumn("part", F.floor(F.col("no") / 4096))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("c"))
    starts = totals.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("o", inside).join(starts, "part").withColumn("offset", F.col("o") + F.col("s") + 2).drop("key", "no", "n", "part", "o", "s")


def graph_mems(units: DataFrame, queries: DataFrame, k: int, core: str | None = None, context: str | None = None) -> DataFrame:
    """ids, unit_off, query_id, i, d, text: matches of queries in units, held against the characters beside them.

    A match of an edge or path must, with one character more on either side, start in the first node or the left context and reach the
    last node: a shorter one is found in a smaller unit.
    """
    keyed = units.withColumn("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    whole = F.concat("lctx", F.array_join("parts", ""), "rctx")
    texts = keyed.select("doc_id", whole.alias("text"))
    found = mems(texts, queries, k, core, context)
    first, last = F.length(F.element_at("parts", 1)), F.length(F.element_at("parts", -1))
    total = F.length(F.array_join("parts", ""))
    met = found.join(keyed.select("doc_id", "ids", "parts"), "doc_id")
    # x counts from the left context: a match from label place x - 1 starts, extended, at x - 2
    spans = (F.size("ids") == 1) | ((F.col("x") - 2 < first) & (F.col("x") - 1 + F.col("d") >= total - last))
    text = F.substring(F.array_join("parts", ""), F.col("x").cast("int"), F.col("d").cast("int"))
    return met.where(spans).select("ids", (F.col("x") - 1).alias("unit_off"), "query_id", "i", "d", text.alias("text"))


def longest(units: DataFrame, queries: DataFrame, core: str | None = None) -> DataFrame:
    """d: the length of the longest string that a unit, with its contexts, shares with a query, whatever stands beside it and wherever in the unit it lies; one row, 0 if there is none."""
    return longest_match(unit_texts(units), queries, core).agg(F.coalesce(F.max("d"), F.lit(0)).alias("d"))


def graph_mems_asymmetric(units: DataFrame, queries: DataFrame, k: int, core: str | None = None, context: str | None = None) -> DataFrame:
    """ids, unit_off, query_id, i, d, text: stretches of units that no occurrence in any query extends, each with its first place in the queries.

    Wherever in the unit they lie: use only_in to drop those that a smaller unit holds.
    """
    texts = unit_texts(units)
    found = mems_asymmetric(texts, queries, k, core, context, anchor="text")
    keyed = units.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("doc_id"), "ids").join(texts, "doc_id")
    met = found.join(keyed, "doc_id")
    return met.select("ids", (F.col("x") - 1).alias("unit_off"), "query_id", "i", "d", F.substring("text", F.col("x").cast("int") + 1, F.col("d").cast("int")).alias("text"))


def only_in(found: DataFrame, texts: DataFrame, inside: bool = True) -> DataFrame:
    """Matches whose string occurs in texts (doc_id, text), or those whose string doesn't."""
    found = written(found, "graph-matches")
    strings = found.select("text").distinct().select(F.col("text").alias("pattern")).withColumn("pattern_id", F.xxhash64("pattern"))
    held = locate(texts, strings).select("pattern_id").distinct().join(strings, "pattern_id").select(F.col("pattern").alias("text"))
    return found.join(held, "text", "left_semi" if inside else "left_anti")


def unit_texts(units: DataFrame) -> DataFrame:
    """doc_id, text of units with their contexts, as texts to search."""
    return units.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("doc_id"), F.concat("lctx", F.array_join("parts", ""), "rctx").alias("text"))
