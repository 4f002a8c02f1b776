"""Matches between queries and the walks of a sequence graph, over any number of nodes.

No walk is listed. Every match of k characters or more starts with a gram of w (k at most) that lies inside a node or is spelled from the end of one
over its links. Grams that a query shares and that no predecessor and no character before them extends to the left are where matches start.
From there a frontier of (start, query place, node, place, length) grows: each round adds what the node's label and the query go on to share,
and where that is all of the label, steps to the successors that begin with the query's next character. What can't step is a
match. Different walks between two places are one row of the frontier, so a bubble doesn't double it, and as the length
grows with each step and ends with the query, cycles come to an end. Each round is a written table.

A graph is nodes (node_id, label) and links (src, src_rev, dst, dst_rev); a node is walked in the orientation in which a link leads to it, and
links one way. Nodes without a label are no part of a walk. Null queries have no matches; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramweave.functions.strings import char_at, common_prefix
from gramweave.operators.graph import oriented
from gramweave.operators.locate import smaller
from gramweave.sources.tables import written
from gramweave.sources.texts import kmers

#: Characters of a seed at most: it is spelled over links, so a longer one would follow more walks.
SEED = 16
START = ["node", "rev", "off", "query_id", "i"]


def oriented_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, rev, label: every node as it is, and reversed where a link uses it so."""
    used = links.select(F.col("src").alias("node"), F.col("src_rev").alias("rev")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst_rev").alias("rev")))
    every = nodes.select(F.col("node_id").alias("node"), F.lit(False).alias("rev")).unionByName(used).distinct()
    labels = nodes.where("label <> ''").select(F.col("node_id").alias("node"), "label")
    return every.join(labels, "node").select("node", "rev", oriented(F.col("label"), F.col("rev")).alias("label"))


def _spelled(own: DataFrame, steps: DataFrame, w: int) -> DataFrame:
    """node, rev, off, gram, before, cur, cur_rev, at: grams of w characters over two nodes or more; at is where they end in the last one."""
    short = own.select("*", F.explode(F.sequence(F.greatest(F.length("label") - w + 1, F.lit(0)), F.length("label") - 1)).alias("off"))
    now = short.select("node", "rev", "off", F.expr("substring(label, off + 1)").alias("gram"), char_at(F.col("label"), F.col("off") - 1).alias("before"), F.col("node").alias("cur"), F.col("rev").alias("cur_rev"))
    labels = own.select(F.col("node").alias("cur"), F.col("rev").alias("cur_rev"), "label")
    out = None
    while True:
        met = now.join(steps, ["cur", "cur_rev"]).drop("cur", "cur_rev").withColumnsRenamed({"next": "cur", "next_rev": "cur_rev"}).join(labels, ["cur", "cur_rev"])
        longer = met.withColumn("at", F.least(F.length("label"), w - F.length("gram"))).withColumn("gram", F.concat("gram", F.expr("substring(label, 1, at)"))).drop("label")
        longer = written(longer.distinct(), "spelled")
        done = longer.where(F.length("gram") == w)
        out = done if out is None else out.unionByName(done)
        now = longer.where(F.length("gram") < w).drop("at")
        if now.isEmpty():
            return out.select("node", "rev", F.col("off").cast("long").alias("off"), "gram", "before", "cur", "cur_rev", F.col("at").cast("long").alias("at"))


def _seeds(own: DataFrame, steps: DataFrame, queries: DataFrame, w: int, strict: bool) -> DataFrame:
    """START, cur, cur_rev, at, d: grams that nothing extends to the left."""
    keyed = own.withColumn("id", F.struct("node", "rev")).withColumn("text", F.concat(F.lit(" "), "label"))  # a character more, so each gram knows the one before it
    inner = kmers(keyed, "id", "text", w + 1).select("id.node", "id.rev", F.col("pos").alias("off"), F.expr(f"substring(gram, 2, {w})").alias("gram"), F.when(F.col("pos") > 0, F.substring("gram", 1, 1)).alias("before"), F.col("id.node").alias("cur"), F.col("id.rev").alias("cur_rev"), (F.col("pos") + w).alias("at"))
    framed = queries.select("query_id", F.concat(F.lit(" "), "text").alias("text"))
    asked = kmers(framed, "query_id", "text", w + 1).select("query_id", F.col("pos").alias("i"), F.expr(f"substring(gram, 2, {w})").alias("gram"), F.when(F.col("pos") > 0, F.substring("gram", 1, 1)).alias("q_before"))
    asked = smaller(asked, F.length("text") * (4 * w + 64), of=framed)
    hits = inner.unionByName(_spelled(own, steps, w)).join(asked, "gram")
    lasts = steps.join(own.select(F.col("node").alias("cur"), F.col("rev").alias("cur_rev"), F.substring("label", -1, 1).alias("last")), ["cur", "cur_rev"])
    lasts = lasts.groupBy(F.col("next").alias("node"), F.col("next_rev").alias("rev")).agg(F.collect_set("last").alias("lasts"))  # as many as there are characters
    found = hits.join(lasts, ["node", "rev"], "left")
    beside = F.when(F.col("off") > 0, F.array("before")).otherwise(F.coalesce("lasts", F.array().cast("array<string>")))
    found = found.where(F.col("q_before").isNull() | ~F.array_contains(beside, F.col("q_before")))
    if strict:
        found = found.where(F.col("q_before").isNotNull() & (F.size(beside) > 0))
    return found.select(*START, "cur", "cur_rev", "at", F.lit(w).cast("long").alias("d"))


def walk_mems(nodes: DataFrame, links: DataFrame, queries: DataFrame, k: int, boundary: str = "strict", seed: int = SEED) -> DataFrame:
    """node, rev, off, query_id, i, d, end_node, end_rev, end_off: matches of k characters or more that no character and no link extends on either side.

    A match starts at off in node and ends before end_off in end_node. boundary: `strict` asks for a character beside each end in the query and
    beside or behind a link in the graph, `open` doesn't.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if boundary not in ("strict", "open"):
        raise ValueError("boundary is strict or open")
    strict = boundary == "strict"
    own = written(oriented_nodes(nodes, links), "walk-nodes")
    queries = queries.where("text is not null").select("query_id", "text")
    of = lambda end: own.select(F.col("node").alias(end), F.col("rev").alias(f"{end}_rev"))
    steps = written(links.select(F.col("src").alias("cur"), F.col("src_rev").alias("cur_rev"), F.col("dst").alias("next"), F.col("dst_rev").alias("next_rev")).distinct().join(of("cur"), ["cur", "cur_rev"]).join(of("next"), ["next", "next_rev"]), "walk-steps")
    labels = own.select(F.col("node").alias("cur"), F.col("rev").alias("cur_rev"), "label")
    firsts = own.select(F.col("node").alias("next"), F.col("rev").alias("next_rev"), F.substring("label", 1, 1).alias("first"))
    onward = steps.join(firsts, ["next", "next_rev"])
    have = steps.select("cur", "cur_rev").distinct().withColumn("more", F.lit(True))
    now = written(_seeds(own, steps, queries, min(k, seed), strict).distinct(), "walk-frontier")
    out = None
    while not now.isEmpty():
        met = now.join(labels, ["cur", "cur_rev"]).join(queries, "query_id")
        rest = lambda text, at: F.substring(text, at.cast("int") + 1, F.length(text))
        grown = met.withColumn("__n", common_prefix(rest("label", F.col("at")), rest("text", F.col("i") + F.col("d"))))
        grown = grown.withColumns({"at": F.col("at") + F.col("__n"), "d": F.col("d") + F.col("__n")})
        grown = grown.withColumn("after", char_at(F.col("text"), (F.col("i") + F.col("d")).cast("int"))).withColumn("full", F.col("at") == F.length("label"))
        grown = written(grown.select(*START, "cur", "cur_rev", "at", "d", "after", "full"), "walk-grown")
        stepped = grown.where("full and after is not null").join(onward, ["cur", "cur_rev"]).where(F.col("first") == F.col("after"))
        stepped = written(stepped.select(*START, "cur", "cur_rev", "d", "next", "next_rev"), "walk-stepped")
        key = [*START, "cur", "cur_rev", "d"]
        ended = grown.join(stepped.select(*key).distinct(), key, "left_anti").where(F.col("d") >= k)
        if strict:
            ended = ended.join(have, ["cur", "cur_rev"], "left").where("after is not null and (not full or more)")
        ended = written(ended.select(*START, "d", F.col("cur").alias("end_node"), F.col("cur_rev").alias("end_rev"), F.col("at").alias("end_off")), "walk-ended")
        out = ended if out is None else out.unionByName(ended)
        now = written(stepped.select(*START, F.col("next").alias("cur"), F.col("next_rev").alias("cur_rev"), F.lit(0).cast("long").alias("at"), "d").distinct(), "walk-frontier")
    if out is None:
        ends = {"end_node": F.col("cur"), "end_rev": F.col("cur_rev"), "end_off": F.col("at")}
        return now.withColumns(ends).select(*START, "d", *ends)
    return out.distinct()
