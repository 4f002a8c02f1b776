"""The registered queries of the matching engine, each over whole tables, and the SQL that they are held against.

Texts are the documents, queries are the benchmark passages and patterns their pieces, suffix order and vectors use the part names and the
passages, and the graph is made of the passages: each is cut in three nodes, and links lead on to the next piece of the same and of
the next passage. The GFA queries write that graph with reversed ends and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.functions.strings import duration
from gramweave.functions.tables import register, register_known
from gramweave.operators import grams, graph, index, locate, mem, repeats, suffix, vectors, walks
from gramweave.sources import formats, positions
from gramweave.sources import texts as src
from gramweave.sources.tables import shared_path, written

K, PATTERN, PER_TEXT = 20, 12, 2
#: Characters that a match may hold and those that may stand beside it, where a query says so.
CORE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ,."
CONTEXT = CORE + "#"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return src.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def passages(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def patterns(spark, sf_dir):
    """All pieces of PATTERN characters of each passage."""
    return locate.tiled_patterns(passages(spark, sf_dir).withColumnRenamed("query_id", "doc_id"), PATTERN)


def pattern_sample(spark, sf_dir):
    """PER_TEXT substrings of PATTERN characters of each passage."""
    return locate.sample_patterns(passages(spark, sf_dir).withColumnRenamed("query_id", "doc_id"), PATTERN, PER_TEXT)


def names(spark, sf_dir):
    return src.spread(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")))


def letters(spark, sf_dir):
    """vec, pos, ch: the characters of the part names."""
    return names(spark, sf_dir).select(F.col("doc_id").alias("vec"), F.posexplode(F.split("text", "")).alias("pos", "ch")).withColumn("pos", F.col("pos").cast("long"))


def vowels(spark, sf_dir):
    return letters(spark, sf_dir).select("vec", "pos", F.col("ch").isin(*"aeiou").cast("int").alias("bit"))


def passage_graph(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.ceil(F.length("text") / 3).cast("int").alias("w"))
    pieces = rows.select("item_id", F.posexplode(F.array(*[F.expr(f"substring(text, {p} * w + 1, w)") for p in range(3)])).alias("piece", "label"))
    nodes = pieces.select((F.col("item_id") * 3 + F.col("piece")).alias("node_id"), "label").where("label <> ''")
    steps = nodes.select(F.col("node_id").alias("src"), F.explode(F.array(F.col("node_id") + 1, F.col("node_id") + 4)).alias("dst")).where("src % 3 < 2")
    links = steps.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return nodes, links.select("src", F.lit(False).alias("src_rev"), "dst", F.lit(False).alias("dst_rev"))


def gfa_graph(spark, sf_dir):
    """The graph of the passages, odd nodes left by their reverse and nodes that 5 divides entered by it, written as GFA and read back."""
    nodes, links = passage_graph(spark, sf_dir)
    turned = links.withColumn("src_rev", F.col("src") % 2 == 1).withColumn("dst_rev", F.col("dst") % 5 == 0)
    path = shared_path(spark, "graph-gfa")
    src.graph_lines(nodes, turned).write.text(path)
    return src.read_graph(spark, path)


def framed(spark, sf_dir):
    """The passages between separators."""
    return passages(spark, sf_dir).where("text is not null").select("query_id", F.concat(F.lit("#"), "text", F.lit("#")).alias("text"))


# Sources and sinks


def corpus_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.octet_length("text").alias("bytes"))


def pattern_parse(spark, sf_dir):
    header = F.concat(F.lit("# number="), F.floor(F.length("text") / PATTERN).cast("string"), F.lit(f" length={PATTERN} file=benchmark forbidden=\n"))
    return src.parse_patterns(passages(spark, sf_dir).select("query_id", F.concat(header, "text").alias("body")), "query_id", "body")


def query_split(spark, sf_dir):
    return src.split_queries(passages(spark, sf_dir).select("query_id", F.concat(F.lit("#"), F.regexp_replace("text", "[.] ?", "#"), F.lit("#")).alias("line")), "query_id", "line")


def graph_nodes(spark, sf_dir):
    return passage_graph(spark, sf_dir)[0]


def graph_links(spark, sf_dir):
    return passage_graph(spark, sf_dir)[1].select("src", "dst")


def gfa_nodes(spark, sf_dir):
    return gfa_graph(spark, sf_dir)[0]


def gfa_links(spark, sf_dir):
    return gfa_graph(spark, sf_dir)[1]


def gfa_units(spark, sf_dir):
    return _units(*gfa_graph(spark, sf_dir), "edges")


def gfa_source(spark, sf_dir):
    """The links of that graph, written by one data source and read by it in ranges of 10,000 bytes."""
    nodes, links = passage_graph(spark, sf_dir)
    formats.register(spark)
    path, name = shared_path(spark, "graph-source"), lambda c: F.concat(F.lit("n"), F.col(c)).alias(c)
    nodes.select(name("node_id").alias("name"), F.regexp_replace("label", r"[\t\r\n]", " ").alias("label")).write.format("gfa").mode("append").save(path)
    links.select(name("src"), (F.col("src") % 2 == 1).alias("src_rev"), name("dst"), (F.col("dst") % 5 == 0).alias("dst_rev")).write.format("gfa").mode("append").save(path)
    read = spark.read.format("gfa").option("split", 10_000)
    labels = read.load(path)
    of = lambda end: labels.select(F.col("name").alias(end), F.col("label").alias(f"{end}_label"))
    return read.option("record", "L").load(path).join(of("src"), "src").join(of("dst"), "dst")


def index_grams(spark, sf_dir):
    """The grams of the passages from a stored index, built by the first call and read by the second."""
    rows, folder = passages(spark, sf_dir), shared_path(spark, "index")
    build = lambda rows: src.kmers(rows, "query_id", "text", PATTERN)
    for _ in range(2):
        found = src.cached_index(rows, ["query_id", "text"], folder, build)
    return found


def text_durations(spark, sf_dir):
    """What reading each document takes at 15 characters a second."""
    return documents(spark, sf_dir).where("text is not null").select("doc_id", duration(F.floor(F.length("text") / 15)).alias("reading"))


def mem_lines(spark, sf_dir):
    return src.match_lines(mem_open(spark, sf_dir))


# Matches


def mem_open(spark, sf_dir):
    return mem.mems(documents(spark, sf_dir), passages(spark, sf_dir), K, boundary="open")


def mem_global(spark, sf_dir):
    """Matches by places in all texts, and all passages, joined, with the text and the passage that these places lead back to."""
    texts, asked = documents(spark, sf_dir), passages(spark, sf_dir)
    of = {"doc_id": positions.with_offsets(texts, "doc_id"), "query_id": positions.with_offsets(asked, "query_id")}
    found = mem.mems(texts, asked, K, boundary="open")
    for id_col, at in (("doc_id", "x"), ("query_id", "i")):
        found = positions.to_joined(found, of[id_col], id_col, at).drop(id_col)
    found = written(found.withColumnsRenamed({"x": "joined_x", "i": "joined_i"}), "joined-matches")
    back = positions.to_texts(found, of["doc_id"], "doc_id", "joined_x").withColumnRenamed("x", "doc_x")
    return positions.to_texts(back, of["query_id"], "query_id", "joined_i").withColumnRenamed("x", "query_i")


def mem_symmetric(spark, sf_dir):
    return mem.mems(documents(spark, sf_dir), framed(spark, sf_dir), K)


def mem_asymmetric(spark, sf_dir):
    return mem.mems_asymmetric(documents(spark, sf_dir), framed(spark, sf_dir), K)


def mem_alphabet(spark, sf_dir):
    return mem.mems(documents(spark, sf_dir), framed(spark, sf_dir), K, CORE, CONTEXT)


def mem_alphabet_asymmetric(spark, sf_dir):
    return mem.mems_asymmetric(documents(spark, sf_dir), framed(spark, sf_dir), K, CORE, CONTEXT)


def mem_classes(spark, sf_dir):
    return repeats.mems_by_context(documents(spark, sf_dir), passages(spark, sf_dir), K)


def maximal_repeats(spark, sf_dir):
    return repeats.maximal_repeats(documents(spark, sf_dir), K)


def matching_statistics(spark, sf_dir):
    return mem.matching_statistics(documents(spark, sf_dir), passages(spark, sf_dir), K)


def longest_common_substring(spark, sf_dir):
    return mem.longest_match(documents(spark, sf_dir), passages(spark, sf_dir))


def longest_shared(spark, sf_dir):
    """Of the pairs of a document and a passage that share PATTERN characters in a row."""
    return mem.longest_shared(documents(spark, sf_dir), passages(spark, sf_dir), PATTERN)


def top_mems(spark, sf_dir):
    return mem_open(spark, sf_dir).orderBy(F.desc("d"), "doc_id", "query_id", "x", "i").limit(20)


# Occurrences


def of(job, most):
    return lambda spark, sf_dir: job(documents(spark, sf_dir), patterns(spark, sf_dir), most)


def hamming_eq(most):
    return lambda spark, sf_dir: locate.locate(documents(spark, sf_dir), patterns(spark, sf_dir), most).where(F.col("mismatches") == most).drop("mismatches")


def seed_extend(spark, sf_dir):
    return locate.seed_extend(documents(spark, sf_dir), patterns(spark, sf_dir), 4, 8, 2)


def occurrence_check(spark, sf_dir):
    """How many of the occurrences, and of the places one further on, aren't any."""
    d, p = documents(spark, sf_dir), patterns(spark, sf_dir)
    found = written(locate.locate(d, p, 1).select("pattern_id", "doc_id", "x"), "occurrences")
    return locate.violations(d, p, found.unionByName(found.withColumn("x", F.col("x") + 1)), 1).agg(F.count(F.lit(1)).alias("violations"))


def extended(side):
    return lambda spark, sf_dir: locate.extend(locate.neighbours(documents(spark, sf_dir), patterns(spark, sf_dir)), side)


def maximal(side):
    return lambda spark, sf_dir: locate.maximal(locate.neighbours(documents(spark, sf_dir), patterns(spark, sf_dir)), side)


def stored(spark, least, *versions):
    """An index of the texts, updated with each version in turn, and opened again."""
    path = shared_path(spark, "gram-index")
    for texts in versions:
        index.GramIndex(spark, path, least).update(texts, F.floor(F.col("doc_id") / 64))
    return index.GramIndex(spark, path)


def locate_indexed(spark, sf_dir):
    texts = documents(spark, sf_dir)
    return locate.locate(texts, patterns(spark, sf_dir), 0, stored(spark, PATTERN, texts))


def mem_indexed(spark, sf_dir):
    texts = documents(spark, sf_dir)
    return mem.mems(texts, passages(spark, sf_dir), K, boundary="open", index=stored(spark, K, texts))


def index_update(spark, sf_dir):
    """Occurrences by an index that was built, and updated after one text in a hundred got a passage more and as many others were taken away."""
    texts, turn = documents(spark, sf_dir), F.floor(F.col("doc_id") / 64) % 100
    more = passages(spark, sf_dir).agg(F.max("text").alias("more"))
    after = texts.join(F.broadcast(more)).where(turn != 1).select("doc_id", F.when(turn == 0, F.concat("text", "more")).otherwise(F.col("text")).alias("text"))
    return locate.locate(after, patterns(spark, sf_dir), 0, stored(spark, PATTERN, texts, after))


def from_sql(spark, sf_dir, text):
    """A statement on the views own_texts, own_queries and own_patterns."""
    register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("own_texts")
    passages(spark, sf_dir).createOrReplaceTempView("own_queries")
    pattern_sample(spark, sf_dir).createOrReplaceTempView("own_patterns")
    return spark.sql(text)


def sql_locate(spark, sf_dir):
    return from_sql(spark, sf_dir, "select * from locate_in(table(own_texts), (select array_agg(pattern) from own_patterns), 1)")


def sql_mems(spark, sf_dir):
    asked, cut = passages(spark, sf_dir), f"grams_in(table(own_texts), {K})"
    if grams.small(asked, 24):
        register_known(spark, "own_grams_in", asked, K)
        cut = "own_grams_in(table(own_texts))"
    hits = f"select t.doc_id, q.query_id, t.pos as x, q.pos as i from {cut} t join grams_in(table(own_queries), {K}) q on t.gram = q.gram"
    return from_sql(spark, sf_dir, f"select * from runs_in(table({hits}) partition by (doc_id, query_id, x - i) order by (x), {K})")


# Graph


def _units(nodes, links, kind):
    found = graph.graph_units(nodes, links, kind)
    return found.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.array_join("parts", ">").alias("parts"), "lctx", "rctx")


def units(kind):
    return lambda spark, sf_dir: _units(*passage_graph(spark, sf_dir), kind)


def unit_offsets(spark, sf_dir):
    return _flat(graph.unit_offsets(graph.graph_units(*passage_graph(spark, sf_dir), "nodes"))).select("ids", "offset")


def graph_contexts(spark, sf_dir):
    return graph.contexts(*passage_graph(spark, sf_dir))


def _graph_mems(spark, sf_dir, kind):
    return graph.graph_mems(graph.graph_units(*passage_graph(spark, sf_dir), kind), framed(spark, sf_dir), K)


def _flat(found):
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


def graph_mems(kind):
    return lambda spark, sf_dir: _flat(_graph_mems(spark, sf_dir, kind))


def graph_mem_filtered(spark, sf_dir):
    return _flat(graph.only_in(_graph_mems(spark, sf_dir, "paths"), documents(spark, sf_dir)))


def graph_mem_asym(spark, sf_dir):
    """Stretches of edges that no passage extends and no node holds."""
    nodes, edges = (graph.graph_units(*passage_graph(spark, sf_dir), kind) for kind in ("nodes", "edges"))
    found = graph.graph_mems_asymmetric(edges, framed(spark, sf_dir), K)
    return _flat(graph.only_in(found, graph.unit_texts(nodes), inside=False))


def graph_mem_max(spark, sf_dir):
    """The longest match of each section, of any length and wherever it lies."""
    rows = [graph.longest(graph.graph_units(*passage_graph(spark, sf_dir), k), framed(spark, sf_dir)).select(F.lit(k).alias("section"), "d") for k in ("nodes", "edges", "paths")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


RING = 8


def passage_rings(spark, sf_dir):
    """Each passage in RING nodes, whose links lead on to the next piece of the same and of the next passage, and from the last piece to the first."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.ceil(F.length("text") / RING).cast("int").alias("w"))
    pieces = rows.select("item_id", F.posexplode(F.array(*[F.expr(f"substring(text, {p} * w + 1, w)") for p in range(RING)])).alias("piece", "label"))
    nodes = pieces.select((F.col("item_id") * RING + F.col("piece")).alias("node_id"), "label").where("label <> ''")
    on, last = F.array(F.col("node_id") + 1, F.col("node_id") + RING + 1), F.array(F.col("node_id") - RING + 1)
    steps = nodes.select(F.col("node_id").alias("src"), F.explode(F.when(F.col("node_id") % RING == RING - 1, last).otherwise(on)).alias("dst"))
    links = steps.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return nodes, links.select("src", F.lit(False).alias("src_rev"), "dst", F.lit(False).alias("dst_rev"))


def graph_mem_walks(spark, sf_dir):
    """Matches of each passage, written twice, on walks of any length around the rings."""
    twice = passages(spark, sf_dir).where("text is not null").select("query_id", F.concat(F.lit("#"), "text", "text", F.lit("#")).alias("text"))
    return walks.walk_mems(*passage_rings(spark, sf_dir), twice, K).drop("rev", "end_rev")


# Suffix order and vectors


def on_names(job):
    return lambda spark, sf_dir: job(names(spark, sf_dir))


def order_of_passages(spark, sf_dir):
    """The passages and the order of their suffixes by doubling, whatever their length."""
    rows = passages(spark, sf_dir).withColumnRenamed("query_id", "doc_id")
    return rows, suffix.suffix_array(rows, short=0)


def suffix_array_passages(spark, sf_dir):
    return order_of_passages(spark, sf_dir)[1]


def bwt_passages(spark, sf_dir):
    return suffix.bwt(*order_of_passages(spark, sf_dir)).withColumn("ch", suffix.shown(F.col("ch")))


def plcp_passages(spark, sf_dir):
    return suffix.plcp(passages(spark, sf_dir).withColumnRenamed("query_id", "doc_id"), short=0)


def bwt(spark, sf_dir):
    return suffix.bwt(names(spark, sf_dir)).withColumn("ch", suffix.shown(F.col("ch")))


def f_column(spark, sf_dir):
    return suffix.f_column(names(spark, sf_dir)).withColumn("ch", suffix.shown(F.col("ch")))


def rle_runs(spark, sf_dir):
    return vectors.runs(letters(spark, sf_dir))


QUERIES = {
    "corpus_scan": corpus_scan,
    "pattern_parse": pattern_parse,
    "query_split": query_split,
    "graph_nodes": graph_nodes,
    "graph_links": graph_links,
    "gfa_nodes": gfa_nodes,
    "gfa_links": gfa_links,
    "gfa_units": gfa_units,
    "gfa_source": gfa_source,
    "index_grams": index_grams,
    "text_durations": text_durations,
    "mem_lines": mem_lines,
    "mem_open": mem_open,
    "mem_symmetric": mem_symmetric,
    "mem_global": mem_global,
    "mem_asymmetric": mem_asymmetric,
    "mem_alphabet": mem_alphabet,
    "mem_alphabet_asymmetric": mem_alphabet_asymmetric,
    "matching_statistics": matching_statistics,
    "mem_classes": mem_classes,
    "maximal_repeats": maximal_repeats,
    "longest_common_substring": longest_common_substring,
    "longest_shared": longest_shared,
    "top_mems": top_mems,
    "locate_exact": of(locate.locate, 0),
    "count_exact": of(locate.count, 0),
    "locate_mismatch": of(locate.locate, 1),
    "count_mismatch": of(locate.count, 1),
    "locate_report": of(locate.report, 1),
    "hamming_eq1": hamming_eq(1),
    "hamming_eq2": hamming_eq(2),
    "hamming_histogram": of(locate.histogram, 2),
    "hamming_totals": of(locate.totals, 2),
    "seed_extend": seed_extend,
    "occurrence_check": occurrence_check,
    "extend_left": extended("before"),
    "extend_right": extended("after"),
    "left_maximal": maximal("before"),
    "right_maximal": maximal("after"),
    "locate_indexed": locate_indexed,
    "mem_indexed": mem_indexed,
    "index_update": index_update,
    "sql_locate": sql_locate,
    "sql_mems": sql_mems,
    "pattern_sample": pattern_sample,
    "pattern_pieces": patterns,
    "graph_units": units("edges"),
    "unit_offsets": unit_offsets,
    "graph_contexts": graph_contexts,
    "graph_paths": units("paths"),
    "graph_mem_nodes": graph_mems("nodes"),
    "graph_mem_edges": graph_mems("edges"),
    "graph_mem_paths": graph_mems("paths"),
    "graph_mem_filtered": graph_mem_filtered,
    "graph_mem_asym": graph_mem_asym,
    "graph_mem_max": graph_mem_max,
    "graph_mem_walks": graph_mem_walks,
    "suffix_array_passages": suffix_array_passages,
    "bwt_passages": bwt_passages,
    "plcp_passages": plcp_passages,
    "suffix_array": on_names(suffix.suffix_array),
    "bwt": bwt,
    "f_column": f_column,
    "lf_mapping": on_names(suffix.lf_mapping),
    "fl_mapping": on_names(suffix.fl_mapping),
    "phi": lambda spark, sf_dir: suffix.phi(names(spark, sf_dir)).select("doc_id", "sa", "phi"),
    "phi_inverse": lambda spark, sf_dir: suffix.phi(names(spark, sf_dir)).select("doc_id", "sa", "phi_inv"),
    "plcp": on_names(suffix.plcp),
    "bwt_runs": on_names(suffix.bwt_runs),
    "char_range": on_names(suffix.char_range),
    "index_stats": on_names(suffix.index_stats),
    "bit_rank_select": lambda spark, sf_dir: vectors.bit_select(vowels(spark, sf_dir)),
    "bit_predecessor": lambda spark, sf_dir: vectors.bit_predecessor(vowels(spark, sf_dir)),
    "char_rank_select": lambda spark, sf_dir: vectors.char_rank_select(letters(spark, sf_dir)),
    "rle_runs": rle_runs,
    "rle_rank": lambda spark, sf_dir: vectors.run_rank(rle_runs(spark, sf_dir)),
    "alphabet_stats": lambda spark, sf_dir: vectors.alphabet_stats(documents(spark, sf_dir)),
}

from gramweave.plans.oracles import ORACLE_SQL  # noqa: E402, F401
