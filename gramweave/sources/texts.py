"""Sources and sinks: texts, pattern files, joined queries, sequence graphs, match lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramweave.sources.tables import written

BLOCK = 512


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc (path of the file), text: each file whole, with every character, the last line break included."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def spread(rows: DataFrame, each: int = 32 << 20) -> DataFrame:
    """The rows of a small table of fewer files than the cluster has cores, dealt to all cores; other tables as they are.

    A file of one row group is one task, and cutting grams is far more work than a shuffle of a small table. A table of over
    `each` bytes a core is never shuffled, and its files aren't listed here.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(n) if size <= n * each and len(rows.inputFiles()) < n else rows


def header_number(text: Column, name: str) -> Column:
    """What `name=` says in the header line of a pattern file; null if it says nothing."""
    return F.regexp_extract(F.substring_index(text, "\n", 1), rf"(?:^|\s){name}=(\d+)", 1).try_cast("int")


def parse_patterns(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pattern_id (from 0), pattern: the fixed-length patterns that follow the header `# number=N length=M file=...` of each file.

    A file whose header lacks a number or a length, or whose body is shorter than they say, is an error.
    """
    header = F.substring_index(text_col, "\n", 1)
    rows = files.select(F.col(id_col), header_number(F.col(text_col), "number").alias("n"), header_number(F.col(text_col), "length").alias("m"), F.col(text_col).alias("__text"), (F.length(header) + 1).alias("__from"))
    sound = (F.col("n") * F.col("m") + F.col("__from") <= F.length("__text")) & (F.col("m") > 0)
    checked = rows.withColumn("n", F.when(F.coalesce(sound, F.lit(False)), F.col("n")).otherwise(F.raise_error(F.lit("a pattern file needs number= and length= in its header, and as many characters")).cast("int")))
    body = checked.withColumn("__body", F.expr("substring(__text, __from + 1, n * m)")).where("n > 0")
    return body.select(id_col, F.expr("posexplode(transform(sequence(0, n - 1), j -> substring(__body, j * m + 1, m)))").alias("pattern_id", "pattern"))


def split_queries(rows: DataFrame, id_col: str, text_col: str, separator: str = "#") -> DataFrame:
    """id, query_no, query, offset: the non-empty queries between separators, and where each starts in the joined text."""
    parts = rows.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), f"\\Q{separator}\\E")).alias("query_no", "query"))
    before = Window.partitionBy(id_col).orderBy("query_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("query") + len(separator)).over(before), F.lit(0))
    return parts.withColumn("offset", offset.cast("long")).where("query <> ''")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node_id, name, label) and links (src, src_rev, dst, dst_rev) of a graph in GFA: S and L records; other lines are skipped.

    Ids count S lines from 1, in the order of the files' names and of the lines in each; links name nodes by their S record's name.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), *place)
    names = lines.where("f[0] = 'S'").select("file", "block", "line", F.col("f")[1].alias("name"), F.col("f")[2].alias("label"))
    nodes = written(numbered(names, ["file", "block", "line"], "node_id").select("node_id", "name", "label"), "graph-nodes")
    ends = lines.where("f[0] = 'L'").select(F.col("f")[1].alias("a"), (F.col("f")[2] == "-").alias("src_rev"), F.col("f")[3].alias("b"), (F.col("f")[4] == "-").alias("dst_rev"))
    of = lambda x, y: nodes.select(F.col("name").alias(x), F.col("node_id").alias(y))
    return nodes, ends.join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "src_rev", "dst", "dst_rev")


def graph_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """value: the graph (node_id, label; src, src_rev, dst, dst_rev) as lines of GFA, S records by id before L records; ready for write.text."""
    sign = lambda reverse: F.when(F.col(reverse), F.lit("-")).otherwise(F.lit("+"))
    name = lambda c: F.col(c).cast("string")
    kept = F.regexp_replace("label", r"[\t\r\n]", " ")
    first = nodes.select(F.lit(0).alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws("\t", F.lit("S"), name("node_id"), kept).alias("value"))
    then = links.select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws("\t", F.lit("L"), name("src"), sign("src_rev"), name("dst"), sign("dst_rev"), F.lit("0M")).alias("value"))
    return first.unionByName(then).orderBy("kind", "a", "b", "value").select("value")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a number from 1 in the order of columns that are unique together, from totals of ranges: no task sees all rows.

    The ranges are a written table: planned twice, one of them might be cut at other places.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    return inside.join(starts, "__part").withColumn(name, F.col("__n") + F.col("__s")).drop("__part", "__n", "__s")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, how, name: str) -> DataFrame:
    """Adds how(value), F.min or F.max, over the rows with the same keys that come before each in the order of columns; null for the first.

    From ranges and their totals, as numbered(): a task sees a range, and what comes before it is one row for each range and key that lies there.
    """
    dealt = written(rows.withColumn("__v", value).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = how("__v").over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy(*keys, "__part").agg(how("__v").alias("__t"))
    starts = totals.select(*keys, "__part", how("__t").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__s"))
    both = F.array_max if how is F.max else F.array_min  # nulls aside
    return dealt.withColumn("__o", inside).join(starts, [*keys, "__part"]).withColumn(name, both(F.array("__o", "__s"))).drop("__v", "__part", "__o", "__s")


def kmers(rows: DataFrame, id_col: str, text_col: str, k: int, block: int = BLOCK) -> DataFrame:
    """id, pos, gram: every k characters of every text.

    A text is cut into overlapping blocks by one pass of a pattern, and grams are cut inside blocks: cutting them from the whole
    text would read it from its start for each.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(?=(.{{1,{block + k - 1}}})).{{1,{block}}}"), F.lit(1))
    blocks = rows.where(F.length(text_col) >= k).select(F.col(id_col), F.posexplode(cut).alias("__b", "__chunk")).where(F.length("__chunk") >= k)
    grams = F.expr(f"posexplode(transform(sequence(1, length(__chunk) - {k - 1}), j -> substring(__chunk, j, {k})))")
    return blocks.select(id_col, "__b", grams.alias("__p", "gram")).select(id_col, (F.col("__b") * block + F.col("__p")).cast("long").alias("pos"), "gram")


def kmers_in_context(rows: DataFrame, id_col: str, text_col: str, k: int, left: int, right: int, block: int = BLOCK, stride: int = 1) -> DataFrame:
    """id, pos, gram, context, place: as kmers, with the text around each gram, and where in it the gram starts. stride: only grams at its multiples.

    The context reaches `left` characters (up to a block) before the gram and `right` after its start, or to the end of the text. It is a
    reference to the block until rows are copied, so join on gram without a shuffle.
    """
    if not 0 <= left <= block:
        raise ValueError("the left context is at most a block")
    block = -(-block // stride) * stride
    reach = block + max(k - 1, right)
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(?=(.{{1,{reach}}})).{{1,{block}}}"), F.lit(1))
    chunks = rows.where(F.length(text_col) >= k).select(F.col(id_col), cut.alias("__all"))
    before = f"if(b > 0, substring(element_at(__all, b), {block - left + 1}, {left}), '')" if left else "''"
    blocks = chunks.select(F.col(id_col), F.expr(f"posexplode(transform(__all, (c, b) -> named_struct('before', {before}, 'chunk', c)))").alias("__b", "__c"))
    blocks = blocks.select(id_col, "__b", F.length("__c.before").alias("__l"), F.col("__c.chunk").alias("__chunk"), F.concat("__c.before", "__c.chunk").alias("context")).where(F.length("__chunk") >= k)
    grams = F.expr(f"posexplode(transform(sequence(1, least({block}, length(__chunk) - {k - 1}), {stride}), j -> substring(__chunk, j, {k})))")
    out = blocks.select(id_col, "__b", "__l", "context", grams.alias("__p", "gram")).withColumn("__p", F.col("__p") * stride)
    return out.select(id_col, (F.col("__b") * block + F.col("__p")).cast("long").alias("pos"), "gram", "context", (F.col("__l") + F.col("__p")).alias("place"))


def match_lines(mems: DataFrame) -> DataFrame:
    """value: `x,i,d` for each match, ready for write.text."""
    return mems.select(F.concat_ws(",", "x", "i", "d").alias("value"))


def write_matches(mems: DataFrame, path: str) -> None:
    match_lines(mems).write.text(path)


def write_sections(sections: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes matches (section, x, i, d) as lines under `>nodes`, `>edges`, `>paths`; each section is contiguous and in the order of x, i, d.

    The order goes on from file to file in the order of their names. one_file: one task writes all sorted lines to one file.
    """
    rank = F.when(F.col("section") == "nodes", 0).when(F.col("section") == "edges", 1).otherwise(2)
    lines = sections.select(rank.alias("s"), F.lit(1).alias("h"), "x", "i", "d", F.concat_ws(",", "x", "i", "d").alias("value"))
    heads = sections.sparkSession.createDataFrame([(i, 0, 0, 0, 0, f">{n}") for i, n in enumerate(("nodes", "edges", "paths"))], "s int, h int, x long, i long, d long, value string")
    order = ["s", "h", "x", "i", "d"]
    every = heads.unionByName(lines)
    every = every.repartition(1).sortWithinPartitions(*order) if one_file else every.orderBy(*order)
    every.select("value").write.text(path)


def write_index(table: DataFrame, path: str) -> None:
    """Saves a suffix or gram table; read it with spark.read.parquet. Its schema is stored with it."""
    table.write.parquet(path)


def content_key(rows: DataFrame, *cols: str) -> str:
    """Names a table by its content, whatever the order of its rows: an index stored under this name is never out of date."""
    one = F.xxhash64(*cols).cast("decimal(38,0)")
    n, a, b = rows.agg(F.count(F.lit(1)), F.sum(one), F.sum(F.xxhash64(*cols, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{a or 0}-{b or 0}".replace("--", "-n")


def cached_index(rows: DataFrame, cols: list[str], folder: str, build) -> DataFrame:
    """The table that build(rows) gives, stored beside earlier ones in folder under the key of the rows' content."""
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(rows, *cols)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
