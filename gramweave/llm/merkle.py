"""Merkle manifest of a dataset with incremental witnesses.

Each row is a leaf. The leaves of a tree (a source) ascend by id; every FAN consecutive nodes of a level have the hash of their digests as
parent, until one node, the tree's subroot, is left. The subroots are the leaves of one more tree, whose subroot is the root.

Leaves are appended. A block is an aligned run of FAN ** HEIGHT nodes, and one task appends its nodes in order to open subtrees, each
of which carries the partial witnesses of the nodes under it; when a third sibling completes a run, all witnesses under the run are extended
by the two digests beside theirs and the run becomes a node of the level above. The root of a complete block is a node that is appended
to the blocks of blocks in the same way, and so on. The store keeps, for each level, closed blocks, which later
appends never touch, and the nodes of the open block at the end of each tree. Reading closes the open runs as they are and puts the witnesses of
a leaf, of its block, of that block's block ... together, by joins on (tree, block) whose keys have at most a block of rows.

A witness has an entry for each level up to the root: one byte with the place of the node in its run, then the digests beside it (32
bytes each; none beside a node that is alone). fold() computes the root from a leaf and a witness.

Cases: nulls in any column have a leaf of their own and a null tree or id comes first; rows with one id are told apart by their leaves, and equal rows
are several leaves; an empty table has no row; other columns are left alone; texts may be of any length. New ids below those that
a tree has are an error, as they would be no append.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramweave.sources.tables import names_in
from gramweave.sources.texts import numbered

from .shared import new_path, scratch, written

FAN, HEIGHT = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(digests: list[bytes]) -> bytes:
    """SHA-256 of digests one after the other as lower-case hex."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def field(value: Column) -> Column:
    """A value as the leaf hashes it: its bytes, a colon and the value as text, or - for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest (32 bytes) of a row's values."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


class OpenRuns:
    """The open subtrees of one block: by level, the nodes of the run that isn't complete, each with the witnesses under it."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, [[]]

    def append(self, digest: bytes) -> list[bytes]:
        """Adds a node; returns its witness, which is extended as later siblings complete its runs."""
        witness: list[bytes] = []
        self._add(0, (digest, [witness]))
        return witness

    def _add(self, level: int, node: tuple[bytes, list]) -> None:
        while True:
            if level == len(self.levels):
                self.levels.append([])
            run = self.levels[level]
            run.append(node)
            if len(run) < self.fan:
                return
            self.levels[level], node, level = [], self._parent(run), level + 1

    @staticmethod
    def _parent(run: list[tuple[bytes, list]]) -> tuple[bytes, list]:
        digests = [d for d, _ in run]
        for at, (_, under) in enumerate(run):
            entry = bytes([at]) + b"".join(digests[:at] + digests[at + 1 :])
            for witness in under:
                witness.append(entry)
        return _hash(digests), [w for _, under in run for w in under]

    def close(self, height: int | None) -> bytes:
        """Closes what is open, up to a height or, if that is None, until one node is left; returns that node's digest."""
        level = 0
        while True:
            run = self.levels[level]
            if len(run) == 1 and (level == height or (height is None and not any(self.levels[level + 1 :]))):
                return run[0][0]
            if run:
                self.levels[level] = []
                self._add(level + 1, self._parent(run))
            level += 1


def _blocks(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """nodes (tree, block, pos, digest, up, ...) with witness (within the block) and node (the block's root). up: whether the tree has more blocks."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        runs = OpenRuns(fan)
        witnesses = [runs.append(d) for d in table["digest"].to_pylist()]
        node = runs.close(height if table["up"][0].as_py() else None)
        return table.append_column("witness", pa.array(witnesses, pa.list_(pa.binary()))).append_column("node", pa.array([node] * len(witnesses), pa.binary()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.groupBy("tree", "block").applyInArrow(work, f"{kinds}, witness array<binary>, node binary")


def positions(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Adds pos, from 0 in each tree by id and digest, from ranges and their totals: no task needs a whole tree. held: tree, n, last of what a tree has already."""
    key = [F.col("tree"), F.col("id"), F.col("digest")]
    dealt = written(rows.repartitionByRange(*key, F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "leaf-ranges")
    totals = dealt.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("tree", "__part", "low", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("s"))
    if held is not None:
        met = starts.join(held, "tree", "left")
        sound = F.col("last").isNull() | (F.col("low") > F.col("last"))
        s = F.when(sound, F.col("s") + F.coalesce("n", F.lit(0))).otherwise(F.raise_error(F.lit("appended ids must be above those that their tree has")).cast("long"))
        starts = met.select("tree", "__part", s.alias("s"))
    else:
        starts = starts.select("tree", "__part", "s")
    inside = F.row_number().over(Window.partitionBy("tree", "__part").orderBy("id", "digest")) - 1
    return dealt.withColumn("__n", inside).join(starts, ["tree", "__part"]).withColumn("pos", F.col("__n") + F.col("s")).drop("__part", "__n", "s")


class Manifest:
    """A store in a folder: for each append and level the blocks that it closed, and for the last append the nodes of open blocks and the trees' sizes."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN, height: int = HEIGHT):
        self.spark, self.folder, self.fan, self.height, self.width = spark, folder.rstrip("/"), fan, height, fan**height
        found = [int(n) for n in names_in(spark, self.folder) if n.isdigit()]
        self.last = max((n for n in found if "_SUCCESS" in names_in(spark, f"{self.folder}/{n}/trees")), default=-1)  # trees are written last

    def _paths(self, kind: str, level: int) -> list[str]:
        numbers = range(self.last + 1) if kind == "closed" else [self.last]
        paths = [f"{self.folder}/{n}/{kind}-{level}" for n in numbers]
        return [p for p in paths if "_SUCCESS" in names_in(self.spark, p)]

    def _read(self, kind: str, level: int) -> DataFrame | None:
        out = None
        for path in self._paths(kind, level):
            rows = self.spark.read.parquet(path)
            out = rows if out is None else out.unionByName(rows)
        return out

    def trees(self) -> DataFrame | None:
        """tree, n, last: how many leaves a tree has, and its last id."""
        return self.spark.read.parquet(f"{self.folder}/{self.last}/trees") if self.last >= 0 else None

    def append(self, leaves: DataFrame) -> None:
        """Appends leaves: tree, id, digest, and what else is to be kept with them."""
        held = self.trees()
        self.append_placed(positions(leaves, held))

    def append_placed(self, placed: DataFrame) -> None:
        """Appends leaves whose place in the tree, pos, is known."""
        held, now = self.trees(), f"{self.folder}/{self.last + 1}"
        nodes = written(placed, "merkle-leaves")
        sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        level = 0
        while True:
            waiting = self._read("open", level)
            if waiting is not None:
                nodes = nodes.unionByName(waiting)
            dealt = nodes.withColumn("block", F.floor(F.col("pos") / self.width))
            counts = written(dealt.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == self.width), "merkle-full")
            dealt.join(counts, ["tree", "block"], "left_anti").drop("block").write.parquet(f"{now}/open-{level}")
            full = dealt.join(counts.drop("__n"), ["tree", "block"]).withColumn("up", F.lit(True))
            _blocks(full, self.fan, self.height).drop("up").write.parquet(f"{now}/closed-{level}")
            closed = self.spark.read.parquet(f"{now}/closed-{level}")
            nodes = closed.select("tree", F.col("block").alias("pos"), F.col("node").alias("digest")).distinct()
            level += 1
            if counts.isEmpty() and not self._paths("open", level):
                break
        if held is not None:
            sizes = sizes.unionByName(held).groupBy("tree").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        sizes.write.parquet(f"{now}/trees")
        self.last += 1

    def witnesses(self, top: bool = True) -> DataFrame:
        """The leaves as they were appended, with witness (array<binary>) up to the root, subroot and root; without top, up to the subroot.

        Of a manifest without leaves there is no row to return: None.
        """
        trees = self.trees()
        largest = trees.agg(F.max("n")).first()[0] if trees is not None else None
        if not largest:
            return None
        rows, below, ends, level, most = [], None, None, 0, largest
        while True:
            waiting, closed = self._read("open", level), self._read("closed", level)
            own = ["tree", "pos", "digest"] if level else [c for c in waiting.columns]
            nodes = waiting.select(*own) if waiting is not None else None
            if below is not None:
                nodes = below if nodes is None else nodes.unionByName(below)
            wide = self.width ** (level + 1)
            sized = trees.select("tree", (F.col("n") >= wide).alias("up"))  # there is a closed block on this level
            partial = written(_blocks(nodes.join(sized, "tree").withColumn("block", F.floor(F.col("pos") / self.width)), self.fan, self.height), "merkle-open")
            done = partial.where("not up").select("tree", F.col("node").alias("digest")).distinct()
            ends = done if ends is None else ends.unionByName(done)
            below = partial.where("up").select("tree", F.col("block").alias("pos"), F.col("node").alias("digest")).distinct()
            partial = partial.withColumn("end", ~F.col("up")).drop("up")
            rows.append(partial if closed is None else partial.unionByName(closed.withColumn("end", F.lit(False))))
            if most < wide:
                break
            level += 1
        above = self._above(written(ends, "merkle-subroots")) if top else ends.select("tree", F.col("digest").alias("subroot"), F.array().cast("array<binary>").alias("rest"), F.lit(None).cast("binary").alias("root"))
        above = written(above, "merkle-top")
        upper = None
        for level in reversed(range(len(rows))):
            own = rows[level]
            ended = own.where("end").join(above, "tree")
            out = ended.withColumn("witness", F.concat("witness", "rest")).drop("rest", "end", "node", "block")
            if upper is not None:
                met = own.where("not end").join(upper, ["tree", "block"])
                out = out.unionByName(met.withColumn("witness", F.concat("witness", "rest")).drop("rest", "end", "node", "block"))
            if level:
                upper = written(out.select("tree", F.col("pos").alias("block"), F.col("witness").alias("rest"), "subroot", "root"), "merkle-upper")
        return out

    def _above(self, subroots: DataFrame) -> DataFrame:
        """tree, subroot, rest (its witness up to the root), root: the subroots as leaves of one tree, in the order of their trees."""
        placed = numbered(subroots, ["tree"], "pos").select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", (F.col("pos") - 1).alias("pos"))
        over = Manifest(self.spark, new_path(self.spark, "merkle-top"), self.fan, self.height)
        over.append_placed(placed)
        found = over.witnesses(top=False)
        return found.select(F.col("id").alias("tree"), F.col("digest").alias("subroot"), F.col("witness").alias("rest"), F.col("subroot").alias("root"))


def tree_key(source: Column) -> Column:
    """A source as the name of its tree: null is before all others, even the empty one."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def leaves_of(docs: DataFrame, columns: Sequence[str] = COLUMNS, tree_col: str = "source", id_col: str = "doc_id", **more: Column) -> DataFrame:
    """tree, id, digest of each row, ready to append; more: other columns to keep."""
    return docs.select(tree_key(F.col(tree_col)).alias("tree"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in more.items()])


def folded(digest: bytes, witness: list[bytes]) -> bytes:
    """The root that follows from a leaf and its witness."""
    for entry in witness:
        beside = [entry[i : i + 32] for i in range(1, len(entry), 32)]
        digest = _hash([*beside[: entry[0]], digest, *beside[entry[0] :]])
    return digest


def proof_digest(witness: list[bytes]) -> bytes:
    """The hash of all digests of a witness, level by level."""
    return _hash([entry[i : i + 32] for entry in witness for i in range(1, len(entry), 32)])


def fold(rows: DataFrame, digest: str, witness: str = "witness") -> DataFrame:
    """Adds folded_root and proof (binary): what a digest and its witness give."""

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            lists = batch.column(at(witness)).to_pylist()
            roots = [folded(d, w) for d, w in zip(batch.column(at(digest)).to_pylist(), lists, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(roots, pa.binary()), pa.array([proof_digest(w) for w in lists], pa.binary())], names=[*batch.schema.names, "folded_root", "proof"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kinds}, folded_root binary, proof binary")


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of docs held against docs in which the texts of some rows (2 divides the CRC-32 of their id) lost their line breaks."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "tamper-check")
    shown = lambda c: F.lower(F.hex(c))
    with scratch(spark):
        touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
        text = F.when(touched, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
        seen = leaf(*[text if c == "text" else F.col(c) for c in COLUMNS])
        own = written(leaves_of(docs, seen=seen), "leaves")
        manifest = Manifest(spark, new_path(spark, "manifest"))
        manifest.append(own)
        rows = manifest.witnesses()
        if rows is None:
            rows = own.withColumns({"witness": F.array().cast("array<binary>"), "subroot": F.col("digest"), "root": F.col("digest")})
        out = fold(rows.select("id", "digest", "seen", "witness", "subroot", "root"), "seen")
        out = out.select(F.col("id").alias("doc_id"), shown("digest").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"), shown("proof").alias("proof_sha256"), shown("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
        out.write.parquet(path)
        schema = out.schema
    return spark.read.schema(schema).parquet(path)
