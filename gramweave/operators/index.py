"""A stored gram index that locate() and mems() ask, and that follows its texts.

Texts give the grams of w characters at every s-th place, with s - 1 characters on either side, as mems() cuts them: w + s - 1 is `least`, and any
string of that length holds one of these grams. A task puts the places of each gram in its texts together in one row, LISTED of them at most. These rows are stored
in tables dealt to buckets by gram, so what is asked comes to the index and its grams never move; only lists of grams that are asked for are taken apart.

Texts are dealt to parts. The manifest names each part's content by a key and the build that has it; an update builds a table of the parts
whose key has changed (of much text several, one after the other, which needs less room for what moves), and the rows that older builds hold of these parts, or of parts that are gone, are left out as they are read. A build is used
once its manifest is written, so an update that fails leaves the index as it was. merge() writes all that is in use to one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.sources.packing import bytes_of, edges_of, packed, packed_strings, unpacked, unpacked_strings
from gramweave.sources.tables import bucketed, buckets, names_in, open_bucketed, release, written
from gramweave.sources.texts import kmers_in_context

#: Parts that texts are dealt to by their ids, if no column says otherwise.
PARTS = 256
#: Bytes of texts that are cut together, and places of a gram in one row.
TOGETHER, LISTED = 6 << 20, 4096
#: In how many turns an update builds what has changed, at most, and of how many characters each is, at least: a turn moves its own places only.
TURNS, TURN = 4, 64 << 20
#: Places of a bucket that are put in lists together, lists that leave a worker at once, and what places are packed to.
MERGED, GIVEN = 1 << 19, 1024
PACK = ["deal", "texts", "gram_sizes", "grams", "counts", "which", "xs", "beside_sizes", "besides"]


def stride_of(least: int) -> tuple[int, int]:
    """w and s for matches of `least` characters."""
    s = max(1, least // 2)
    return least - s + 1, s


def grams_in_context(rows: DataFrame, id_col: str, at: str, w: int, s: int, stride: int, side: str) -> DataFrame:
    """id, at, gram, and the s - 1 characters before (reversed) and after it."""
    found = kmers_in_context(rows, id_col, "text", w, s - 1, w + s - 1, stride=stride)
    near = F.least("place", F.lit(s - 1))
    before = F.reverse(F.substring("context", F.col("place") - near + 1, near))
    after = F.substring("context", F.col("place") + w + 1, F.lit(s - 1))
    return found.select(id_col, F.col("pos").alias(at), "gram", before.alias(f"{side}_before"), after.alias(f"{side}_after"))


def cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, each: int = 1) -> pa.Array:
    """Strings of a UTF-8 array, from the bytes of `each` consecutive ranges."""
    size = end - begin
    total = np.append(0, np.cumsum(size))
    place = np.repeat((begin - total[:-1]).astype("i4"), size) + np.arange(total[-1], dtype="i4")
    return pa.StringArray.from_buffers(len(begin) // each, pa.py_buffer(total[::each].astype("i4")), pa.py_buffer(raw[place]))


def _parts(column: pa.Array, w: int, s: int, together: int) -> Iterator[tuple[list[tuple[int, int, int, int]], list[np.ndarray]]]:
    """About `together` bytes of texts at a time: (number of the text, place of its first character, place of its first gram, most grams) of each part, and its bytes; a long text in parts that overlap."""
    marks, held, size = [], [], 0
    for i, text in enumerate(column):
        raw = text.as_buffer()
        own = [(i, 0, 0, 1 << 31, raw)]
        if raw is not None and raw.size > together:
            chars, step = text.as_py(), max(1, together // s) * s
            own = [(i, max(0, at - s + 1), at, step // s, chars[max(0, at - s + 1) : at + step + w + s - 2].encode()) for at in range(0, len(chars), step)]
        for *mark, raw in own:
            marks.append(tuple(mark))
            held.append(np.frombuffer(raw or b"", "u1"))
            size += len(held[-1])
            if size >= together:
                yield marks, held
                marks, held, size = [], [], 0
    if marks:
        yield marks, held


def listed(gram: pa.Array, values: dict[str, pa.Array], most: int = LISTED) -> pa.RecordBatch:
    """gram and a list of each value, the rows of one gram together, `most` of them at most."""
    coded = gram.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    turn = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    first = np.flatnonzero(turn % most == 0)
    edges, order = pa.array(np.append(first, len(code)), pa.int32()), pa.array(order)
    lists = [pa.ListArray.from_arrays(edges, v.take(order)) for v in values.values()]
    return pa.record_batch([coded.dictionary.take(pa.array(code[first])), *lists], names=["gram", *values])


def _flat(batch: pa.RecordBatch, w: int, s: int, together: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """gram, number of the text, place, besides: a row for each place of a batch (part, doc_id, text), of about `together` bytes of texts at a time."""
    for marks, held in _parts(batch.column(2), w, s, together):
        raw = np.concatenate(held)
        text, base, at, most = np.array(marks, "i8").T
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype("i4")  # where each character begins
        edge = np.searchsorted(chars, np.cumsum([0] + [len(x) for x in held]))
        low, high = edge[:-1], edge[1:]
        n = np.clip((high - low - (at - base) - w) // s + 1, 0, most)
        part = np.repeat(np.arange(len(n)), n)
        x = at[part] + s * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        p = low[part] + x - base[part]
        near, after = np.minimum(x, s - 1), np.minimum(p + w + s - 1, high[part])
        begin, end = np.stack([chars[p - near], chars[p + w]], 1), np.stack([chars[p], chars[after]], 1)
        yield cut(raw, chars[p], chars[p + w]), text[part], x, cut(raw, begin.ravel(), end.ravel(), 2)


def _kinds(rows: DataFrame) -> str:
    return f"gram string, parts array<string>, docs array<{rows.schema['doc_id'].dataType.simpleString()}>, xs array<long>, besides array<string>"


def gram_lists(rows: DataFrame, w: int, s: int, together: int = TOGETHER) -> DataFrame:
    """gram, parts, docs, xs, besides of texts (part, doc_id, text): where grams of w characters stand at multiples of s, with the s - 1 characters before and after them."""

    def work(batches):
        for batch in batches:
            for gram, text, x, besides in _flat(batch, w, s, together):
                yield listed(gram, {"parts": batch.column(0).take(pa.array(text)), "docs": batch.column(1).take(pa.array(text)), "xs": pa.array(x), "besides": besides})

    return rows.select("part", "doc_id", "text").mapInArrow(work, _kinds(rows))


def bucket_of(strings: pa.Array, n: int) -> np.ndarray:
    """The bucket among n that Spark's hash() deals each string to. It saves moves only: what it told wrong would be written to a file more."""
    edges, raw = edges_of(strings), bytes_of(strings)
    size, out = np.diff(edges), np.zeros(len(strings), "u4")
    turned = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    mixed = lambda h, k: turned(h ^ turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        chars = raw[edges[own][:, None] + np.arange(m)]
        h = np.full(len(own), 42, "u4")
        for j in range(0, m - m % 4, 4):
            h = mixed(h, np.ascontiguousarray(chars[:, j : j + 4]).view("<u4").ravel())
        for j in range(m - m % 4, m):
            h = mixed(h, chars[:, j].astype("i1").astype("i4").view("u4"))
        h ^= np.uint32(m)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[own] = h ^ h >> np.uint32(16)
    return np.mod(out.view("i4").astype("i8"), n)


def _packs(batch: pa.RecordBatch, gram: pa.Array, text: np.ndarray, x: np.ndarray, besides: pa.Array, s: int, n: int) -> pa.RecordBatch:
    """The places that go to each of n buckets, in the order of their grams, packed: deal, the texts that occur, and numbers and strings of the places."""
    coded = gram.dictionary_encode()
    deal = bucket_of(coded.dictionary, n)
    order = pa.table({"deal": deal, "gram": coded.dictionary, "at": np.arange(len(deal))}).sort_by([("deal", "ascending"), ("gram", "ascending")])["at"].to_numpy()
    rank = np.argsort(order)
    code = rank[coded.indices.to_numpy()]
    places = np.argsort(code, kind="stable")
    grams, besides, text, x = coded.dictionary.take(pa.array(order)), besides.take(pa.array(places)), text[places], x[places]
    count = np.bincount(code, minlength=len(order))
    first, begin = np.searchsorted(deal[order], np.arange(n + 1)).tolist(), np.append(0, np.cumsum(count))
    out = []
    for d, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        if a < b:
            lo, hi = int(begin[a]), int(begin[b])
            used, which = np.unique(text[lo:hi], return_inverse=True)
            sink = pa.BufferOutputStream()
            texts = pa.record_batch([batch.column(c).take(pa.array(used)) for c in (0, 1)], names=["part", "doc_id"])
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(texts)
            out.append((d, sink.getvalue().to_pybytes(), *packed_strings(grams.slice(a, b - a)), packed(count[a:b]), packed(which), packed(x[lo:hi] // s), *packed_strings(besides.slice(lo, hi - lo))))
    columns = zip(*out, strict=True) if out else [()] * len(PACK)
    return pa.record_batch([pa.array(c, pa.int32() if k == "deal" else pa.binary()) for k, c in zip(PACK, columns, strict=True)], names=PACK)


def moved_lists(rows: DataFrame, w: int, s: int, n: int, together: int = TOGETHER, most: int = MERGED) -> DataFrame:
    """As gram_lists(), each row in the partition of its bucket, and lists of up to `most` places merged there. The places of many texts move together, packed: as rows they would be several times the texts."""

    def pack(batches):
        for batch in batches:
            for one in _flat(batch, w, s, together):
                yield _packs(batch, *one, s, n)

    def read(batches):
        for batch in batches:
            for _, texts, sizes, grams, count, which, x, beside_sizes, besides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, which = pa.ipc.open_stream(texts).read_all(), pa.array(unpacked(which))
                gram = unpacked_strings(sizes, grams).take(pa.array(np.repeat(np.arange(len(c := unpacked(count))), c)))
                part, doc = (own[c].combine_chunks().take(which) for c in ("part", "doc_id"))
                yield pa.record_batch([gram, part, doc, pa.array(unpacked(x).astype("i8") * s), unpacked_strings(beside_sizes, besides)], names=["gram", "parts", "docs", "xs", "besides"])

    def unpack(batches):
        held, size = [], 0
        for batch in chain(read(batches), [None]):
            if held and (batch is None or size + batch.num_rows > most):
                whole = pa.Table.from_batches(held).combine_chunks()
                lists = listed(whole["gram"].combine_chunks(), {c: whole[c].combine_chunks() for c in whole.column_names[1:]})
                held, size, whole = [], 0, None
                for at in range(0, lists.num_rows, GIVEN):
                    yield lists.slice(at, GIVEN)
                lists = None
                pa.default_memory_pool().release_unused()
            if batch is not None:
                held.append(batch)
                size += batch.num_rows

    sent = rows.select("part", "doc_id", "text").mapInArrow(pack, ", ".join(f"{c} {'int' if c == 'deal' else 'binary'}" for c in PACK))
    return sent.repartitionById(n, "deal").mapInArrow(unpack, _kinds(rows))


def _listed_again(rows: DataFrame) -> DataFrame:
    """Rows of one place each in lists; grams that follow each other, as stored tables have them, come together."""

    def work(batches):
        for batch in batches:
            yield listed(batch.column(0), dict(zip(batch.schema.names[1:], batch.columns[1:], strict=True)))

    kinds = [f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(work, ", ".join(["gram string", *kinds]))


class GramIndex:
    """The index in a folder; opening the folder again finds what was built. The folder's own file says for which length it is."""

    def __init__(self, spark: SparkSession, folder: str, least: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = [int(n.split("-")[1]) for n in names_in(spark, self.folder) if n.startswith("least-")]
        if not known:
            if least is None or least < 1:
                raise ValueError("a new index needs the length of the shortest match, 1 or more")
            spark.range(0).write.parquet(f"{self.folder}/least-{least}")
        elif least not in (None, known[0]):
            raise ValueError(f"the index is for matches of {known[0]} characters")
        self.least = known[0] if known else least
        self.w, self.s = stride_of(self.least)
        self._opened: dict[str, DataFrame] = {}

    def _last(self) -> int:
        numbers = [int(n.split("-")[1]) for n in names_in(self.spark, self.folder) if n.startswith("manifest-")]
        return max((n for n in numbers if "_SUCCESS" in names_in(self.spark, f"{self.folder}/manifest-{n}")), default=-1)

    def manifest(self) -> DataFrame | None:
        """part, content, build: what the index holds."""
        last = self._last()
        return self.spark.read.parquet(f"{self.folder}/manifest-{last}") if last >= 0 else None

    def update(self, texts: DataFrame, part: Column | None = None) -> int:
        """Makes the index that of texts (doc_id, text); returns how many parts it built. part: which part a text belongs to, by its id if not given."""
        number = self._last() + 1
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) if part is None else part
        rows = texts.where("text is not null").select("doc_id", "text", part.cast("string").alias("part"))
        sums = [F.sum(F.xxhash64("doc_id", "text", F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (0, 1)]
        now = rows.groupBy("part").agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), *sums).alias("content"), F.sum(F.length("text")).alias("size"))
        held = self.manifest()
        if held is not None:
            now = now.join(held, ["part", "content"], "left")
        else:
            now = now.withColumn("build", F.lit(None).cast("string"))
        n = buckets(self.spark)
        now = written(now, "index-parts")
        changed, size = now.where("build is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        turns = max(1, min(TURNS, -(-size // TURN)))
        turn = F.pmod(F.xxhash64("part"), F.lit(turns))
        names = [f"grams-{number}-{n}-{t}" for t in range(turns)]
        for t, name in enumerate(names if changed else []):  # each turn's shuffle goes before the next
            new = now.where(F.col("build").isNull() & (turn == t)).select("part")
            few = F.broadcast(new) if changed <= 100_000 else new
            bucketed(moved_lists(rows.join(few, "part", "left_semi"), self.w, self.s, n), f"{self.folder}/{name}", ["gram"], n, placed=True)
            release(self.spark)
        build = F.coalesce("build", F.element_at(F.array(*[F.lit(x) for x in names]), (turn + 1).cast("int")))
        now.select("part", "content", build.alias("build")).write.parquet(f"{self.folder}/manifest-{number}")
        return changed

    def _tables(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        """The tables in use as they are stored, and which parts of each are."""
        manifest = self.manifest()
        if manifest is None:
            return
        for build in sorted(r.build for r in manifest.select("build").distinct().collect()):  # TURNS for each update at most
            if not any(n.startswith("part-") for n in names_in(self.spark, f"{self.folder}/{build}")):
                continue  # its texts are all shorter than a gram
            if build not in self._opened:
                self._opened[build] = open_bucketed(self.spark, f"{self.folder}/{build}", ["gram"], int(build.split("-")[2]))
            own = manifest.where(F.col("build") == build).select("part")
            yield self._opened[build], F.broadcast(own) if own.count() <= 100_000 else own

    def _places(self, table: DataFrame, own: DataFrame, *more: Column) -> DataFrame:
        """A row for each place in the lists, without what is out of date, and with more columns. What was asked may have a column of any name."""
        others = [c for c in table.columns if c not in ("parts", "docs", "xs", "besides")]
        rows = table.select(*others, F.inline(F.arrays_zip("parts", "docs", "xs", "besides"))).join(own.withColumnRenamed("part", "parts"), "parts", "left_semi")
        near = F.least("xs", F.lit(self.s - 1)).cast("int")
        sides = [F.reverse(F.substring("besides", F.lit(1), near)).alias("t_before"), F.substring("besides", near + 1, F.lit(self.s - 1)).alias("t_after")]
        return rows.select(*more, F.col("docs").alias("doc_id"), F.col("xs").alias("x"), *others, *sides)

    def builds(self) -> list[DataFrame]:
        """The tables in use: part, doc_id, x, gram, t_before, t_after, without what is out of date."""
        return [self._places(*one, F.col("parts").alias("part")) for one in self._tables()]

    def merge(self) -> None:
        """Writes what is in use to one table."""
        tables, manifest = self.builds(), self.manifest()
        if len(tables) > 1:
            number, n = self._last() + 1, buckets(self.spark)
            rows = tables[0]
            for more in tables[1:]:
                rows = rows.unionByName(more)
            rows = rows.select("gram", F.col("part").alias("parts"), F.col("doc_id").alias("docs"), F.col("x").alias("xs"), F.concat(F.reverse("t_before"), "t_after").alias("besides"))
            name = f"grams-{number}-{n}"
            bucketed(_listed_again(rows), f"{self.folder}/{name}", ["gram"], n)
            manifest.withColumn("build", F.lit(name)).write.parquet(f"{self.folder}/manifest-{number}")

    def hits(self, asked: DataFrame) -> DataFrame:
        """The stored grams that are equal to an asked one, with the columns of both. Each table is joined for itself, as a union would lose its buckets."""
        out = None
        for table, own in self._tables():
            met = self._places(table.join(asked, "gram"), own)
            out = met if out is None else out.unionByName(met)
        if out is None:
            raise ValueError("the index holds no grams: update() it with texts of its length")
        return out
