"""How far apart the word statistics of sources are, by a recount with minimal perfect hashes.

The first pass over the texts counts exactly in how many documents of its language each term occurs, and keeps those of `least` or more. The kept
terms are cut by hash into shards of about SHARD terms; a task for each shard builds its minimal perfect hash: levels of bits, each
as wide as a multiple of the terms still left, where a term that has a bit for itself gets it, and its slot is the number of bits before it. The
shards hold the terms in the order of their slots, so a look-up compares the stored term with the one asked for and no other
term is ever counted for it.

The shards go to every executor if their summed size, counted before, is at most `most_bytes`. The second pass then looks up each distinct
term of a slice of text once and increments slots of dense arrays, one for each (language, source) that the task has met; arrays of more than
CELLS slots together are given out and begun anew. Beyond that size the second pass gives out the counts of all terms of a slice, and a
join on (language, term) takes those of the shards. Both give the same counts: language, source, slot, n.

From there on all is sums, in integers and decimals. Pairs of sources are compared in tiles: two blocks of sources by one block of slots,
where terms that neither block has are settled by the groups' shares for a count of 0.

Cases: null text, language and source are empty ones; empty texts are documents without terms; rows are documents, repeated ones too; texts
are cut by bytes, so a long one costs its length; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Documents of its language that a term must occur in, what is added to each count, and the whole that shares are parts of.
LEAST, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms of a shard, bits for each term left on a level, and levels before terms are held in a list.
SHARD, SPARE, LEVELS = 4096, 2, 40
#: Bytes of shards up to which they are sent to every executor, slots that a task counts in at a time, and bytes of text that are cut together.
MOST_BYTES, CELLS, AT_ONCE = 64 << 20, 4_000_000, 8_000_000
#: Languages up to which their sizes go to every executor.
MOST_LANGS = 100_000
#: Sources and slots of a tile's sides.
SOURCES, SLOTS = 128, 2048

#: Bytes of terms as they are, A-Z in lower case, and a space for all others.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _plain(texts: pa.StringArray) -> pa.StringArray:
    """Texts with only their terms, in lower case, and spaces."""
    ends = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset)
    held = texts.buffers()[2]
    data = bytes(memoryview(held)[ends[0] : ends[-1]]).translate(LETTERS) if held else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data))


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.StringArray]]:
    """For batches whose last column is the text: rows of about AT_ONCE bytes, the row and the term's number of each term, and the distinct terms."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(sizes[at + 1 :], sizes[at] + AT_ONCE, "right")))
            lists = pc.ascii_split_whitespace(_plain(texts.slice(at, n)))
            coded = lists.flatten().dictionary_encode()
            codes, row = coded.indices.to_numpy(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            blank = pc.index(coded.dictionary, "").as_py()
            if blank >= 0:
                row, codes = row[codes != blank], codes[codes != blank]
            yield batch.slice(at, n), row, codes, coded.dictionary
            at += n
    pa.default_memory_pool().release_unused()


def _seen(docs: DataFrame, text_col: str, *groups: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(n) for g, n in zip(groups, ("lang", "source"), strict=False)], F.coalesce(text_col, F.lit("")).alias("text"))


def document_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, term, n: in how many documents of the language each term occurs."""

    def work(batches):
        for rows, row, codes, terms in slices_of(batches):
            langs = rows.column(0).dictionary_encode()
            width = max(1, len(terms))
            once = np.unique(row.astype("i8") * width + codes)
            keys, n = np.unique(langs.indices.to_numpy()[once // width].astype("i8") * width + once % width, return_counts=True)
            yield pa.record_batch([langs.dictionary.take(pa.array(keys // width)), terms.take(pa.array(keys % width)), pa.array(n)], names=["lang", "term", "n"])

    return _seen(docs, text_col, lang_col).mapInArrow(work, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(lang: str, terms: list[str]) -> np.ndarray:
    """What Spark's xxhash64(lang, term) gives, unsigned."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), seed) for t in terms), "u8", len(terms))


class PerfectHash:
    """A minimal perfect hash of distinct strings: slots from 0 to their number, less 1, and none for other strings, as the stored ones are compared."""

    def __init__(self, levels: list[bytes], widths: list[int], terms: pa.StringArray):
        self.widths, self.terms = widths, terms
        self.bits = [np.unpackbits(np.frombuffer(x, "u1"), count=w).astype(bool) for x, w in zip(levels, widths, strict=True)]
        base = np.cumsum([0, *[b.sum() for b in self.bits]])
        self.slots = [np.cumsum(b) - 1 + at for b, at in zip(self.bits, base, strict=False)]
        self.rest = {t: int(base[-1]) + i for i, t in enumerate(terms.slice(int(base[-1])).to_pylist())}

    @classmethod
    def of(cls, terms: list[str], keys: np.ndarray) -> PerfectHash:
        levels, widths, order, left = [], [], [], np.arange(len(terms))
        while len(left) and len(levels) < LEVELS:
            width = SPARE * len(left) + 1
            at = (_mixed(keys[left], len(levels)) % np.uint64(width)).astype("i8")
            alone = np.bincount(at, minlength=width) == 1
            levels.append(np.packbits(alone).tobytes())
            widths.append(width)
            own = left[alone[at]]
            order.append(own[np.argsort(at[alone[at]])])
            left = left[~alone[at]]
        return cls(levels, widths, pa.array(terms, pa.string()).take(pa.array(np.concatenate([*order, left]).astype("i8"))))

    def stored(self) -> tuple[list[bytes], list[int], list[str]]:
        return [np.packbits(b).tobytes() for b in self.bits], self.widths, self.terms.to_pylist()

    def find(self, terms: pa.StringArray, keys: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for those that aren't stored."""
        slot = np.full(len(keys), -1, "i8")
        for level, (bits, slots) in enumerate(zip(self.bits, self.slots, strict=True)):
            open_ = np.flatnonzero(slot < 0)
            at = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype("i8")
            slot[open_] = np.where(bits[at], slots[at], -1)
        met = np.flatnonzero(slot >= 0)
        same = pc.equal(self.terms.take(pa.array(slot[met])), terms.take(pa.array(met))).to_numpy(zero_copy_only=False)
        slot[met[~same]] = -1
        if self.rest:  # terms that share all their bits
            for i in np.flatnonzero(slot < 0):
                slot[i] = self.rest.get(terms[i].as_py(), -1)
        return slot


def build_shards(kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """lang, shard, shards (of the language), base (slots before this shard), levels, widths, terms (by slot): one row for each shard of kept (lang, term). A written table."""
    counts = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "term-counts")
    if counts.count() <= MOST_LANGS:
        counts = F.broadcast(counts)
    number = F.ceil(F.col("v") / shard)
    # xxhash64(lang, term) also is the key of the hash; its upper bits deal the terms out
    dealt = kept.join(counts, "lang").select("lang", "term", number.alias("shards"), (F.shiftrightunsigned(F.xxhash64("lang", "term"), 33) % number).alias("shard"))

    def work(table: pa.Table) -> pa.Table:
        lang, terms = table["lang"][0].as_py(), sorted(table["term"].to_pylist())
        levels, widths, stored = PerfectHash.of(terms, keys_of(lang, terms)).stored()
        values = [[lang], [table["shard"][0].as_py()], [table["shards"][0].as_py()], [len(stored)], [levels], [widths], [stored]]
        return pa.table(dict(zip(names, (pa.array(v, k) for v, k in zip(values, kinds, strict=True)), strict=True)))

    names = ["lang", "shard", "shards", "size", "levels", "widths", "terms"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.string())]
    found = written(dealt.groupBy("lang", "shard").applyInArrow(work, "lang string, shard long, shards long, size long, levels array<binary>, widths array<long>, terms array<string>"), "term-shards")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = found.select("lang", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))  # a row for each shard
    return written(found.join(base, ["lang", "shard"]), "term-shards")


class Slots:
    """The shards of all languages in a task."""

    def __init__(self, rows: list[tuple]):
        self.of: dict[str, tuple[int, dict]] = {}
        self.sizes: dict[str, int] = {}
        for lang, shard, shards, base, levels, widths, terms in rows:
            self.of.setdefault(lang, (shards, {}))[1][shard] = base, PerfectHash(levels, widths, pa.array(terms, pa.string()))
            self.sizes[lang] = self.sizes.get(lang, 0) + len(terms)

    def find(self, lang: str, terms: pa.StringArray) -> np.ndarray:
        out = np.full(len(terms), -1, "i8")
        if lang in self.of:
            shards, held = self.of[lang]
            keys = keys_of(lang, terms.to_pylist())
            number = (keys >> np.uint64(33)) % np.uint64(shards)
            for shard in np.unique(number).tolist():
                if shard in held:
                    own, (base, hashes) = np.flatnonzero(number == shard), held[shard]
                    slot = hashes.find(terms.take(pa.array(own)), keys[own])
                    out[own] = np.where(slot < 0, -1, slot + base)
        return out


def _recounted(docs: DataFrame, shards: DataFrame, cells_most: int) -> DataFrame:
    """lang, source, slot, n from dense slots, the shards being on every executor."""
    rows = [(r.lang, r.shard, r.shards, r.base, [bytes(x) for x in r.levels], r.widths, r.terms) for r in shards.collect()]  # at most most_bytes
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def work(batches):
        slots, groups, cells = Slots(held.value), {}, np.zeros(0, "i8")

        def given() -> pa.RecordBatch:
            found, starts = np.flatnonzero(cells), np.fromiter(groups.values(), "i8")
            which = np.searchsorted(starts, found, "right") - 1
            names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(which)) for k in (0, 1)]
            return pa.record_batch([*names, pa.array(found - starts[which]), pa.array(cells[found])], names=["lang", "source", "slot", "n"])

        for batch, row, codes, terms in slices_of(batches):
            langs = batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()[row]
            table = np.full((len(langs.dictionary), len(terms)), -1, "i8")
            for i, name in enumerate(langs.dictionary.to_pylist()):
                used = np.unique(codes[lang == i])
                table[i, used] = slots.find(name, terms.take(pa.array(used)))
            slot = table[lang, codes]
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = {g: i for i, g in enumerate(dict.fromkeys(keys))}
            group = np.array([number[k] for k in keys])[row]
            group, slot = group[slot >= 0], slot[slot >= 0]
            waiting = [g for g in number if g[0] in slots.sizes]
            while waiting:
                start, size, n = np.full(len(number), -1, "i8"), len(cells), 0
                for g in waiting:
                    if g not in groups:
                        if groups and size + slots.sizes[g[0]] > cells_most:
                            break
                        groups[g], size = size, size + slots.sizes[g[0]]
                    start[number[g]] = groups[g]
                    n += 1
                own = start[group] >= 0
                cells = np.concatenate([cells, np.zeros(size - len(cells), "i8")])
                cells += np.bincount(start[group[own]] + slot[own], minlength=size)
                waiting = waiting[n:]
                if waiting:  # the next group needs more slots than are left
                    yield given()
                    groups, cells = {}, np.zeros(0, "i8")
        if groups:
            yield given()

    return docs.mapInArrow(work, "lang string, source string, slot long, n long")


def _joined(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """The same, for shards of any size: counts of all terms meet the stored terms."""

    def work(batches):
        for batch, row, codes, terms in slices_of(batches):
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            group = langs.indices.to_numpy().astype("i8") * len(sources.dictionary) + sources.indices.to_numpy()
            width = max(1, len(terms))
            keys, n = np.unique(group[row] * width + codes, return_counts=True)
            of = keys // width
            columns = [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), terms.take(pa.array(keys % width)), pa.array(n)]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n"])

    found = docs.mapInArrow(work, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(slot_terms(shards), ["lang", "term"]).select("lang", "source", "slot", "n")


def slot_terms(shards: DataFrame) -> DataFrame:
    """lang, slot, term."""
    cut = shards.select("lang", "base", F.posexplode("terms").alias("at", "term"))
    return cut.select("lang", (F.col("base") + F.col("at")).alias("slot"), "term")


def recount(docs: DataFrame, shards: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most_bytes: int = MOST_BYTES, cells: int = CELLS) -> DataFrame:
    """lang, source, slot, n: how often each kept term occurs in each group that has it."""
    size = shards.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8) + 64), F.lit(0))).first()[0]
    docs = _seen(docs, text_col, lang_col, source_col)
    found = _recounted(docs, shards, cells) if size <= most_bytes else _joined(docs, shards)
    return found.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)), exactly, for counts up to 10 ** 18."""
    above = (n + ADDED).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    below = (total + ADDED * terms).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def _distances(parts: DataFrame) -> DataFrame:
    """lang, a, b, more: for pairs a < b of a tile's rows (lang, slots, lo, hi, block, source, slot, p, base), the sum over slots of |pa - pb| less that of their bases.

    Each group of the language has a row without a slot in each tile that it belongs to.
    """

    def work(table: pa.Table) -> pa.Table:
        names = table["source"].combine_chunks().dictionary_encode()
        who, counted = names.indices.to_numpy(), table["slot"].is_valid().to_numpy()
        slots = table["slot"].drop_null().combine_chunks().dictionary_encode()
        base, block = np.zeros(len(names.dictionary), "i8"), np.zeros(len(names.dictionary), "i8")
        base[who], block[who] = table["base"].to_numpy(), table["block"].to_numpy()
        p = np.repeat(base[:, None], len(slots.dictionary), axis=1)
        p[who[counted], slots.indices.to_numpy()] = table["p"].drop_null().to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right, more = [], [], []
        for a in range(len(base)):
            others = np.flatnonzero((block == hi) if lo < hi else np.arange(len(base)) > a) if block[a] == lo else np.zeros(0, "i8")
            if len(others):
                left.append(np.full(len(others), a))
                right.append(others)
                more.append(np.abs(p[others] - p[a]).sum(axis=1) - p.shape[1] * np.abs(base[others] - base[a]))
        flat = [np.concatenate(x) if x else np.zeros(0, "i8") for x in (left, right, more)]
        lang = pa.array([table["lang"][0].as_py()] * len(flat[0]), pa.string())
        return pa.table({"lang": lang, "a": names.dictionary.take(pa.array(flat[0])), "b": names.dictionary.take(pa.array(flat[1])), "more": pa.array(flat[2])})

    found = parts.groupBy("lang", "slots", "lo", "hi").applyInArrow(work, "lang string, a string, b string, more long")
    return found.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = 50, most_bytes: int = MOST_BYTES, cells: int = CELLS, shard: int = SHARD, sources: int = SOURCES, slots: int = SLOTS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to each other source of its language (`pair`), and its `top` terms beyond the language's share (`term`)."""
    kept = written(document_counts(docs, lang_col, text_col).where(F.col("n") >= least).select("lang", "term"), "kept-terms")
    shards = build_shards(kept, shard)
    counts = written(recount(docs, shards, lang_col, source_col, text_col, most_bytes, cells), "term-counts")
    vocabulary = written(shards.groupBy("lang").agg(F.sum("size").alias("v")), "vocabulary")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    present = _seen(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    dealt = present.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v"])
    dealt = dealt.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(0)))
    groups = written(dealt, "groups")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    blocks = F.ceil(F.col("s") / sources)
    groups = written(groups.join(sizes, "lang").withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), blocks).cast("int")), "groups")

    own = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("__other")
    tile = [F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi")]
    every = groups.where("v > 0").withColumn("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / slots)))).withColumns({"slot": F.lit(None).cast("long"), "p": F.lit(None).cast("long")})
    rows = own.withColumn("slots", F.floor(F.col("slot") / slots)).drop("n").unionByName(every.select("lang", "source", *[c for c in own.columns if c not in ("lang", "source", "slot", "n", "p")], "slots", "slot", "p"))
    parts = rows.select("*", meets).select("lang", "slots", *tile, "block", "source", "slot", "p", "base")
    more = _distances(parts).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    more = written(more, "distances")
    both = more.unionByName(more.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    side = groups.select("lang", "v", "blocks", "block", "source", "base")
    left = side.select("lang", "v", F.col("block").alias("x"), F.col("source").alias("a"), F.col("base").alias("pa"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    right = side.select("lang", F.col("block").alias("y"), F.col("source").alias("b"), F.col("base").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    pairs = left.join(right, ["lang", "x", "y"]).where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), (F.col("v") * F.abs(F.col("pa") - F.col("pb")) + F.coalesce("more", F.lit(0))).alias("value"))

    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    language = written(totals.groupBy("lang").agg(F.sum("total").alias("total")).join(vocabulary, "lang"), "languages")
    if language.count() <= MOST_LANGS:
        language = F.broadcast(language)
    common = whole.join(language, "lang").select("lang", "slot", share(F.col("n"), F.col("total"), F.col("v")).alias("q")).join(slot_terms(shards), ["lang", "slot"])
    terms = own.join(common, ["lang", "slot"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    first = terms.select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(first)
