"""Maximal repeats of a collection, and matches by context classes.

A maximal repeat is a string that occurs twice or more and that no character extends in all places, to neither side. All its places begin with one string of k characters, and these
have unlike characters before them, so only such places take part: the inside of a copy has none. `maybe_unlike` finds them from hashes that pieces of the texts send in order and packed. `branches` tells their groups apart by what follows, in rounds of three times the length so far.

What repeats itself so much that this reads too often goes by the suffix order of all places whose first k characters occur elsewhere, as the matches by classes do. They are put in suffix order by doubling: two places that are alike for h characters are told apart by
the order of what follows h further on, and where that place takes no part, its next characters occur nowhere else and are
compared as they are. How long neighbours in the order are alike follows from the same rounds, the longest first. A repeat is an interval of
the order that no longer common prefix splits: its ends are the nearest smaller values on both sides, found within blocks of the order and, where they
lie further, by halving over minima of blocks, on joins. An interval whose characters before the places are all alike is left out.

Ranks come from ranges and their totals, and equal keys may lie in many ranges, so a string that a third of all places start with
is no hot key. Each round is a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramweave.functions.strings import common_prefix
from gramweave.operators import grams
from gramweave.operators.locate import GAP, PAIRS, codes, rolling, smaller
from gramweave.sources.packing import packed, unpacked
from gramweave.sources.tables import bucketed, buckets, release, remove, scratch, shared_path, written, written_to
from gramweave.sources.texts import BLOCK, carried, kmers

#: Places of the order that are searched together for nearest smaller values.
TOGETHER = 1024
#: Unlike strings of a group that one task puts in order, how many characters a larger one is told apart by, and how often a text's length may be read.
MANY, NARROW, BUDGET = 200_000, 2, 64
#: Characters of a piece, and slots in use of a range; bits of a slot below those of its range, at most how many of a range, and those of the character before.
PIECE, RANGE, LOW, MOST_TOP, BESIDE = 4 << 20, 4 << 20, 29, 14, 21
MASK = np.uint64((1 << BESIDE) - 1)


def ranked(rows: DataFrame, keys: list[str], ties: list[str], name: str) -> DataFrame:
    """Adds how many rows have smaller keys (name), and how many come before by keys and ties (name_at); rows with one key may lie in many ranges."""
    dealt = written(rows.repartitionByRange(*keys, *ties).withColumn("__part", F.spark_partition_id()), "ranges")
    by = Window.partitionBy("__part")
    dealt = dealt.withColumn("__n", F.row_number().over(by.orderBy(*keys, *ties))).withColumn("__same", F.rank().over(by.orderBy(*keys)))
    key = F.struct(*keys)
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("c"), F.max("__same").alias("m"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    order = Window.orderBy("__part")  # a row for each range
    totals = totals.withColumn("s", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("goes_on", F.coalesce(F.lag("hi").over(order) == F.col("lo"), F.lit(False)))
    own = F.when((F.col("m") > 1) | ~F.col("goes_on"), F.col("s") + F.col("m") - 1)  # where the last key of the range begins; null if in an earlier one
    totals = totals.withColumn("begin", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = totals.withColumn("before", F.lag("begin").over(order)).select("__part", "s", "before", "goes_on")
    out = dealt.join(F.broadcast(totals), "__part")
    rank = F.when((F.col("__same") == 1) & F.col("goes_on"), F.col("before")).otherwise(F.col("s") + F.col("__same") - 1)
    return out.withColumns({name: rank.cast("long"), f"{name}_at": (F.col("s") + F.col("__n") - 1).cast("long")}).drop("__part", "__n", "__same", "s", "before", "goes_on")


def following(rows: DataFrame, blocks: DataFrame, at: Column, k: int, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the k characters (fewer at an end) of the row's text (doc_id) from `at` on. blocks: from blocks_of()."""
    placed = rows.withColumn("__at", at.cast("long")).withColumn("__b", F.floor(F.col("__at") / block))
    met = placed.join(blocks, (placed["doc_id"] == blocks["__doc"]) & (placed["__b"] == blocks["__no"]), "left")
    cut = F.substring(F.col("__chunk"), (F.col("__at") % block + 1).cast("int"), F.lit(k))
    return met.withColumn(name, F.coalesce(cut, F.lit(""))).drop("__at", "__b", "__doc", "__no", "__chunk")


def blocks_of(texts: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """__doc, __no, __chunk: texts in blocks, each with k characters of the next."""
    cut = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{1,{block + k}}})).{{1,{block}}}"), F.lit(1))
    return texts.select(F.col("doc_id").alias("__doc"), F.posexplode(cut).alias("__no", "__chunk"))


def levels_of(texts: DataFrame, k: int, held: DataFrame, blocks: DataFrame, asked: Column | None = None) -> list[tuple[int, DataFrame]]:
    """h and doc_id, pos, size, r, r_at for h = k, 2 k, 4 k ...: the ranks by h characters of the places `held` (doc_id, pos, gram: the next k characters), all places of each gram.

    In the last, equal ranks are those of texts that have ended. Written tables. blocks: of all texts with such places.
    asked: which places are a query's; then only what a text and a query share is told apart further, and levels end with the longest of these.
    """
    sized = texts.select("doc_id", F.length("text").cast("long").alias("size"))
    first = written(held.join(sized, "doc_id"), "repeat-places")
    kept = ["doc_id", "pos", "size", "gram", "r", "r_at"]
    now = written(ranked(first, ["gram"], ["doc_id", "pos"], "r").select(*kept), "repeat-ranks")
    out, h = [(k, now)], k
    while True:
        left = F.col("size") - F.col("pos")
        if asked is None:
            alike = now.groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.max(left).alias("left"))
        else:
            alike = now.groupBy("r").agg(F.least(F.count_if(asked), F.count_if(~asked)).alias("c"), F.max(F.when(asked, left)).alias("left")).withColumn("c", F.col("c") + 1)
        open_ = written(alike.where((F.col("c") > 1) & (F.col("left") > h)).select("r"), "repeat-open")
        if open_.isEmpty():
            return out
        # Only what is still alike is put in order; all others have their rank.
        after = now.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("gram").alias("next_gram"), F.col("r").alias("next"))
        tied = written(now.join(open_, "r", "left_semi").withColumnRenamed("r", "q").drop("r_at").join(after, ["doc_id", "pos"], "left"), "repeat-tied")
        alone = following(tied.where("next is null").drop("next_gram"), blocks, F.col("pos") + h, k, "next_gram").withColumn("next", F.lit(-1).cast("long"))
        pairs = written(tied.where("next is not null").unionByName(alone), "repeat-tied")
        new = written(ranked(pairs, ["q", "next_gram", "next"], ["doc_id", "pos"], "t"), "repeat-tied")
        base = new.groupBy("q").agg(F.min("t").alias("base"))
        new = new.join(base, "q").withColumns({"r": F.col("q") + F.col("t") - F.col("base"), "r_at": F.col("q") + F.col("t_at") - F.col("base")})
        now = written(now.join(open_, "r", "left_anti").select(*kept).unionByName(new.select(*kept)), "repeat-ranks")
        h *= 2
        out.append((h, now))


def shared_lengths(pairs: DataFrame, levels: list[tuple[int, DataFrame]], blocks: DataFrame, k: int) -> DataFrame:
    """Adds l to pairs of places (doc_id, pos, own_left; other, b, other_left; left: characters to the end): how many characters they share.

    From the longest strings that ranks tell apart to the shortest, and then by their characters: a few joins, however long they are alike.
    """
    now = pairs.withColumns({"__a": F.col("pos"), "__c": F.col("b"), "l": F.lit(0).cast("long")})
    for h, ranks in reversed(levels):
        own = ranks.select("doc_id", F.col("pos").alias("__a"), F.col("r").alias("__ra"))
        its = ranks.select(F.col("doc_id").alias("other"), F.col("pos").alias("__c"), F.col("r").alias("__rb"))
        step = F.when(F.col("__ra") == F.col("__rb"), F.lit(h)).otherwise(0)
        now = now.join(own, ["doc_id", "__a"], "left").join(its, ["other", "__c"], "left").withColumn("__s", step)
        now = now.withColumns({"__a": F.col("__a") + F.col("__s"), "__c": F.col("__c") + F.col("__s"), "l": F.col("l") + F.col("__s")}).drop("__s", "__ra", "__rb")
        now = written(now, "repeat-prefixes")
    ends = following(now, blocks, F.col("__a"), k, "__x")
    ends = following(ends.withColumnsRenamed({"doc_id": "__own", "other": "doc_id"}), blocks, F.col("__c"), k, "__y").withColumnsRenamed({"doc_id": "other", "__own": "doc_id"})
    most = F.least("own_left", "other_left")  # ranks also are equal where both texts have ended
    shared = F.when(F.col("other").isNull(), F.lit(0)).otherwise(F.least(F.col("l") + common_prefix(F.col("__x"), F.col("__y")), most))
    return ends.withColumn("l", shared.cast("long")).drop("__a", "__c", "__x", "__y")


def order_of_repeats(texts: DataFrame, k: int) -> DataFrame:
    """n, doc_id, pos, before, l: the places whose next k characters occur twice, in suffix order; l: how many characters a place shares with the one before it in order (0 if less than k)."""
    hashed = kmers(texts, "doc_id", "text", k).select(F.xxhash64("gram").alias("h"))
    again = written(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "repeated")
    placed = kmers(texts, "doc_id", "text", k).withColumn("h", F.xxhash64("gram"))
    held = placed.join(smaller(again, F.lit(16)), "h", "left_semi").select("doc_id", "pos", "gram")
    blocks = written(blocks_of(texts, k), "repeat-blocks")
    levels = levels_of(texts, k, held, blocks)
    order = levels[-1][1]
    left = F.col("size") - F.col("pos")
    last = order.select((F.col("r_at") + 1).alias("n"), F.col("doc_id").alias("other"), F.col("pos").alias("b"), left.alias("other_left"))
    pairs = order.withColumnRenamed("r_at", "n").join(last, "n", "left").select("n", "doc_id", "pos", left.alias("own_left"), "other", "b", "other_left")
    found = shared_lengths(pairs, levels, blocks, k).select("n", "doc_id", "pos", F.when(F.col("l") >= k, F.col("l")).otherwise(0).alias("l"))
    found = following(found, blocks, F.greatest(F.col("pos") - 1, F.lit(0)), 1, "before")
    return written(found.withColumn("before", F.when(F.col("pos") > 0, F.col("before"))), "repeat-order")


def nearest_smaller(values: DataFrame, together: int = TOGETHER) -> DataFrame:
    """n, l, lo, hi of rows (n: 0, 1, 2 ..., l) with l > 0: the nearest places before and after with a smaller l, -1 and the number of rows if there is none."""
    dealt = values.select("n", "l", F.floor(F.col("n") / together).alias("b"))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        n, l = table["n"].to_pylist(), table["l"].to_pylist()
        lo, hi, stack = [None] * len(n), [None] * len(n), []
        for j, v in enumerate(l):
            while stack and l[stack[-1]] > v:
                hi[stack.pop()] = n[j]
            k = len(stack)
            while k and l[stack[k - 1]] == v:
                k -= 1
            lo[j] = n[stack[k - 1]] if k else None
            stack.append(j)
        return pa.table({"n": table["n"], "l": table["l"], "b": table["b"], "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    inside = written(dealt.groupBy("b").applyInArrow(work, "n long, l long, b long, lo long, hi long"), "smaller-inside")
    minima = written(inside.groupBy("b").agg(F.min("l").alias("m")), "smaller-minima")
    last = minima.agg(F.max("b")).first()[0]
    total = inside.agg(F.count(F.lit(1))).first()[0]
    rows = inside.where("l > 0")
    if last:
        for side, sign in (("lo", -1), ("hi", 1)):
            tables, width = [minima.select("b", "m")], 1  # of 1, 2, 4 ... blocks from b on in the direction of the search
            while 2 * width <= last + 1:
                beside = tables[-1].select((F.col("b") - sign * width).alias("b"), F.col("m").alias("o"))
                tables.append(written(tables[-1].join(beside, "b", "left").select("b", F.least("m", F.coalesce("o", F.lit(-1))).alias("m")), "smaller-minima"))
                width *= 2
            away = written(rows.where(F.col(side).isNull()).select("n", "l", (F.col("b") + sign).alias("at")), "smaller-away")
            for table in reversed(tables):
                step = 2 ** tables.index(table)
                met = away.join(table.select(F.col("b").alias("at"), "m"), "at", "left")
                away = met.select("n", "l", F.when(F.col("m") >= F.col("l"), F.col("at") + sign * step).otherwise(F.col("at")).alias("at"))
            own = inside.select(F.col("b").alias("at"), F.col("n").alias("o"), F.col("l").alias("ol"))
            best = (F.max if sign < 0 else F.min)("o").alias("found")
            found = written(away.join(own, "at").where("ol < l").groupBy("n").agg(best), "smaller-found")
            rows = rows.join(found, "n", "left").withColumn(side, F.coalesce(side, "found")).drop("found")
    return rows.select("n", "l", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(total)).alias("hi"))


def maximal_repeats(texts: DataFrame, k: int) -> DataFrame:
    """text, d, n_occ: strings of k characters or more that occur n_occ times, twice at least, in texts (doc_id, text), and that no character before or after them extends in all places.

    An end of a text extends nothing. Null texts have no places; doc_ids are distinct.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    texts = texts.where("text is not null").select("doc_id", "text")
    found = branches(texts, k)
    return repeats_by_order(texts, k) if found is None else found.join(texts, "doc_id").select(F.substring("text", F.col("pos").cast("int") + 1, F.col("d").cast("int")).alias("text"), "d", "n_occ")


def in_pieces(texts: DataFrame, k: int, total: int, piece: int) -> DataFrame:
    """piece, doc_id, at, text: texts of k characters or more, dealt to pieces of about `piece` characters (`total` is their sum). A longer text is cut: `at` is its part's first place, and a part also has the character before and k - 1 after."""
    n, begin = F.length("text"), F.greatest(F.col("at") - 1, F.lit(0))
    cut = texts.where(n >= k).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - k, F.lit(piece))).alias("at"))
    part = F.substring("text", begin + 1, F.col("at") - begin + piece + k - 1)
    return cut.select(F.pmod(F.xxhash64("doc_id", "at"), F.lit(max(1, -(-total // piece)))).alias("piece"), "doc_id", F.col("at").cast("long").alias("at"), part.alias("text"))


class Piece:
    """The grams of k characters of the texts of a piece: keys (slot of the gram's hash, then the character before it) and the places that have them. Texts come in one order each time."""

    def __init__(self, rows: pa.Table, k: int, bits: int):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("at", "ascending"), ("text", "ascending")])
        held, size = [np.array([GAP], "<u4")], [0]
        for text in self.rows["text"]:
            held += [codes(text.as_py()), np.array([GAP], "<u4")]
            size.append(len(held[-2]) + 1)
        self.whole = np.concatenate(held)
        self.starts = np.cumsum(size)[:-1] + 1  # of each text
        base = self.rows["at"].to_numpy()
        lead = (base > 0).astype("i8")  # a part's first character is only the one before
        n = np.array(size[1:]) - 1 - lead - k + 1
        self.part = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.places = (self.starts + lead)[self.part] + inside
        self.x = base[self.part] + inside
        slot = (rolling(self.whole, [k])[k][self.places] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
        self.keys = slot << np.uint64(BESIDE) | self.whole[self.places - 1]

    def distinct(self) -> np.ndarray:
        """The keys in order, once each; that of a gram with which several texts begin has one more beside it."""
        keys = np.sort(self.keys)
        again = np.append(False, keys[1:] == keys[:-1]) & ((keys & MASK) == GAP)
        keys[again] += np.uint64(1)
        return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def unlike_keys(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Of lists of keys, which places in each have a slot with unlike characters before it; beginnings of texts are like none."""
    keys = np.sort(np.concatenate(lists))
    slot, before = keys >> np.uint64(BESIDE), keys & MASK
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
    last = np.append(first[1:], len(slot)) - 1
    found = slot[first][(first < last) & ((before[first] != before[last]) | (before[last] >= GAP))]
    if not len(found):
        return [np.zeros(0, "i8")] * len(lists)
    own = [x >> np.uint64(BESIDE) for x in lists]
    return [np.flatnonzero(found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x) for x in own]


def maybe_unlike(texts: DataFrame, k: int, piece: int = PIECE, each: int = RANGE) -> DataFrame:
    """doc_id, pos, gram, before: all places whose next k characters occur elsewhere after another character, and few others.

    Pieces of the texts send the slots of their grams' hashes and the characters before them, each once, in order and packed by differences, to ranges of about `each` slots
    in use. A range answers with the numbers of those it wants, and the piece, which sorts its grams again, gives the places. So a gram costs two or three bytes of a shuffle.
    """
    spark = texts.sparkSession
    total = texts.where(F.length("text") >= k).agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    top = min(MOST_TOP, max(0, (-(-total // each) - 1).bit_length()))
    bits, n = top + LOW, buckets(spark)
    pieces = bucketed(in_pieces(texts, k, total, piece), shared_path(spark, "repeat-pieces"), ["piece"], n)
    release(spark)
    low = np.uint64((1 << (LOW + BESIDE)) - 1)

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        keys = Piece(rows, k, bits).distinct()
        edges = np.searchsorted(keys, np.arange(1 << top, dtype="u8") << np.uint64(LOW + BESIDE)).tolist() + [len(keys)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            own = keys[a:b] & low
            out.append((packed(np.diff(own >> np.uint64(BESIDE), prepend=np.uint64(0))), packed(own & MASK)))
        table = pa.table({"range": pa.array(np.arange(1 << top), pa.int32()), "piece": pa.array([key[0].as_py()] * len(out), pa.int64()), "slots": pa.array([x for x, _ in out], pa.binary()), "befores": pa.array([x for _, x in out], pa.binary())})
        return table.filter(pa.array(np.diff(edges) > 0))

    def answer(table: pa.Table) -> pa.Table:
        lists = []
        for slots, befores in zip(*(table[c].to_pylist() for c in ("slots", "befores")), strict=True):
            lists.append(np.cumsum(unpacked(slots), dtype="u8") << np.uint64(BESIDE) | unpacked(befores))
        found = unlike_keys(lists)
        answers = pa.table({"piece": table["piece"], "range": table["range"], "wanted": pa.array([packed(np.diff(x, prepend=0)) for x in found], pa.binary())})
        return answers.filter(pa.array([len(x) > 0 for x in found]))

    def give(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"doc_id": rows["doc_id"].slice(0, 0), "pos": pa.array([], pa.int64()), "gram": pa.array([], pa.string()), "before": pa.array([], pa.string())})
        if not rows.num_rows or not asked.num_rows:
            return empty
        own = Piece(rows, k, bits)
        keys, wanted = own.distinct(), []
        for r, raw in zip(*(asked[c].to_pylist() for c in ("range", "wanted")), strict=True):
            wanted.append(np.searchsorted(keys, np.uint64(r) << np.uint64(LOW + BESIDE)) + np.cumsum(unpacked(raw), dtype="i8"))
        slots = np.unique(keys[np.concatenate(wanted)] >> np.uint64(BESIDE))
        slot = own.keys >> np.uint64(BESIDE)
        at = np.flatnonzero(slots[np.minimum(np.searchsorted(slots, slot), len(slots) - 1)] == slot)
        out = [empty]
        for j in range(0, len(at), PAIRS // k + 1):
            some = at[j : j + PAIRS // k + 1]
            seen = own.whole[own.places[some][:, None] + np.arange(k)].tobytes().decode("utf-32-le", "surrogatepass")
            before = [chr(c) if c < GAP else None for c in own.whole[own.places[some] - 1].tolist()]
            columns = [own.rows["doc_id"].take(pa.array(own.part[some])), pa.array(own.x[some]), pa.array([seen[i : i + k] for i in range(0, len(seen), k)], pa.string()), pa.array(before, pa.string())]
            out.append(pa.table(columns, names=empty.column_names))
        return pa.concat_tables(out)

    sent = pieces.groupBy("piece").applyInArrow(send, "range int, piece long, slots binary, befores binary")
    answers = sent.groupBy("range").applyInArrow(answer, "piece long, range int, wanted binary")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("piece").cogroup(written(answers, "repeat-answers").groupBy("piece")).applyInArrow(give, f"doc_id {kind}, pos long, gram string, before string")


def unlike_places(texts: DataFrame, k: int) -> DataFrame:
    """g, h, doc_id, pos, before: the places whose next k characters (h = k) occur elsewhere after another character, or at a text's beginning; g numbers these strings."""
    held = written(maybe_unlike(texts, k), "repeat-places")
    release(texts.sparkSession)
    seen = [F.count(F.lit(1)).alias("c"), F.count("before").alias("n"), F.min("before").alias("lo"), F.max("before").alias("hi")]
    strings = written(held.groupBy("gram").agg(*seen).where("c > 1 and (lo <> hi or c > n)").select("gram", F.monotonically_increasing_id().alias("g")), "repeat-strings")
    return held.join(strings, "gram").select("g", F.lit(k).cast("long").alias("h"), "doc_id", "pos", "before")


def shared_before(a: str, b: str) -> int:
    """How many characters a and b share at their beginnings."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    step = 8
    while a[lo : lo + step] == b[lo : lo + step]:
        lo, step = lo + step, 2 * step
    hi = min(hi, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _branching(batches):
    """For rows g, h, w, s, before, n, doc_id, pos in the order of g and s: a row for each string that a g's rows share and that both sides part; with s where it has all w characters."""
    out, stack, now, last = [], [], None, ""  # of the stack: length, places, the character before them all or None, a place

    def close(node):
        if node[1] > 1 and node[2] is None:
            g, h, w = now
            out.append((g, h + node[0], node[3] if node[0] == w else None, node[1], *node[4]))

    def merged(into, node):
        into[1] += node[1]
        into[2] = into[2] if into[2] == node[2] else None

    def down(to):
        while stack[-1][0] > to:
            node = stack.pop()
            close(node)
            if stack and stack[-1][0] >= to:
                merged(stack[-1], node)
            else:
                stack.append([to, node[1], node[2], None, node[4]])

    def ended():
        if stack:
            down(min(x[0] for x in stack))
            close(stack.pop())

    def taken():
        nonlocal out
        g, d, s, n, doc, pos = zip(*out, strict=True) if out else ((),) * 6
        out = []
        return pa.record_batch([pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string()), pa.array(n, pa.int64()), pa.array(doc, kind), pa.array(pos, pa.int64())], names=["g", "d", "s", "n_occ", "doc_id", "pos"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for at in range(0, batch.num_rows, 1024):
            for g, h, w, s, before, n, doc, pos in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                if (g, h, w) != now:
                    ended()
                    now, last = (g, h, w), None
                leaf = [len(s), n, before, s, (doc, pos)]
                if last is None:
                    stack.append(leaf)
                else:
                    down(shared_before(last, s))
                    if len(s) > stack[-1][0]:
                        stack.append(leaf)
                    else:
                        merged(stack[-1], leaf)
                last = s
            if len(out) > 4096:
                yield taken()
    ended()
    if out:
        yield taken()


def branches(texts: DataFrame, k: int, many: int = MANY, budget: int = BUDGET) -> DataFrame | None:
    """doc_id, pos, d, n_occ: a place of each maximal repeat, its length and number of places; None if texts repeat themselves so that this reads more than `budget` times their characters.

    Places alike for h characters are one group. Each round reads what follows, three times h, and puts equal strings together before a task sees them in order: where
    they part, a repeat ends, and what still is alike is a group of the next round if unlike characters come before it. All others are only counted, so the
    inside of a copy costs nothing. A group of over `many` unlike strings is told apart by NARROW characters first, so no task gets more than alphabets allow.
    """
    spark, out, step = texts.sparkSession, None, 3 * k
    path = shared_path(spark, "repeat-groups")
    with scratch(spark):
        now = written_to(unlike_places(texts, k), path)
    release(spark)
    most = budget * (texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] + (1 << 20))
    kind, read = texts.schema["doc_id"].dataType.simpleString(), 0
    while True:
        n = now.count()
        read += n * step
        if read > most:
            return None
        block, after, ended = max(BLOCK, step), shared_path(spark, "repeat-groups"), shared_path(spark, "repeat-found")
        with scratch(spark):  # what a round writes and shuffles goes with it, but for what is found and the next groups
            met = written(following(now, blocks_of(texts.join(now.select("doc_id").distinct(), "doc_id", "left_semi"), step, block), F.col("pos") + F.col("h"), step, "s", block), "repeat-tails")
            release(spark)
            rows = written(_counted(met), "repeat-strings")
            wide = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > many).select("g", F.lit(True).alias("wide")), "repeat-wide")
            if hot := not wide.isEmpty():
                met = written(met.join(F.broadcast(wide) if wide.count() <= 10_000 else wide, "g", "left").withColumn("s", F.when(F.col("wide"), F.substring("s", 1, NARROW)).otherwise(F.col("s"))), "repeat-tails")
                rows = _counted(met, "wide")
            width = F.when(F.col("wide"), NARROW).otherwise(step) if hot else F.lit(step)
            dealt = rows.select("g", "h", width.alias("w"), "s", "before", "n", "one.doc_id", "one.pos").repartition("g").sortWithinPartitions("g", "h", "s")
            found = written(dealt.mapInArrow(_branching, f"g long, d long, s string, n_occ long, doc_id {kind}, pos long"), "repeat-found")
            release(spark)
            ends = written_to(found.where("s is null").select("doc_id", "pos", "d", "n_occ"), ended)
            goes_on = written(found.where("s is not null").select("g", "s", F.col("d").alias("h"), F.monotonically_increasing_id().alias("next")), "repeat-open")
            if more := not goes_on.isEmpty():
                now = written_to(met.drop("h").join(goes_on, ["g", "s"]).select(F.col("next").alias("g"), "h", "doc_id", "pos", "before"), after)
        out = ends if out is None else out.unionByName(ends)
        remove(spark, path)
        del met, rows, wide, dealt, found, goes_on
        release(spark)
        if not more:
            return out
        path = after
        step *= 4


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    """g, h, s, before, n, one: how many places of a group have what follows and comes before them in common, and one of them."""
    return rows.groupBy("g", "h", "s", "before", *more).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("one"))


def repeats_by_order(texts: DataFrame, k: int) -> DataFrame:
    """As maximal_repeats(), from the suffix order of all places that occur twice: more rounds, whose work doesn't grow with the length of what texts repeat."""
    order = order_of_repeats(texts, k)
    # A place has changed if the character before it isn't that of the place before it in order.
    own = order.select("n", "before")
    last = own.select((F.col("n") + 1).alias("n"), F.col("before").alias("last"))
    marked = own.join(last, "n", "left").withColumn("mark", F.when(F.coalesce(F.col("before") != F.col("last"), F.lit(True)), F.col("n")))
    turned = carried(marked.select("n", "mark").withColumn("all", F.lit(0)), ["all"], ["n"], F.col("mark"), F.max, "earlier")
    turned = turned.select("n", F.greatest("mark", "earlier").alias("turn"))
    spans = nearest_smaller(order.select("n", "l")).select(F.col("lo"), F.col("hi"), "l").distinct()
    # lo is the place where the interval begins: its own l is smaller, those after it aren't
    ends = turned.select((F.col("n") + 1).alias("hi"), "turn")
    kept = spans.join(ends, "hi").where(F.col("turn") > F.col("lo"))
    place = order.select(F.col("n").alias("lo"), "doc_id", "pos")
    found = kept.join(place, "lo").join(texts, "doc_id")
    return found.select(F.substring("text", F.col("pos").cast("int") + 1, F.col("l").cast("int")).alias("text"), F.col("l").alias("d"), (F.col("hi") - F.col("lo")).alias("n_occ"))


def met_places(texts: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, x, gram, tb and query_id, i, gram, qb: the places whose next k characters both sides have, and the characters before them. Written tables.

    Queries of a bounded size are held by each task, and only places that they know leave it.
    """

    def places(rows: DataFrame, id_col: str, at: str, before: str) -> DataFrame:
        # a character more, so each gram knows the one before it
        found = kmers(rows.withColumn("text", F.concat(F.lit(" "), "text")), id_col, "text", k + 1)
        return found.select(id_col, F.col("pos").alias(at), F.expr(f"substring(gram, 2, {k})").alias("gram"), F.when(F.col("pos") > 0, F.substring("gram", 1, 1)).otherwise("").alias(before))

    q = places(queries, "query_id", "i", "qb")
    if grams.small(queries, 24):
        t = written(grams.known(texts, queries, k).withColumnRenamed("before", "tb"), "class-places")
    else:
        known = written(q.select("gram").distinct(), "asked-grams")
        t = written(places(texts, "doc_id", "x", "tb").join(smaller(known, F.length("gram") * 4 + 16), "gram", "left_semi"), "class-places")
    return t, written(q.join(smaller(written(t.select("gram").distinct(), "met-grams"), F.length("gram") * 4 + 16), "gram", "left_semi"), "class-places")


def class_pairs(texts: DataFrame, queries: DataFrame, k: int, met: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc_id, x, query_id, i: places with equal next k characters and unlike ones before (an end is like none). Each is where one match starts, and no other pair is made.

    The places of a string fall into classes by the character before them. Classes are paired first, a row for each, and only pairs of unlike
    classes are given their places. met: from met_places(), if it is at hand.
    """
    t, q = met or met_places(texts, queries, k)
    classes = t.select("gram", "tb").distinct().join(q.select("gram", "qb").distinct(), "gram").where((F.col("tb") != F.col("qb")) | (F.col("tb") == ""))
    return written(classes, "classes").join(t, ["gram", "tb"]).join(q, ["gram", "qb"]).select("doc_id", "x", "query_id", "i")


def mems_by_context(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """doc_id, query_id, x, i, d: as mem.mems() with open boundaries, for texts and queries that repeat themselves: work follows the matches, and not the product of a string's places.

    Lengths come from the joint order of both sides: a few joins for each match, however long it is.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    texts, queries = (rows.where("text is not null").select(id_col, "text") for rows, id_col in ((texts, "doc_id"), (queries, "query_id")))
    t, q = met_places(texts, queries, k)
    pairs = written(class_pairs(texts, queries, k, (t, q)), "class-pairs")
    # Only texts with such a place take part in what follows.
    texts = written(texts.join(t.select("doc_id").distinct(), "doc_id", "left_semi"), "class-texts")
    of = lambda side, id_col: F.concat(F.lit(side), F.col(id_col).cast("string"))
    joint = texts.select(of("t", "doc_id").alias("doc_id"), "text").unionByName(queries.select(of("q", "query_id").alias("doc_id"), "text"))
    held = t.select(of("t", "doc_id").alias("doc_id"), F.col("x").alias("pos"), "gram").unionByName(q.select(of("q", "query_id").alias("doc_id"), F.col("i").alias("pos"), "gram"))
    blocks = written(blocks_of(joint, k), "repeat-blocks")
    levels = levels_of(joint, k, held, blocks, F.col("doc_id").startswith("q"))
    sizes = [rows.select(id_col, F.length("text").cast("long").alias(name)) for rows, id_col, name in ((texts, "doc_id", "tn"), (queries, "query_id", "qn"))]
    sized = pairs.join(sizes[0], "doc_id").join(sizes[1], "query_id")
    keyed = sized.select(F.col("doc_id").alias("__doc_id"), "query_id", "x", "i", of("t", "doc_id").alias("doc_id"), F.col("x").alias("pos"), (F.col("tn") - F.col("x")).alias("own_left"), of("q", "query_id").alias("other"), F.col("i").alias("b"), (F.col("qn") - F.col("i")).alias("other_left"))
    return shared_lengths(keyed, levels, blocks, k).select(F.col("__doc_id").alias("doc_id"), "query_id", "x", "i", F.col("l").alias("d"))
