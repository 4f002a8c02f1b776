"""Counting and locating patterns: exact, with mismatches, and with an exact core.

A pattern with at most e mismatches is cut into e + 1 pieces, of which one is exact. Pieces are looked up by their first w
characters, w being the largest of WIDTHS that fits the pattern's own pieces, so a short pattern makes no more candidates for long ones.
Patterns of a bounded size go to every executor, and texts are scanned in Arrow batches: w-grams of each width by a hash that builds on
that of half the width, candidates held against the pattern at once, nothing shuffled. More patterns are joined with the texts' w-grams on
equality, a join for each width, and distinct candidates meet their text once more. Occurrences may overlap. Positions are 0-based
and never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions.strings import char_at, mismatches
from gramweave.operators.index import GramIndex
from gramweave.sources.tables import written
from gramweave.sources.texts import kmers

#: Bytes of seeds and patterns up to which they are sent to every executor, so that the texts' grams aren't shuffled.
SMALL = 16 << 20
#: Characters that are scanned together, and candidates that are verified together.
TOGETHER, PAIRS = 1 << 20, 1 << 18
#: Stands between texts; no character has this code.
GAP = 0x110000
#: Characters of a seed: few widths, as each is a pass over the texts.
WIDTHS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def width_of(longest: int) -> int:
    """The largest width of up to `longest` characters."""
    return max(w for w in WIDTHS if w <= max(1, longest))


def rolling(text: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """For each width a hash of each gram of it: of grams twice as wide from two hashes, of other widths from two that overlap."""
    mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))) + b
    out, half, found = {}, 1, text.astype("u8")
    for w in sorted(widths):
        while 2 * half <= w:
            n = max(0, len(found) - half)
            found, half = mix(found[:n], found[half : half + n]), 2 * half
        n = max(0, len(text) - w + 1)
        out[w] = found[:n] if w == half else mix(found[:n], found[w - half : w - half + n])
    return out


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A place for each hash in a table of 2 ** bits."""
    return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


class Scanner:
    """Holds patterns (codes) and their seeds (place in the patterns, place in the pattern, width), and finds them in texts."""

    def __init__(self, patterns: list[np.ndarray], seeds: list[tuple[int, int, int]], most: int, core: tuple[int, int] | None):
        self.most, self.core = most, core
        self.sizes = np.array([len(p) for p in patterns], dtype="i8")
        self.row = np.zeros(len(patterns), "i8")  # of a pattern in the table of its length
        # The lowest bytes of a pattern's first sixteen characters as two words, and which of these it has.
        self.words, self.masks = np.zeros((2, len(patterns)), "<u8"), np.zeros((2, len(patterns)), "<u8")
        for i, p in enumerate(patterns):
            self.words[:, i] = np.frombuffer(p[:16].astype("u1").tobytes().ljust(16, b"\0"), "<u8")
            self.masks[:, i] = np.frombuffer((b"\xff" * min(16, len(p))).ljust(16, b"\0"), "<u8")
        self.tables = {}
        for size in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == size)
            self.row[own] = np.arange(len(own))
            self.tables[size] = np.stack([patterns[i] for i in own])
        self.seeds = {}
        every = np.array(seeds, dtype="i8").reshape(-1, 3)
        for w in np.unique(every[:, 2]).tolist():
            which, at = every[every[:, 2] == w, :2].T
            found = np.array([rolling(patterns[i][a : a + w], [w])[w][0] for i, a in zip(which, at, strict=True)], dtype="u8")
            order = np.argsort(found, kind="stable")
            keys, first, n = np.unique(found[order], return_index=True, return_counts=True)
            bits = min(22, max(10, int(16 * len(keys)).bit_length()))
            mask = np.zeros(1 << bits, bool)
            mask[slots(keys, bits)] = True
            self.seeds[w] = keys, first, n, which[order], at[order], mask, bits

    def candidates(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pattern and place of windows that share a seed, about PAIRS at a time."""
        for w, hashes in rolling(text, list(self.seeds)).items():
            keys, first, n, which, at, mask, bits = self.seeds[w]
            spots = np.flatnonzero(mask[slots(hashes, bits)])
            hashes = hashes[spots]
            key = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            good = keys[key] == hashes
            spots, key = spots[good], key[good]
            lo, n = first[key], n[key]
            edges, last = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), "right"), 0
            for edge in np.append(edges, len(spots)):
                s, m, begin = spots[last:edge], n[last:edge], lo[last:edge]
                last = max(last, edge)
                if len(s):
                    seed = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())
                    yield which[seed], np.repeat(s, m) - at[seed]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern, place and mismatches of each window, once."""
        low = np.append(text.astype("u1"), np.zeros(16, "u1"))
        words = np.array(np.ndarray(len(text) + 8, "<u8", buffer=low.tobytes(), strides=(1,)))  # eight characters from each place on
        out = [self._verified(text, *self._near(words, *some)) for some in self.candidates(text)]
        if not out:
            return (np.zeros(0, "i8"),) * 3
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], axis=1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def _near(self, words: np.ndarray, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the candidates whose lowest bytes already differ in too many of the first sixteen characters."""
        inside = (at >= 0) & (at < len(words) - 8)
        which, at = which[inside], at[inside]
        wrong = np.zeros(len(at), "u8")
        for j in range(2):
            differ = (words[np.minimum(at + 8 * j, len(words) - 1)] ^ self.words[j][which]) & self.masks[j][which]
            for shift in (4, 2, 1):
                differ |= differ >> np.uint64(shift)
            wrong += ((differ & np.uint64(0x0101010101010101)) * np.uint64(0x0101010101010101)) >> np.uint64(56)
            keep = wrong <= self.most
            which, at, wrong = which[keep], at[keep], wrong[keep]
        return which, at

    def _verified(self, text: np.ndarray, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = (at >= 0) & (at + self.sizes[which] <= len(text))
        which, at = which[keep], at[keep]
        wrong = np.zeros(len(at), "i8")
        inside = np.ones(len(at), bool)
        for size in np.unique(self.sizes[which]).tolist():
            own, table = np.flatnonzero(self.sizes[which] == size), self.tables[size]
            for j in range(size):
                char = text[at[own] + j]
                differ = char != table[self.row[which[own]], j]
                wrong[own] += np.where(char == GAP, self.most + 1, differ)  # no window reaches over the end of a text
                if self.core and self.core[0] <= j < sum(self.core):
                    inside[own] &= ~differ
                near = wrong[own] <= self.most
                own = own if near.all() else own[near]
        keep = (wrong <= self.most) & inside
        return which[keep], at[keep], wrong[keep]


def strings(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch one by one: a batch may have ten thousand, and as Python's strings together they are many times a piece."""
    return (text.as_py() for text in column)


def pieces(texts: Iterable[str | None], overlap: int, together: int, back: int = 0) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Texts put together with gaps, about `together` characters at a time, a long one in parts that overlap; all but its first also hold the `back` characters before.

    Yields (number of the text, place of the part in it, place in the whole) of each part, and the whole.
    """
    marks, parts, size = [], [], 0
    for i, text in enumerate(texts):
        own = codes(text or "")
        for at in range(0, max(1, len(own)), together):
            first = max(0, at - back)
            part = own[first : at + together + overlap]
            marks.append((i, first, size))
            parts += [part, np.array([GAP], "<u4")]
            size += len(part) + 1
            if size >= together:
                yield marks, np.concatenate(parts)
                marks, parts, size = [], [], 0
    if marks:
        yield marks, np.concatenate(parts)


def _scan(texts: DataFrame, patterns: list, kind: str, seeds: list[tuple[int, int, int]], most: int, core: tuple[int, int] | None = None) -> DataFrame:
    """pattern_id, doc_id, x, mismatches. patterns: (pattern_id, pattern); seeds: (place in patterns, place in the pattern, width)."""
    held = texts.sparkSession.sparkContext.broadcast((Scanner([codes(p) for _, p in patterns], seeds, most, core), [i for i, _ in patterns]))
    together = TOGETHER
    doc = texts.schema["doc_id"].dataType.simpleString()

    def work(batches):
        scanner, own = held.value
        ids = pa.array(own)
        overlap = int(scanner.sizes.max(initial=1)) - 1
        for batch in batches:
            docs = batch.column(0)
            for marks, whole in pieces(strings(batch.column(1)), overlap, together):
                which, at, wrong = scanner.find(whole)
                text, base, start = (np.array(x) for x in zip(*marks, strict=True))
                part = np.searchsorted(start, at, "right") - 1
                x = at - start[part]
                keep = x < together  # what starts in the overlap is the next part's
                which, wrong, part, x = which[keep], wrong[keep], part[keep], x[keep]
                if len(x):
                    yield pa.record_batch([ids.take(pa.array(which)), docs.take(pa.array(text[part])), pa.array(base[part] + x), pa.array(wrong.astype("i4"))], names=["pattern_id", "doc_id", "x", "mismatches"])

    return texts.select("doc_id", "text").mapInArrow(work, f"pattern_id {kind}, doc_id {doc}, x long, mismatches int")


def smaller(rows: DataFrame, bytes_of, most: int = SMALL, of: DataFrame | None = None) -> DataFrame:
    """rows, marked for broadcast if their size, summed over them or over the rows `of` that they are made of, is at most `most`."""
    size = (rows if of is None else of).agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    return F.broadcast(rows) if size <= most else rows


def _found(texts: DataFrame, patterns: DataFrame, starts, longest, most: int, core: tuple[int, int] | None = None) -> DataFrame:
    """pattern_id, doc_id, x, mismatches. starts, longest: where the seeds of a pattern of some length begin, and how wide they may be."""
    size = patterns.agg(F.coalesce(F.sum(F.length("pattern") * 4 + 32 * (most + 1)), F.lit(0))).first()[0]
    if size <= SMALL:
        rows = [(r.pattern_id, r.pattern) for r in patterns.select("pattern_id", "pattern").collect()]  # at most SMALL bytes
        seeds = [(i, at, width_of(longest(len(p)))) for i, (_, p) in enumerate(rows) for at in starts(len(p))]
        return _scan(texts, rows, patterns.schema["pattern_id"].dataType.simpleString(), seeds, most, core)
    wide = F.array_max(F.filter(F.array(*[F.lit(w) for w in WIDTHS]), lambda w: w <= F.greatest(longest(F.length("pattern")), F.lit(1))))
    seeds = patterns.select("pattern_id", "pattern", F.explode(starts(F.length("pattern"))).alias("at"), wide.alias("w"))
    seeds = seeds.select("pattern_id", "at", "w", F.expr("substring(pattern, at + 1, w)").alias("gram"))
    met = None
    for w in sorted(r.w for r in seeds.select("w").distinct().collect()):
        own = kmers(texts, "doc_id", "text", w).join(seeds.where(F.col("w") == w), "gram").select("pattern_id", "doc_id", (F.col("pos") - F.col("at")).alias("x"))
        met = own if met is None else met.unionByName(own)
    if met is None:
        kinds = (patterns.schema["pattern_id"].dataType.simpleString(), texts.schema["doc_id"].dataType.simpleString())
        met = texts.sparkSession.createDataFrame([], "pattern_id {}, doc_id {}, x long".format(*kinds))
    checked = _windows(texts, patterns, met.where("x >= 0").distinct()).withColumn("mismatches", mismatches(F.col("window"), F.col("pattern")))
    if core:
        checked = checked.where(F.substring("window", core[0] + 1, core[1]) == F.substring("pattern", core[0] + 1, core[1]))
    return checked.where(F.col("mismatches") <= most).select("pattern_id", "doc_id", "x", "mismatches")


def _windows(texts: DataFrame, patterns: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the window of the text at x to candidates that fit in their text, and the pattern."""
    patterns = smaller(patterns.select("pattern_id", "pattern"), F.length("pattern") * 4 + 16)
    met = found.join(patterns, "pattern_id").join(texts.select("doc_id", "text"), "doc_id")
    whole = met.where((F.col("x") >= 0) & (F.col("x") + F.length("pattern") <= F.length("text")))
    return whole.select("pattern_id", "doc_id", "x", "pattern", F.substring("text", F.col("x").cast("int") + 1, F.length("pattern")).alias("window"))


def _indexed(texts: DataFrame, patterns: DataFrame, index: GramIndex, most: int) -> DataFrame:
    """As locate(): of the s grams that begin in a piece, one is at a place that the index has.

    What stands beside a stored gram is held against the pattern first. It settles exact patterns of the index's length, which need no text; others meet
    the texts where it fits.
    """
    length = F.length("pattern")
    shortest, longest = patterns.agg(F.min(length), F.max(length)).first()
    if shortest is not None and shortest // (most + 1) < index.least:
        raise ValueError(f"this index needs patterns of {index.least * (most + 1)} characters or more for {most} mismatches")
    starts = F.array(*[F.floor(F.lit(part) * length / F.lit(most + 1)).cast("int") + j for part in range(most + 1) for j in range(index.s)])
    seeds = patterns.select("pattern_id", "pattern", F.explode(F.array_distinct(starts)).alias("at"))
    near = F.least("at", F.lit(index.s - 1))
    before = F.reverse(F.substring("pattern", F.col("at") - near + 1, near)).alias("p_before")
    after = F.substring("pattern", F.col("at") + index.w + 1, F.lit(index.s - 1)).alias("p_after")
    seeds = seeds.select("pattern_id", "at", F.expr(f"substring(pattern, at + 1, {index.w})").alias("gram"), before, after)
    seeds = smaller(seeds, F.lit(4 * (index.w + 2 * index.s) + 64) * index.s * (most + 1), of=patterns)
    met = index.hits(seeds)
    if most == 0:
        met = met.where(F.col("t_before").startswith(F.col("p_before")) & F.col("t_after").startswith(F.col("p_after")))
    else:
        sides = [(F.substring(f"t_{c}", F.lit(1), F.length(f"p_{c}")), F.col(f"p_{c}")) for c in ("before", "after")]
        for a, b in sides:  # a text that ends there has no room for the pattern
            met = met.where(F.length(a) == F.length(b))
        met = met.where(mismatches(*sides[0]) + mismatches(*sides[1]) <= most)
    met = met.select("pattern_id", "doc_id", (F.col("x") - F.col("at")).alias("x")).where("x >= 0").distinct()
    if most == 0 and (longest or 0) <= index.least:
        return met.withColumn("mismatches", F.lit(0))
    checked = _windows(texts, patterns, met).withColumn("mismatches", mismatches(F.col("window"), F.col("pattern")))
    return checked.where(F.col("mismatches") <= most).select("pattern_id", "doc_id", "x", "mismatches")


def locate(texts: DataFrame, patterns: DataFrame, most: int = 0, index: GramIndex | None = None) -> DataFrame:
    """pattern_id, doc_id, x, mismatches: where patterns (pattern_id, pattern) occur in texts (doc_id, text) with at most `most` mismatches.

    A pattern shorter than most + 1 is an error; null texts and patterns have no occurrences. index: a stored index of the texts, which are then read
    only where a gram of a pattern occurs; each piece of a pattern must have the length that the index is for.
    """
    patterns = patterns.where("pattern is not null").select("pattern_id", "pattern")
    shortest = patterns.agg(F.min(F.length("pattern"))).first()[0]
    if shortest is not None and shortest < most + 1:
        raise ValueError(f"patterns need at least {most + 1} characters for {most} mismatches")
    if index is not None:
        return _indexed(texts, patterns, index, most)

    def starts(length):
        if isinstance(length, int):
            return [part * length // (most + 1) for part in range(most + 1)]
        return F.array(*[F.floor(F.lit(part) * length / F.lit(most + 1)).cast("int") for part in range(most + 1)])

    def longest(length):
        return length // (most + 1) if isinstance(length, int) else F.floor(length / F.lit(most + 1)).cast("int")

    return _found(texts, patterns, starts, longest, most)


def count(texts: DataFrame, patterns: DataFrame, most: int = 0) -> DataFrame:
    """pattern_id, n_occ: how often each pattern occurs; patterns that don't occur have 0."""
    found = locate(texts, patterns, most).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("pattern_id").join(found, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0)).alias("n_occ"))


def seed_extend(texts: DataFrame, patterns: DataFrame, left: int, core: int, most: int) -> DataFrame:
    """As locate, for occurrences whose characters left ... left + core - 1 are exact. A pattern that ends before its core does is an error."""
    patterns = patterns.where("pattern is not null").select("pattern_id", "pattern")
    shortest = patterns.agg(F.min(F.length("pattern"))).first()[0]
    if core < 1 or left < 0 or (shortest is not None and shortest < left + core):
        raise ValueError("the core must lie inside each pattern")
    starts = lambda length: [left] if isinstance(length, int) else F.array(F.lit(left))
    longest = lambda length: core if isinstance(length, int) else F.lit(core)
    return _found(texts, patterns, starts, longest, most, (left, core))


def histogram(texts: DataFrame, patterns: DataFrame, most: int = 2) -> DataFrame:
    """pattern_id, mismatches, n: windows with each number of mismatches from 0 to `most`; numbers without windows have 0."""
    found = locate(texts, patterns, most).groupBy("pattern_id", "mismatches").agg(F.count(F.lit(1)).alias("n"))
    every = patterns.select("pattern_id", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("mismatches"))
    return every.join(found, ["pattern_id", "mismatches"], "left").select("pattern_id", "mismatches", F.coalesce("n", F.lit(0)).alias("n"))


def totals(texts: DataFrame, patterns: DataFrame, most: int = 2) -> DataFrame:
    """mismatches, n: windows with each number of mismatches from 0 to `most`, over all patterns."""
    return histogram(texts, patterns, most).groupBy("mismatches").agg(F.sum("n").alias("n"))


def report(texts: DataFrame, patterns: DataFrame, most: int = 0) -> DataFrame:
    """One row: patterns, occ_total, occ_avg (double), found (patterns that occur)."""
    counts = count(texts, patterns, most)
    return counts.agg(F.count(F.lit(1)).alias("patterns"), F.sum("n_occ").alias("occ_total"), (F.sum("n_occ") / F.count(F.lit(1))).alias("occ_avg"), F.count(F.when(F.col("n_occ") > 0, 1)).alias("found"))


def violations(texts: DataFrame, patterns: DataFrame, found: DataFrame, most: int, left: int = 0, core: int = 0) -> DataFrame:
    """The rows of found (pattern_id, doc_id, x) whose window has more mismatches, lies outside its text, or differs in the core."""
    found = written(found, "found")  # is read twice, and may be a scan of all texts
    good = _windows(texts, patterns, smaller(found.select("pattern_id", "doc_id", "x"), F.lit(64))).where(mismatches(F.col("window"), F.col("pattern")) <= most)
    if core:
        good = good.where(F.substring("window", left + 1, core) == F.substring("pattern", left + 1, core))
    return found.join(good, ["pattern_id", "doc_id", "x"], "left_anti")


def neighbours(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id, x, before, after: the characters around each exact occurrence; null at an end of the text."""
    found = locate(texts, patterns).select("pattern_id", "doc_id", "x")
    met = found.join(smaller(patterns.select("pattern_id", "pattern"), F.length("pattern") * 4 + 16), "pattern_id").join(texts.select("doc_id", "text"), "doc_id")
    at = F.col("x").cast("int")
    return met.select("pattern_id", "doc_id", "x", char_at(F.col("text"), at - 1).alias("before"), char_at(F.col("text"), at + F.length("pattern")).alias("after"))


def extend(around: DataFrame, side: str) -> DataFrame:
    """pattern_id, ch, n_occ: occurrences of each one-character extension; side: `before` or `after`."""
    return around.where(F.col(side).isNotNull()).groupBy("pattern_id", F.col(side).alias("ch")).agg(F.count(F.lit(1)).alias("n_occ"))


def maximal(around: DataFrame, side: str) -> DataFrame:
    """pattern_id, n_chars, maximal: how many characters (an end of the text counts as one) stand on this side of a pattern, and whether it is more than one."""
    n = F.countDistinct(F.coalesce(F.col(side), F.lit("")))
    return around.groupBy("pattern_id").agg(n.alias("n_chars"), (n > 1).alias("maximal"))


def sample_patterns(texts: DataFrame, length: int, per_text: int = 1, seed: int = 0) -> DataFrame:
    """pattern_id, doc_id, x, pattern: substrings of one length at places that follow from the digest of text id and seed."""
    rows = texts.where(F.length("text") >= length).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(per_text - 1))).alias("no"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("no").cast("string"), F.lit(str(seed))))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (F.length("text") - length + 1)
    placed = rows.withColumn("x", place)
    return placed.select((F.col("doc_id") * per_text + F.col("no")).alias("pattern_id"), "doc_id", "x", F.substring("text", F.col("x").cast("int") + 1, F.lit(length)).alias("pattern"))


def tiled_patterns(texts: DataFrame, length: int, most: int = 1_000_000) -> DataFrame:
    """pattern_id, doc_id, x, pattern: each text as pieces of one length, one after the other; the last reaches back where characters remain.

    pattern_id is doc_id * most + the number of the piece; a text of more pieces than `most` is an error, and shorter texts give none.
    """
    n = F.length("text")
    starts = F.array_distinct(F.concat(F.expr(f"sequence(0, length(text) - {length}, {length})"), F.array(n - length)))
    sound = F.when(F.size("__starts") <= most, F.col("__starts")).otherwise(F.raise_error(F.lit("a text has too many pieces")).cast("array<int>"))
    rows = texts.where(n >= length).select("doc_id", "text", starts.alias("__starts")).select("doc_id", "text", F.posexplode(sound).alias("__no", "x"))
    return rows.select((F.col("doc_id") * most + F.col("__no")).alias("pattern_id"), "doc_id", F.col("x").cast("long").alias("x"), F.substring("text", F.col("x") + 1, F.lit(length)).alias("pattern"))


def param_grid(spark, **lists) -> DataFrame:
    """A row for each combination of the values of the named lists, for benchmarks."""
    from itertools import product

    return spark.createDataFrame(list(product(*lists.values())), list(lists))
