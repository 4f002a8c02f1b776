"""Grams that texts share with queries of a bounded size, found where the texts lie.

Queries up to SMALL go to every executor as their characters and the sorted hashes of their grams. Texts are scanned in Arrow batches, a piece at a
time: what has a hash of the queries is held against their characters, so a hash alone decides nothing, and only what is shared leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.operators.locate import GAP, PAIRS, SMALL, TOGETHER, codes, pieces, rolling, strings

#: Stands between queries, and for characters of a text that a match may not hold: alike with nothing.
APART, NONE = GAP + 1, GAP + 2


def alike(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, w: int) -> np.ndarray:
    """Whether w characters of a and b are the same at each pair of places."""
    same = np.ones(len(at), bool)
    for j in range(w):
        same &= a[at + j] == b[to + j]
    return same


def beside(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many characters of a and b, `most` at most, are the same from each pair of places on. Both end with a character that is alike with none."""
    n, on = np.zeros(len(at), "i8"), np.arange(len(at))
    for j in range(most):
        x, y = np.clip(at[on] + step * j, -1, len(a) - 1), np.clip(to[on] + step * j, -1, len(b) - 1)
        on = on[a[x] == b[y]]
        n[on] += 1
    return n


class Grams:
    """The grams of w characters of queries that lie in one array, each followed by APART."""

    def __init__(self, whole: np.ndarray, w: int):
        self.whole, self.w = whole, w
        hashes = rolling(whole, [w])[w]
        at, ends = np.arange(len(hashes)), np.flatnonzero(whole == APART)
        at = at[ends[np.searchsorted(ends, at)] >= at + w] if len(at) else at
        self.places = at[np.argsort(hashes[at], kind="stable")].astype("i4")
        self.keys, self.first, self.n = np.unique(hashes[self.places], return_index=True, return_counts=True)
        self.bits = min(24, max(10, int(16 * len(self.keys)).bit_length()))
        self.mask = np.zeros(1 << self.bits, bool)
        self.mask[self._slots(self.keys)] = True

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def _met(self, text: np.ndarray, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text (among `at`, if given) with a hash of the queries, and its number."""
        hashes = rolling(text, [self.w])[self.w]
        if at is not None:
            at = at[at < len(hashes)]
            hashes = hashes[at]
        if not len(self.keys):
            return (np.zeros(0, "i8"),) * 2
        near = np.flatnonzero(self.mask[self._slots(hashes)])
        key = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        good = self.keys[key] == hashes[near]
        near, key = near[good], key[good]
        return (near if at is None else at[near]), key

    def _pairs(self, spots: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places with all places of their hash in the queries, about PAIRS at a time."""
        n = self.n[key]
        edges, last = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), "right"), 0
        for edge in np.append(edges, len(spots)):
            s, k, m = spots[last:edge], key[last:edge], n[last:edge]
            last = max(last, edge)
            if len(s):
                yield np.repeat(s, m), self.places[np.repeat(self.first[k] - np.cumsum(m) + m, m) + np.arange(m.sum())].astype("i8")

    def hits(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the text, among `at`, and of the queries with one gram."""
        for x, i in self._pairs(*self._met(text, at)):
            same = alike(text, x, self.whole, i, self.w)
            yield x[same], i[same]

    def known(self, text: np.ndarray) -> np.ndarray:
        """The places of the text whose gram is one of the queries'."""
        spots, key = self._met(text, None)
        same = alike(text, spots, self.whole, self.places[self.first[key]].astype("i8"), self.w)
        odd = ~same & (self.n[key] > 1)  # another gram has the hash of the one that was looked at
        more = [x[alike(text, x, self.whole, i, self.w)] for x, i in self._pairs(spots[odd], key[odd])] if odd.any() else []
        return np.unique(np.concatenate([spots[same], *more]))


def small(queries: DataFrame, each: int, most: int = SMALL) -> bool:
    """Whether queries of `each` bytes a character are of a bounded size."""
    return queries.agg(F.coalesce(F.sum(F.length("text") * each + 64), F.lit(0))).first()[0] <= most


def held(queries: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of queries of a bounded size, where each begins, and their characters."""
    rows = queries.where("text is not null").select("query_id", "text").toArrow()
    own = [codes(text.as_py()) for text in rows["text"]]
    whole = np.concatenate([np.append(x, np.uint32(APART)) for x in own]) if own else np.array([APART], "<u4")
    starts = np.cumsum([0] + [len(x) + 1 for x in own])[:-1] if own else np.zeros(0, "i8")
    return rows["query_id"].combine_chunks(), starts, whole


def _only(core: str | None):
    """Puts NONE for characters of a text that aren't of core."""
    if core is None:
        return lambda whole: whole
    table = np.full(NONE + 1, NONE, "<u4")
    table[GAP] = GAP
    table[codes(core)] = codes(core)
    return lambda whole: table[whole]


def _parts(batch: pa.RecordBatch, back: int, overlap: int, together: int):
    """Pieces of a batch's texts: for each part the text's number, its place in the text, in the piece and its length, and the piece; parts reach `back` characters back."""
    for marks, whole in pieces(strings(batch.column(1)), overlap, together, back):
        text, base, start = (np.array(x) for x in zip(*marks, strict=True))
        yield text, base, start, np.diff(np.append(start, len(whole))), whole


def hits(texts: DataFrame, queries: DataFrame, w: int, s: int, core: str | None = None) -> DataFrame:
    """doc_id, query_id, x, i, b, a: grams of w characters at multiples of s in a text and anywhere in a query, and how far (s - 1 at most) they are alike before and after; only those that may be of a match of w + s - 1."""
    ids, starts, own = held(queries)
    shared = texts.sparkSession.sparkContext.broadcast((ids, starts, Grams(own, w)))
    together = -(-max(TOGETHER, 4 * (w + s)) // s) * s
    kinds = texts.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def work(batches):
        ids, starts, grams = shared.value
        only = _only(core)
        for batch in batches:
            for text, base, start, size, whole in _parts(batch, s - 1, w + s - 2, together):
                whole, part = only(whole), np.repeat(np.arange(len(start)), size)
                place = np.arange(len(whole)) - (start - base)[part]
                for at, to in grams.hits(whole, np.flatnonzero(place % s == 0)):
                    x, low = place[at], base[part[at]] + np.where(base[part[at]] > 0, s - 1, 0)
                    mine = (x >= low) & (x < low + together)  # the rest is of the part before or after
                    at, to, x = at[mine], to[mine], x[mine]
                    b = beside(whole, at - 1, grams.whole, to - 1, -1, s - 1)
                    a = beside(whole, at + w, grams.whole, to + w, 1, s - 1)
                    long = a + b >= s - 1
                    at, to, x, a, b = at[long], to[long], x[long], a[long], b[long]
                    if len(x):
                        query = np.searchsorted(starts, to, "right") - 1
                        columns = [batch.column(0).take(pa.array(text[part[at]])), ids.take(pa.array(query)), pa.array(x), pa.array(to - starts[query]), pa.array(b), pa.array(a)]
                        yield pa.record_batch(columns, names=["doc_id", "query_id", "x", "i", "b", "a"])

    return texts.select("doc_id", "text").mapInArrow(work, "doc_id {}, query_id {}, x long, i long, b long, a long".format(*kinds))


def known(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """doc_id, x, gram, before: the places of texts whose next k characters are in a query, and the character before them ('' at a beginning)."""
    shared = texts.sparkSession.sparkContext.broadcast(Grams(held(queries)[2], k))
    together = max(TOGETHER, 4 * k)

    def work(batches):
        grams = shared.value
        for batch in batches:
            for text, base, start, size, whole in _parts(batch, 1, k - 1, together):
                at = grams.known(whole)
                part = np.searchsorted(start, at, "right") - 1
                x, low = at - start[part] + base[part], base[part] + (base[part] > 0)
                mine = (x >= low) & (x < low + together)
                at, part, x = at[mine], part[mine], x[mine]
                for j in range(0, len(at), PAIRS // k + 1):
                    spots = at[j : j + PAIRS // k + 1]
                    seen = whole[spots[:, None] + np.arange(k)].tobytes().decode("utf-32-le", "surrogatepass")
                    last = [chr(c) if p else "" for c, p in zip(whole[spots - 1].tolist() if len(whole) else [], x[j : j + len(spots)].tolist(), strict=True)]
                    columns = [batch.column(0).take(pa.array(text[part[j : j + len(spots)]])), pa.array(x[j : j + len(spots)]), pa.array([seen[n : n + k] for n in range(0, len(seen), k)]), pa.array(last)]
                    yield pa.record_batch(columns, names=["doc_id", "x", "gram", "before"])

    return texts.select("doc_id", "text").mapInArrow(work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x long, gram string, before string")


def longest_below(texts: DataFrame, queries: DataFrame, wide: int, core: str | None = None) -> DataFrame:
    """doc_id, d: the length of the longest substring of fewer than `wide` (a power of two) characters that a text shares with any query, a row for each text."""
    own = held(queries)[2]
    shared = texts.sparkSession.sparkContext.broadcast({k: Grams(own, k) for k in range(1, wide)})
    together = max(TOGETHER, 4 * wide)

    def work(batches):
        grams, only = shared.value, _only(core)
        for batch in batches:
            for text, _, start, size, whole in _parts(batch, 0, wide - 1, together):
                whole, d, step = only(whole), np.zeros(len(start), "i8"), wide // 2
                while step:  # a text that shares a gram of some length shares shorter ones too
                    for k in np.unique(d + step).tolist():
                        asked = np.flatnonzero(d + step == k)
                        some = whole if len(asked) == len(d) else np.concatenate([whole[b : b + n] for b, n in zip(start[asked], size[asked], strict=True)])
                        at = np.cumsum(size[asked]) - size[asked]
                        met = np.unique(np.searchsorted(at, grams[k].known(some), "right") - 1)
                        d[asked[met]] = -k  # reached in this round
                    d = np.where(d < 0, -d, d)
                    step //= 2
                yield pa.record_batch([batch.column(0).take(pa.array(text)), pa.array(d)], names=["doc_id", "d"])

    found = texts.select("doc_id", "text").mapInArrow(work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, d long")
    return found.groupBy("doc_id").agg(F.max("d").alias("d"))
