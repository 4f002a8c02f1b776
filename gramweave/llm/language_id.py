"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a text bundles (adds) the vectors of its n-grams; a language's prototype bundles those of its texts.
A text's language is the prototype with the largest cosine.

`identified` keeps what has one of the languages: a text without a letter has none, and one that no prototype resembles (another script, or
strings that no language has) scores far below others of its length. It judges language, not quality: words of a language repeated over and over stay. The level is one function of the number of
n-grams n: LEVEL of the median score that rows with a label have at that length, as the line between the medians of lengths by powers of four, times n / (n + DOUBT),
as the fewer n-grams a text has, the further scores of one language spread.

Texts are lower-cased; letters of the Latin blocks have symbols of their own, other letters share symbols by their code, and
everything else is one boundary symbol, runs of which are one. Texts count with all their n-grams, whatever their length.

Cases: a null text, or one without a letter, is `und` with score 0; rows without a language, and repeated rows, are no special
case in training (rows with a null label are left out); without any labelled text every text is `und`; of equal cosines the
first language by code points is taken; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

N, SYMBOLS, SIZE, SEED = 3, 128, 1024, 7
UNKNOWN = "und"
#: The share of the median score that a long text needs, and the n-grams at which half of that is asked for.
LEVEL, DOUBT = 0.25, 512
#: n-gram vectors that a worker remembers within a task, 1 KB each.
MOST_GRAMS = 24_000
#: Distinct n-grams of a language that a worker counts before it bundles them.
MOST_COUNTED = 200_000


@lru_cache(1)
def alphabet() -> np.ndarray:
    """The symbol of each code point of the basic plane: 0 for what is no letter, own symbols for a-z and Latin letters, the rest shared."""
    found = np.zeros(0x10000, dtype="i8")
    for code in range(0x10000):
        if chr(code).isalpha():
            if 97 <= code <= 122:
                found[code] = code - 96
            elif 0xDF <= code <= 0xFF:
                found[code] = 27 + code - 0xDF
            else:
                found[code] = 60 + (code * 31 + (code >> 7)) % (SYMBOLS - 60)
    return found


@lru_cache(1)
def letters() -> np.ndarray:
    """Places x symbols x size: the random signs of each symbol, rotated by one for each place that follows."""
    signs = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, SIZE)).astype("i1") * 2 - 1
    return np.stack([np.roll(signs, N - 1 - place, axis=1) for place in range(N)])


_rows: dict[int, int] = {}
_table = np.zeros((0, SIZE), dtype="i1")


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row for each n-gram code."""
    global _table
    if not len(_table):
        _table = np.zeros((MOST_GRAMS, SIZE), dtype="i1")
    new = [g for g in grams.tolist() if g not in _rows]
    if new:
        if len(_rows) + len(new) > MOST_GRAMS:
            _rows.clear()
            new = grams.tolist()
        own = _bind(np.asarray(new))
        if len(new) > MOST_GRAMS:
            return own
        _table[len(_rows) : len(_rows) + len(new)] = own
        _rows.update(zip(new, range(len(_rows), len(_rows) + len(new)), strict=True))
    return _table[[_rows[g] for g in grams.tolist()]]


def forget() -> None:
    """Frees the remembered vectors: a worker goes on to other work."""
    global _table
    _rows.clear()
    _table = np.zeros((0, SIZE), dtype="i1")


def bundled(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of n-grams, each as often as it occurs."""
    return sum(counts[i : i + 1024].astype("f4") @ gram_vectors(grams[i : i + 1024]).astype("f4") for i in range(0, len(grams), 1024))


def _bind(grams: np.ndarray) -> np.ndarray:
    signs, out = letters(), np.int8(1)
    for place in range(N):
        out = out * signs[place][(grams // SYMBOLS ** (N - 1 - place)) % SYMBOLS]
    return out


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The n-gram codes of a text and how often each occurs; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    symbols = np.where(codes < 0x10000, alphabet()[np.minimum(codes, 0xFFFF)], 0)
    if (far := codes >= 0x10000).any():
        symbols[far] = [60 + c % (SYMBOLS - 60) if chr(c).isalpha() else 0 for c in codes[far].tolist()]
    if not symbols.any():
        return None
    symbols = np.concatenate([[0], symbols, [0]])
    symbols = symbols[np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))]
    grams = np.zeros(len(symbols) - N + 1, dtype="i8")
    for place in range(N):
        grams = grams * SYMBOLS + symbols[place : len(symbols) - N + 1 + place]
    return np.unique(grams, return_counts=True)


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundled vector of each language, from all rows with a language. A row for each language and coordinate is collected, however many texts there are."""

    def bundle(batches):
        found: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def add(lang: str) -> None:
            own = found.pop(lang)
            grams, counts = np.fromiter(own.keys(), "i8", len(own)), np.fromiter(own.values(), "i8", len(own))
            total = sum(counts[i : i + 4096] @ _bind(grams[i : i + 4096]).astype("i8") for i in range(0, len(grams), 4096))
            sums[lang] = sums[lang] + total if lang in sums else total

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p := profile(text):
                    own = found.setdefault(lang, {})
                    for g, n in zip(p[0].tolist(), p[1].tolist(), strict=True):
                        own[g] = own.get(g, 0) + n
                    if len(own) > MOST_COUNTED:
                        add(lang)
        for lang in list(found):
            add(lang)
        for lang, total in sums.items():
            yield pa.record_batch([pa.array([lang] * SIZE, pa.string()), pa.array(range(SIZE), pa.int32()), pa.array(total, pa.int64())], names=["lang", "at", "sum"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    sums = rows.mapInArrow(bundle, "lang string, at int, sum long").groupBy("lang", "at").agg(F.sum("sum").alias("sum")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, at, total in sums:
        out.setdefault(lang, np.zeros(SIZE))[at] = total
    return {k: out[k] / np.linalg.norm(out[k]) for k in sorted(out) if out[k].any()}


def predict(docs: DataFrame, known: dict[str, np.ndarray], shown: list[Column], text_col: str = "text", count: bool = False) -> DataFrame:
    """The columns shown, with lang_pred and score (the cosine, at least 0) of each row's text; count: and n_grams."""
    names, matrix = list(known), np.array([known[k] for k in known], dtype="f4").T
    rows = docs.select(*shown)

    def work(batches):
        for batch in slices(batches):
            langs, scores, sizes = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                p = profile(text) if names else None
                sizes.append(int(p[1].sum()) if p else 0)
                if p is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = bundled(*p)
                cosines = own @ matrix / max(float(np.linalg.norm(own)), 1e-9)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more[: 2 + count]], names=[*batch.schema.names[:-1], "lang_pred", "score", "n_grams"][: batch.num_columns + 1 + count])
        forget()

    out = rows.schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*shown, F.col(text_col).alias("__text")).mapInArrow(work, out.add("n_grams", "long") if count else out)


def band(n_grams: Column) -> Column:
    """Texts of about one length: from 4 ** band n-grams on."""
    return F.floor((F.length(F.bin(n_grams)) - 1) / 2).cast("int")


def medians(scored: DataFrame) -> list[tuple[float, float]]:
    """For each band, the binary logarithm of its middle length and the median score, from scored rows with a label (score, n_grams).

    Rows for each band and thousandth of a score are collected, however many texts there are.
    """
    counts = scored.groupBy(band(F.col("n_grams")).alias("band"), F.floor(F.col("score") * 1000).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    found: dict[int, dict[int, int]] = {}
    for number, at, n in counts.collect():
        found.setdefault(number, {})[at] = n
    out = []
    for number, own in sorted(found.items()):
        at = np.array(sorted(own))
        out.append((2.0 * number + 1, float(at[np.searchsorted(np.cumsum([own[x] for x in at.tolist()]), sum(own.values()) / 2)]) / 1000))
    return out


def level(n_grams: Column, points: list[tuple[float, float]], share: float = LEVEL, doubt: int = DOUBT) -> Column:
    """The least score for a length: share of the median, between and beyond the points along lines, times n / (n + doubt)."""
    x = F.log2(n_grams)
    median = F.lit(points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        median = F.when(x >= x0, F.lit(y0) + (F.least(x, F.lit(x1)) - x0) * ((y1 - y0) / (x1 - x0))).otherwise(median)
    return median * share * n_grams / (n_grams + doubt)


def identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = LEVEL, doubt: int = DOUBT) -> DataFrame:
    """The rows of docs whose text has one of the languages of its labels, with the columns of docs. Without any label, those whose text has a letter."""
    known = prototypes(docs, text_col, lang_col)
    if not known:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    shown = [F.struct("*").alias("row"), F.col(lang_col).isNotNull().alias("labelled")]
    scored = written(predict(docs, known, shown, text_col, count=True), "language-scores").where(F.col("lang_pred") != UNKNOWN)
    points = medians(scored.where("labelled"))
    return (scored.where(F.col("score") >= level(F.col("n_grams"), points, share, doubt)) if points else scored).select("row.*")
