"""Table functions for SQL, each on a table argument, with columns that follow from the argument's.

    from gramweave.functions.tables import register
    register(spark)
    spark.sql("select * from locate_in(table(select doc_id, text from docs), array('needle', 'thread'), 1)")
    spark.sql("select * from grams_in(table(select doc_id, text from docs), 20)")
    spark.sql("select * from runs_in(table(select doc_id, query_id, x, i from hits) partition by (doc_id, query_id, x - i) order by (x), 20)")

    register_known(spark, "asked_grams", queries, 20)
    spark.sql("select * from asked_grams(table(select doc_id, text from docs))")

The first column of texts is their id, of any type, and the second the text. locate_in scans where the rows lie, texts of a megabyte together, with the
patterns held once a task, and grams_in cuts there: neither shuffles. A function that register_known makes scans as locate_in does and gives the rows of grams_in whose
gram is one of the queries', so what a join on the gram would drop never leaves Python. runs_in gets the hits of one diagonal at a time, in order, and joins those that follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gramweave.operators import grams
from gramweave.operators.locate import TOGETHER, Scanner, codes, pieces, width_of


def _texts(argument: AnalyzeArgument, name: str) -> T.StructField:
    """The id column of a table of texts."""
    if not argument.isTable or len(argument.dataType.fields) != 2 or not isinstance(argument.dataType.fields[1].dataType, T.StringType):
        raise ValueError(f"{name} takes a table with two columns, an id and a text")
    return argument.dataType.fields[0]


def _number(argument: AnalyzeArgument | None, name: str, least: int) -> None:
    if argument is not None and (argument.value is None or argument.value < least):
        raise ValueError(f"{name} must be a constant number, {least} or more")


class _LocateIn:
    @staticmethod
    def analyze(texts: AnalyzeArgument, patterns: AnalyzeArgument, mismatches: AnalyzeArgument) -> AnalyzeResult:
        own = _texts(texts, "locate_in")
        if patterns.dataType != T.ArrayType(T.StringType(), patterns.dataType.containsNull if isinstance(patterns.dataType, T.ArrayType) else True):
            raise ValueError("locate_in takes the patterns as an array of strings")
        _number(mismatches, "the number of mismatches", 0)
        return AnalyzeResult(T.StructType([T.StructField("pattern", T.StringType()), own, T.StructField("x", T.LongType()), T.StructField("mismatches", T.IntegerType())]))

    def __init__(self):
        self.scanner, self.held, self.size = None, [], 0

    def eval(self, row: Row, patterns: list[str], mismatches: int) -> Iterator[tuple]:
        if self.scanner is None:
            self.patterns = list(dict.fromkeys(p for p in patterns or [] if p is not None))
            if any(len(p) < mismatches + 1 for p in self.patterns):
                raise ValueError(f"patterns need at least {mismatches + 1} characters for {mismatches} mismatches")
            seeds = [(i, part * len(p) // (mismatches + 1), width_of(len(p) // (mismatches + 1))) for i, p in enumerate(self.patterns) for part in range(mismatches + 1)]
            self.scanner = Scanner([codes(p) for p in self.patterns], seeds, mismatches, None)
        self.held.append(row)
        self.size += len(row[1] or "")
        if self.size >= TOGETHER:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple]:
        """The matches in the texts that are held."""
        held, self.held, self.size = self.held, [], 0
        overlap = int(self.scanner.sizes.max(initial=1)) - 1 if self.scanner else 0
        for marks, whole in pieces([r[1] for r in held], overlap, TOGETHER):
            which, at, wrong = self.scanner.find(whole)
            text, base, start = (np.array(x) for x in zip(*marks, strict=True))
            part = np.searchsorted(start, at, "right") - 1
            x = at - start[part]
            for k in np.flatnonzero(x < TOGETHER).tolist():  # what starts in the overlap is the next part's
                yield self.patterns[which[k]], held[text[part[k]]][0], int(base[part[k]] + x[k]), int(wrong[k])


class _GramsIn:
    @staticmethod
    def analyze(texts: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        own = _texts(texts, "grams_in")
        _number(k, "k", 1)
        return AnalyzeResult(T.StructType([own, T.StructField("pos", T.LongType()), T.StructField("gram", T.StringType())]))

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        id_, text = row
        for at in range(len(text or "") - k + 1):
            yield id_, at, text[at : at + k]


class _RunsIn:
    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in hits.dataType.fields] if hits.isTable else []
        if names[-2:] != ["x", "i"] or len(names) < 3:
            raise ValueError("runs_in takes a table of ids, x and i, in this order")
        _number(k, "k", 1)
        return AnalyzeResult(T.StructType([*hits.dataType.fields[:-2], T.StructField("x", T.LongType()), T.StructField("i", T.LongType()), T.StructField("d", T.LongType())]))

    def __init__(self):
        self.open = None  # ids, the first x and i, the last x, and k

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        *ids, x, i = row
        if self.open is not None and self.open[3] + 1 == x:
            self.open[3] = x
            return
        yield from self.terminate()
        self.open = [ids, x, i, x, k]

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            ids, x, i, last, k = self.open
            self.open = None
            yield *ids, x, i, last - x + k


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, cls in (("locate_in", _LocateIn), ("grams_in", _GramsIn), ("runs_in", _RunsIn)):
        spark.udtf.register(name, udtf(cls))


def register_known(spark: SparkSession, name: str, queries: DataFrame, k: int) -> None:
    """Makes the table function `name` known to the session's SQL: name(table(texts)) gives the rows of grams_in(table(texts), k) whose gram is in queries (query_id, text).

    Each executor holds the queries, so they must be of a bounded size: see grams.small().
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    shared = spark.sparkContext.broadcast(grams.Grams(grams.held(queries)[2], k))
    together = max(TOGETHER, 4 * k)

    class KnownGrams:
        @staticmethod
        def analyze(texts: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(T.StructType([_texts(texts, name), T.StructField("pos", T.LongType()), T.StructField("gram", T.StringType())]))

        def __init__(self):
            self.held, self.size = [], 0

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append(row)
            self.size += len(row[1] or "")
            if self.size >= together:
                yield from self.terminate()

        def terminate(self) -> Iterator[tuple]:
            held, self.held, self.size = self.held, [], 0
            for marks, whole in pieces([r[1] for r in held], k - 1, together):
                at = shared.value.known(whole)
                text, base, start = (np.array(x) for x in zip(*marks, strict=True))
                part = np.searchsorted(start, at, "right") - 1
                x = at - start[part]
                for j in np.flatnonzero(x < together).tolist():  # what starts in the overlap is the next part's
                    id_, whole_text = held[text[part[j]]]
                    pos = int(base[part[j]] + x[j])
                    yield id_, pos, whole_text[pos : pos + k]

    spark.udtf.register(name, udtf(KnownGrams))
