"""Byte-level BPE through tiktoken, from a local rank file.

Long texts are cut before they are encoded, where the pattern always ends a piece: for the pattern of CUTS between a letter, number or punctuation
mark and a space or line break, or between a letter and a number. No piece spans such a place, and what the pattern looks ahead for is white
space, so the parts have the ids of the whole. A text without such a place stays whole, as do all texts under another pattern.

The library's engine runs out of stack in white space of about a million characters. Under the pattern of CUTS a run of white space is one piece up to its last
character if something else follows, and whole at the end of the text, so long runs are cut out and merged by the library as the pieces they are. Ids decode to raw bytes: a token may
end inside a character, so only the bytes of all tokens together are UTF-8.

Cases: a null text is an empty one, with no ids; repeated rows are encoded each for itself; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Code points from which a text is cut.
LONG = 50_000

# A pattern, and where its pieces end whatever follows.
CUTS = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})",
}

#: White space as the library's engine knows it.
RUNS = r"\p{White_Space}+"

_open: dict[tuple[str, str], tuple] = {}


def coder(ranks: str, pattern: str):
    """tiktoken's encoding and the decimal form of each id, once a worker."""
    if (ranks, pattern) not in _open:
        import tiktoken

        with open(ranks, "rb") as f:
            found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _open[ranks, pattern] = (tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=found, special_tokens={}), {i: str(i) for i in found.values()})
    return _open[ranks, pattern]


def safe_parts(text: str, most: int = LONG, pattern: str = next(iter(CUTS))) -> Iterator[tuple[str, bool]]:
    """Parts of about `most` code points, cut only where a piece of the pattern ends whatever follows, and whether a part is known to be one piece.

    The whole text, if no such places are known.
    """
    import regex

    if len(text) <= most or pattern not in CUTS:
        yield text, False
        return
    cut, at = regex.compile(CUTS[pattern]), 0
    for run in [m.span() for m in regex.finditer(RUNS, text) if m.end() - m.start() > most] + [(len(text), len(text))]:
        while run[0] - at > most and (m := cut.search(text, at + most, run[0])):
            yield text[at : m.start()], False
            at = m.start()
        yield text[at : run[0]], False
        at = run[1] - (run[1] < len(text))
        if at > run[0]:
            yield text[run[0] : at], True


def part_ids(enc, part: str, whole: bool) -> list[int]:
    """The ids of a part of safe_parts()."""
    return enc._encode_single_piece(part.encode()) if whole else enc.encode_ordinary(part)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ids (array<int>) of each row's whole text."""

    def work(batches):
        enc, _ = coder(ranks, pattern)
        for batch in slices(batches):
            ids = [[i for p in safe_parts(t, pattern=pattern) for i in part_ids(enc, *p)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(text_col, F.lit(""))).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The id and raw (binary) of each row's ids; null ids give null."""

    def work(batches):
        enc, _ = coder(ranks, pattern)
        for batch in slices(batches):
            raw = [None if x is None else enc.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "raw"])

    kind = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()
    return encoded.select(F.col(id_col), "ids").mapInArrow(work, f"`{id_col}` {kind}, raw binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes, and keeps the digests: the id, n_tokens, ids_sha256 (of the decimal ids, joined by spaces), decoded_sha256.

    Each part of a long text is encoded, decoded and digested before the next, so a worker holds no more than a part's ids.
    """

    def work(batches):
        enc, decimal = coder(ranks, pattern)
        for batch in slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                n, h, raw = 0, hashlib.sha256(), hashlib.sha256()
                for part in safe_parts(text, pattern=pattern):
                    ids = part_ids(enc, *part)
                    if ids:
                        h.update(((" " if n else "") + " ".join([decimal[i] for i in ids])).encode())
                    raw.update(enc.decode_bytes(ids))
                    n += len(ids)
                counts.append(n)
                of_ids.append(h.hexdigest())
                of_bytes.append(raw.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(np.asarray(counts, "i8")), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(text_col, F.lit(""))).mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
