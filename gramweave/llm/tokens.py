"""Tokenizers of the tokenizers and sentencepiece libraries, read once a worker, for texts in batches.

A tokenizer that turns white space into a space and drops it from its pieces gives each word between ASCII white space the
tokens it would have alone, and each piece of its own pattern those of that piece, so such a tokenizer encodes words
and pieces once for many texts and remembers the pieces. Others get whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of words that a worker remembers in each of two generations, and the longest of them; longer ones are encoded each time they come.
MOST_PIECES, LONGEST = 200_000, 48
#: Bytes of text whose words are looked up together, and pieces that are encoded together.
AT_ONCE, TOGETHER = 8_000_000, 512
#: Words that lower-casing and composing treat letter by letter, alike in Python and in the library.
PLAIN = r"[\x21-\x7e\xa1-\xff]+"
#: Most of these: letters, then punctuation, a piece each.
SIMPLE = r"^(?P<stem>[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<tail>[!-/:-@\[-`{-~]*)$"

_open: dict[str, Encoder] = {}


def drops_space(rules: dict) -> bool:
    """Whether the file of a tokenizer says that white space ends up between the pieces and never in them."""
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in steps and all(s["type"] in ("NFC", "Replace", "Lowercase") for s in steps)
    pieces = first.get("pattern", {}).get("Regex", " ")
    plain = all(len(a["content"].split()) == 1 and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in rules.get("added_tokens", []))
    return spaces and plain and first.get("behavior") == "Removed" and first.get("invert") is True and pieces.endswith("[^\\s\\p{L}\\p{N}]+") and " " not in pieces


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each entry begin (one more than entries), and all ids."""
    sizes = np.fromiter(map(len, ids), "i8", len(ids)) // 4
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(ids), dtype="<u4")


def gathered(ends: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the entries at the places `at`."""
    sizes = np.diff(ends)[at]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return out, values[np.repeat(ends[:-1][at] - out[:-1], sizes) + np.arange(out[-1])]


class Memory:
    """A table of the latest entries: when it is full it becomes the older generation, from which entries return as they are asked for."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that are in neither generation; the others are young afterwards."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        away = keys - self.young.keys()
        back = away & self.old.keys()
        self.young.update((k, self.old[k]) for k in back)
        return list(away - back)


class Encoder:
    """Encodes texts to ids as the library does by default, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known = Memory(MOST_PIECES)
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: own.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self._ids = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            self.by_word = drops_space(rules)
            if self.by_word:
                import regex

                self.piece = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ")
                mark = rules["model"].get("end_of_word_suffix") or "\0"
                vocabulary = own.get_vocab(with_added_tokens=True)
                self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, dtype="<u4").tobytes() for i in range(0, len(texts), 64) for ids in self._ids(texts[i : i + 64])]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (little-endian unsigned 32 bits), one after the other, and where each text's begin (one more than texts)."""
        ends, values, at = [np.zeros(1, "i8")], [], 0
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        while at < len(texts):
            n = max(1, int(np.searchsorted(sizes[at + 1 :], sizes[at] + AT_ONCE, "right")))
            own, ids = (self._by_word if self.by_word else self._by_text)(texts.slice(at, n))
            ends.append(own[1:] + ends[-1][-1])
            values.append(ids)
            at += n
        return np.concatenate(ends), np.concatenate(values) if values else np.zeros(0, "<u4")

    def _by_text(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        return joined(self._encode(texts.to_pylist()))

    def _by_word(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)  # an empty word at an end of a text has no ids
        coded = lists.flatten().dictionary_encode()
        ends, values = gathered(*self._words(coded.dictionary), coded.indices.to_numpy())
        cuts = lists.offsets.to_numpy()
        return ends[cuts - cuts[0]], values

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, and where each word's begin."""
        simple = pc.extract_regex(words, SIMPLE)
        held = simple.is_valid()
        others = words.filter(pc.invert(held))
        plain = pc.and_not(pc.match_substring_regex(others, f"^{PLAIN}$"), pc.match_substring(others, "<|"))
        simple = simple.filter(held)
        cut = pa.array(self.piece.findall(" ".join(others.filter(plain).to_pylist()).lower()), pa.string())
        pieces = pa.concat_arrays([pc.utf8_lower(simple.field("stem")), simple.field("tail"), cut]).dictionary_encode()
        known, at, n = joined(self._pieces(pieces.dictionary.to_pylist())), pieces.indices.to_numpy(), len(simple)
        ends, values = gathered(*known, np.stack([at[:n], at[n : 2 * n]], axis=1).ravel())
        cut_ends, cut_values = gathered(*known, at[2 * n :])
        spaces = np.flatnonzero(at[2 * n :] == pc.index(pieces.dictionary, " ").as_py())
        rare_ends, rare_values = joined(self._encode(others.filter(pc.invert(plain)).to_pylist()))
        held, plain = (x.to_numpy(zero_copy_only=False) for x in (held, plain))
        some = [[0], spaces, [len(cut)]] if plain.any() else [[0]]
        groups = ((np.flatnonzero(held), ends[::2], values), (np.flatnonzero(~held)[plain], cut_ends[np.concatenate(some).astype("i8")], cut_values), (np.flatnonzero(~held)[~plain], rare_ends, rare_values))
        sizes, starts, base = np.zeros(len(words), "i8"), np.zeros(len(words), "i8"), 0
        for at, own, ids in groups:
            sizes[at], starts[at] = np.diff(own), base + own[:-1]
            base += len(ids)
        out = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([ids for _, _, ids in groups])
        return out, flat[np.repeat(starts - out[:-1], sizes) + np.arange(out[-1])]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; none for a space or nothing."""
        new = self.known.missing({p for p in pieces if p and p != " "})
        self._learn(new)
        known = self.known.young
        known[""] = known[" "] = b""
        out = [known[p] for p in pieces]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces, many in a text: the last token of a piece has the mark for the end of a word."""
        for i in range(0, len(pieces), TOGETHER):
            part = pieces[i : i + TOGETHER]
            ids = np.asarray(self._ids([" ".join(part)])[0], dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw = ids.tobytes()
                at = [0, *(4 * ends).tolist()]
                self.known.young.update((p, raw[a:b]) for p, a, b in zip(part, at, at[1:], strict=False))
            else:
                self.known.young.update(zip(part, self._encode(part), strict=True))


def encoder(path: str) -> Encoder:
    """The encoder of this worker for the tokenizer at path."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
