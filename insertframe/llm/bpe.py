"""BPE encoding by backtracking, and decoding by an offset table.

A vocabulary file (the JSON of a byte-level BPE model with word ends) gives tokens and ranked
merges. A text is cut at the strings of special tokens; the pieces between are put into NFC and
lower case, split into words, and each word is encoded:

* An Aho-Corasick automaton over all tokens that encode to themselves runs once over the word's
  bytes and tells the longest token that begins at each place; a table leads from a token to
  its longest proper prefix that is a token.
* Two neighbouring tokens are compatible if merging their bytes together leaves the border between
  them. A sequence of tokens is what the merges give if and only if all neighbours are compatible, so
  each beginning of a word has one encoding. The encoder takes the longest token that is
  compatible with the one before; where none is, the place is dead, is never tried again, and
  the last token gives way to its longest prefix. Each place dies once: linear time.
* Compatibility is looked up in a table of pairs that fills as pairs are met (at most
  ``PAIRS`` entries; a full one is emptied, which changes no result).

Decoding joins the tokens' strings with spaces, word ends included: one array holds all of them one
after another, an offset table says where each begins, and a text is gathered in one step.

Ids are packed, four bytes each, little-endian: ``unpack`` gives arrays. Null text is an empty one
and has no ids; null ids decode to an empty text. Ids beyond the vocabulary have no string and are
left out. Rows that repeat, or repeat a key, are each encoded; other columns stay as they are, but one that has
the name of the result is replaced. An empty table gives an empty one. A text is encoded as a
whole, however long it is; words of over ``LONG`` bytes are not remembered.

The vocabulary is read on the driver and broadcast: its size is that of the file, whatever the data.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, unused

#: Entries that the tables of pairs and of words hold at most.
PAIRS, WORDS = 1 << 20, 1 << 18
#: Bytes of a word that is remembered at most.
LONG = 64
#: Stands for the end of a word behind its bytes, which are characters of up to U+00FF.
END = "Ā"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """Tokens' strings by id, ranked merges (left, right, made) of ids, strings of special tokens with
    their ids, the pattern of words, the mark of a word's end, and the file's text, which the
    tokenizers library can read."""

    strings: list[str]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    pattern: str
    suffix: str
    source: str


def load(path: str) -> Vocabulary:
    """Reads a vocabulary file; raises ValueError for one of another kind."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    data = json.loads(source)
    model, norm, split = data["model"], data.get("normalizer") or {}, data.get("pre_tokenizer") or {}
    steps = [x["type"] for x in norm.get("normalizers", [])]
    parts = split.get("pretokenizers", [])
    fits = (
        model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["invert"]
        and parts[0]["behavior"] == "Removed"
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and not data.get("decoder")
    )
    if not fits:
        raise ValueError(f"{path}: not a lower-casing byte-level BPE vocabulary with word ends")
    ids = model["vocab"]
    special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
    strings = [""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in [*ids.items(), *special.items()]:
        strings[i] = text
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    return Vocabulary(strings, merges, special, parts[0]["pattern"]["Regex"], model["end_of_word_suffix"], source)


class Merges:
    """The merges of a vocabulary: what is made of which pair, and when."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(vocabulary.merges)}
        self.parts = {made: (a, b) for a, b, made in vocabulary.merges}
        self.born = [-1] * len(vocabulary.strings)
        for k, (a, b, made) in enumerate(vocabulary.merges):
            self.born[made] = k
            if max(self.born[a], self.born[b]) >= k:
                raise ValueError("a merge stands before those that make its parts")

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when the bytes of both tokens are merged together.

        Time runs backwards: the token at each side of the border is taken apart, the later born
        first, and a merge of the two that stand there together must not come before the
        next event of either. Of merges with one rank the left one comes first.
        """
        never = len(self.rank)
        left_ends = right_ends = never
        while True:
            k = self.rank.get((left, right), never)
            if k < left_ends and k <= right_ends and k < never:
                return False
            if self.born[left] < 0 and self.born[right] < 0:
                return True
            if self.born[left] > self.born[right]:
                left_ends, left = self.born[left], self.parts[left][1]
            else:
                right_ends, right = self.born[right], self.parts[right][0]


class Encoder:
    """Encodes texts with the tables described above."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges = Merges(vocabulary)
        self.n = len(vocabulary.strings)
        forms = self._forms(vocabulary)
        self.length = [0] * self.n
        self.shorter = [-1] * self.n
        self.automaton = ahocorasick.Automaton()
        # a token whose own bytes merge to something else is in no encoding
        whole: dict[str, int] = {}
        for made in sorted(forms, key=lambda i: self.merges.born[i]):
            a, b = self.merges.parts.get(made, (-1, -1))
            if a < 0 or (forms[a] in whole and forms[b] in whole and self._own(a, b, made)):
                whole[forms[made]] = made
        for form, i in whole.items():
            self.length[i] = len(form)
            self.shorter[i] = next((whole[form[:k]] for k in range(len(form) - 1, 0, -1) if form[:k] in whole), -1)
            self.automaton.add_word(form, (i, len(form)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.cut = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or "(?!)")
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in vocabulary.special.items()}
        self.words = regex.compile(vocabulary.pattern).findall
        self.source = vocabulary.source
        self.library = None

    def _forms(self, v: Vocabulary) -> dict[int, str]:
        """Tokens by id as characters of their bytes, with END where a word ends."""
        letters, out = byte_letters(), {}
        made = {m for _, _, m in v.merges}
        for i, text in enumerate(v.strings):
            if text in v.special or i in made or not text:
                continue
            if text in letters:
                out[i] = chr(letters[text])
            elif text.endswith(v.suffix) and text[: -len(v.suffix)] in letters:
                out[i] = chr(letters[text[: -len(v.suffix)]]) + END
        for a, b, m in v.merges:
            out[m] = out[a] + out[b]
        return out

    def _own(self, a: int, b: int, made: int) -> bool:
        """Whether nothing merges across the border of a token's parts before they are merged."""
        rank, self.merges.rank[(a, b)] = self.merges.rank[(a, b)], len(self.merges.rank)
        try:
            return self.merges.compatible(a, b)
        finally:
            self.merges.rank[(a, b)] = rank

    def _fits(self, a: int, b: int) -> bool:
        key = a * self.n + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merges.compatible(a, b)
        return known

    def word(self, form: str) -> list[int]:
        """The ids of a word, given as the characters of its bytes with END."""
        longest = [-1] * len(form)
        for end, (i, n) in self.automaton.iter(form):
            longest[end + 1 - n] = i  # later ends are longer
        length, shorter, fits = self.length, self.shorter, self._fits
        out: list[int] = []
        dead, at, i = bytearray(len(form) + 1), 0, longest[0]
        while True:
            while i >= 0 and (dead[at + length[i]] or (out and not fits(out[-1], i))):
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += length[i]
                if at == len(form):
                    return out
                i = longest[at]
            elif not out:
                raise ValueError(f"the vocabulary has no tokens for {form!r}")
            else:
                dead[at] = 1
                at -= length[out[-1]]
                i = shorter[out.pop()]

    def remember(self, word: str) -> bytes:
        """The packed ids of a word that isn't remembered yet."""
        form = word.encode("utf-8", "surrogatepass").decode("latin-1") + END
        own = self.word(form)
        ids = struct.pack(f"<{len(own)}I", *own)
        if len(form) <= LONG:
            if len(self.packed) >= WORDS:
                self.packed.clear()
            self.packed[word] = ids
        return ids

    def piece(self, text: str) -> bytes:
        """The packed ids of a text without special tokens."""
        if text.isascii():
            words = self.words(text.lower())
        elif any(map(differs, set(text))):
            words = self._by_library(text)
        else:
            # lower case letter by letter: a sigma at a word's end is like any other
            words = self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known, missing = self.packed.get, self.remember
        return b"".join([known(w) or missing(w) for w in words])

    def _by_library(self, text: str) -> list[str]:
        """Words of a text with characters of which tables differ."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library, self.letters = Tokenizer.from_str(self.source), byte_letters()
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in w).decode("utf-8") for w, _ in found]

    def text(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        if not text:
            return b""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.piece(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        out.append(self.piece(text[at:]) if at else self.piece(text))
        return b"".join(out)


@cache
def differs(c: str) -> bool:
    """Whether Python's and the library's tables may know a character differently: it is unassigned
    here, or a mark or composition that came after Unicode 3.2."""
    kind = unicodedata.category(c)
    late = unicodedata.ucd_3_2_0.category(c) == "Cn"
    return kind == "Cn" or late and (kind[0] == "M" or unicodedata.decomposition(c) != "")


class Decoder:
    """Decodes packed ids by an offset table over all tokens' strings, a space after each."""

    def __init__(self, vocabulary: Vocabulary):
        rows = [f"{s} ".encode() if s else b"" for s in vocabulary.strings]
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def text(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4")
        ids = ids[ids < len(self.offset) - 1]
        start, length = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(length)
        if not len(ids) or not ends[-1]:
            return ""
        # a token's bytes lie one after another: where it begins less where it goes to, and a count
        at = np.repeat(start - (ends - length), length) + np.arange(ends[-1])
        return self.bytes[at][:-1].tobytes().decode("utf-8")


#: Tables of this worker by the file's text: a worker makes them once.
_made: dict[tuple[str, int], object] = {}


def _of(kind, vocabulary: Vocabulary):
    key = (kind.__name__, hash(vocabulary.source))
    if key not in _made:
        _made[key] = kind(vocabulary)
    return _made[key]


#: Rows that are Python objects at a time.
ROWS = 256


def _in_slices(batches: Iterator[pa.Array], work: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """A batch may hold 10,000 texts: its rows become objects, and results go, a slice at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield work(batch.slice(at, ROWS).to_pylist())


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """The table with the packed ids of each whole text in column ``into``.

    With ``decoded``, a column of that name has what the ids decode to: made by the same worker
    from the packed ids, so that they needn't be sent to a second one.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _of(Encoder, sent.value)
        yield from _in_slices(batches, lambda texts: pa.array([encoder.text(t) for t in texts], pa.binary()))

    def encode_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _of(Encoder, sent.value), _of(Decoder, sent.value)

        def work(texts: list) -> pa.Array:
            ids = [encoder.text(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([decoder.text(x) for x in ids], pa.string())], ["ids", "decoded"])

        yield from _in_slices(batches, work)

    own = F.col(text).cast("string")
    if decoded is None:
        return docs.withColumn(into, F.arrow_udf(encode, "binary")(own))
    both, *_ = unused(docs, 1)
    return docs.withColumn(both, F.arrow_udf(encode_and_back, "struct<ids:binary,decoded:string>")(own)).withColumns({into: F.col(f"{both}.ids"), decoded: F.col(f"{both}.decoded")}).drop(both)


def decode_documents(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The table with the text that each row's packed ids stand for in column ``into``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _of(Decoder, sent.value)
        yield from _in_slices(batches, lambda packed: pa.array([decoder.text(x) for x in packed], pa.string()))

    return docs.withColumn(into, F.arrow_udf(decode, "string")(F.col(ids)))


def count(ids: Column) -> Column:
    """How many ids are packed."""
    return F.floor(F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")


def unpack(ids: Column) -> Column:
    """Packed ids as an array of longs; none for null."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, 4 * i + k + 1, 1)), 16, 10).cast("long")
    at = F.sequence(F.lit(0), count(ids).cast("int") - 1)
    some = F.transform(at, lambda i: byte(i, 0) + 256 * byte(i, 1) + 65536 * byte(i, 2) + 16777216 * byte(i, 3))
    return F.when(count(ids) > 0, some).otherwise(F.array().cast("array<long>"))
