"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A
text is parsed greedily into the longest phrases that the automaton knows; the fewer phrases
it takes, the closer the text is to the language. Phrases are counted per symbol, and the
language with the fewest wins, ties by name.

Labelled text is a bounded sample: of each language, the ``train_rows`` documents of lowest
hash outside the held-out fold, up to ``train_chars`` symbols. Every language that has a
labelled text is learned, and every letter of the sample has a symbol. Every document is parsed whole, in blocks of ``BLOCK``
symbols whose borders end a phrase for all languages alike. Texts are lower-cased, and runs
of anything but letters become one space.

Null texts and texts without a letter are ``und`` with score 0. With no language learned,
every text is ``und``. A text of symbols that no language knows goes by the tie rule. The
score is the winner's share of exp(-SHARP * phrases per symbol) over the languages.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, ship

BLOCK = 256
LANES = 8192
SHARP = 40.0
SPACE, OTHER = 0, 1
#: Bytes of transitions that are held as a plain table; the others are hashed. It moves work, not results.
DENSE = 64 << 20


@functools.lru_cache(maxsize=2)
def _letters(kinds: str = "LM") -> np.ndarray:
    """Which code points of the basic plane are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in kinds for c in range(0x10000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _is_letter(codes: np.ndarray, kinds: str = "LM") -> np.ndarray:
    found = _letters(kinds)[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        found[high] = [unicodedata.category(chr(c))[0] in kinds for c in codes[high]]
    return found


def normal(text: str) -> str:
    """Lower-cased, with one space for each run of anything but letters."""
    codes = _codes(text)
    letter = _is_letter(codes)
    first = np.ones(len(codes), dtype=bool)
    first[1:] = letter[:-1] | letter[1:]
    out = np.where(letter, codes, 32)[letter | (first & ~letter)] if len(codes) else codes
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Parser:
    """The automata of all languages: moves by the most frequent symbols in one table, the others hashed."""

    def __init__(self, texts: tuple[tuple[str, str], ...], max_symbols: int | None = None, dense: int = DENSE):
        self.languages = [name for name, _ in texts]
        seen = Counter(c for _, t in texts for c in t if c != " ")
        alphabet = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:max_symbols]]
        self.size = len(alphabet) + 2
        code = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": SPACE}
        kind = np.uint8 if self.size < 1 << 8 else np.uint16 if self.size < 1 << 16 else np.int32
        self.lut = np.where(_letters(), OTHER, SPACE).astype(kind)
        high = sorted((ord(c), i) for c, i in code.items() if ord(c) > 0xFFFF)
        self.high, self.high_symbols = np.array([c for c, _ in high], dtype=np.uint32), np.array([i for _, i in high], dtype=kind)
        for c, i in code.items():
            if ord(c) < 0x10000 and c != " ":
                self.lut[ord(c)] = i
        # states are numbered through all automata, of which one at a time is held as dictionaries
        parts, base, states = [np.zeros((0, 3), dtype=np.int64)], [], 0
        for _, t in texts:
            automaton = suffix_automaton([code.get(c, OTHER) for c in t])
            base.append(states)
            # an unknown letter matches nothing
            parts.append(np.array([(i, c, j) for i, m in enumerate(automaton) for c, j in m.items() if c != OTHER], dtype=np.int64).reshape(-1, 3) + [states, 0, states])
            states += len(automaton)
        rows = np.concatenate(parts)
        self.base = np.array(base, dtype=np.int32)
        self.root = self.base[:, None]
        self.near = min(self.size, max(2, dense // (4 * max(states, 1))))
        near = rows[:, 1] < self.near
        self.moves = np.full(states * self.near, -1, dtype=np.int32)
        self.moves[rows[near, 0] * self.near + rows[near, 1]] = rows[near, 2]
        self._hash(rows[~near, 0] * self.size + rows[~near, 1], rows[~near, 2])

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table of open addressing, half empty at least."""
        self.width = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.width, -1, dtype=np.int64), np.full(1 << self.width, -1, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1 & (1 << self.width) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.width)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, live, slot = np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys)), self._slot(keys)
        while len(live):
            there = self.keys[slot]
            hit = there == keys[live]
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            live, slot = live[on], slot[on] + 1 & (1 << self.width) - 1
        return out

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where states (..., n) go by symbols (n); -1 where there is no move."""
        if self.near == self.size:
            return self.moves[states * self.near + symbols]
        far = symbols >= self.near
        to = self.moves[states * self.near + np.where(far, OTHER, symbols)]
        if far.any():
            keys = states[..., far].astype(np.int64) * self.size + symbols[far]
            to[..., far] = self._find(keys.ravel()).reshape(keys.shape)
        return to

    def symbols(self, text: str) -> np.ndarray:
        """The symbols of a text, runs of spaces as one; empty if it has no letter."""
        codes = _codes(text)
        # marks alone are no letters
        if not _is_letter(codes, "L").any():
            return np.zeros(0, dtype=self.lut.dtype)
        out = self.lut[np.minimum(codes, 0xFFFF)]
        high = codes > 0xFFFF
        if high.any():
            own = codes[high]
            out[high] = np.where(_is_letter(own), OTHER, SPACE)
            if len(self.high):
                at = np.minimum(np.searchsorted(self.high, own), len(self.high) - 1)
                out[high] = np.where(self.high[at] == own, self.high_symbols[at], out[high])
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
        out = out[keep]
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text takes in each language (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        starts, sizes, owner, at = [], [], [], 0
        for i, t in enumerate(texts):
            for b in range(0, len(t), BLOCK):
                starts.append(at + b)
                sizes.append(min(BLOCK, len(t) - b))
                owner.append(i)
            at += len(t)
        if not starts:
            return out
        flat = np.concatenate(texts)
        starts, sizes, owner = np.array(starts), np.array(sizes), np.array(owner)
        by_size = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(by_size), LANES):
            own = by_size[lo : lo + LANES]
            np.add.at(out, owner[own], self._lanes(flat, starts[own], sizes[own]).T)
        return out

    def _lanes(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of blocks, longest first, (languages, blocks); all advance a symbol at a time."""
        count = np.zeros((len(self.languages), len(starts)), dtype=np.int32)
        state = np.repeat(self.root, len(starts), axis=1)
        for j in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -j, side="left"))
            symbol = flat[starts[:k] + j].astype(np.int32)
            now = state[:, :k]
            to = self.step(now, symbol)
            lang, lane = np.nonzero(to < 0)
            if len(lang):
                # a phrase ends before this symbol, unless none was begun
                begun = now[lang, lane] != self.base[lang]
                again = self.step(self.base[lang], symbol[lane])
                unknown = again < 0
                count[lang, lane] += begun.astype(np.int32) + unknown
                to[lang, lane] = np.where(unknown, self.base[lang], again)
            state[:, :k] = to
        return count + (state != self.root)


@functools.lru_cache(maxsize=2)
def parser(texts: tuple[tuple[str, str], ...], max_symbols: int | None) -> Parser:
    return Parser(texts, max_symbols)


def _normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(text=[normal(t) for t in pdf["text"]])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, train_rows: int = 40, train_chars: int = 12_000) -> tuple[tuple[str, str], ...]:
    """(language, labelled text) pairs, by name: a bounded sample outside the held-out fold."""
    ship(docs.sparkSession)
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != held_out)).select(
        F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("text")
    )
    # Spark limits each group in every task before it shuffles; texts follow only the chosen keys
    top = Window.partitionBy("lang").orderBy("h", "k")
    chosen = labelled.select("k", "lang", "h").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= train_rows).groupBy("k", "lang").agg(F.max("rank").alias("rank"))
    # train_rows rows of each language
    rows = labelled.join(F.broadcast(chosen), ["k", "lang"]).select("lang", "rank", F.left("text", F.lit(train_chars)).alias("text")).mapInPandas(_normalised, "lang string, rank int, text string").collect()
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["text"])):
        texts[r["lang"]] = (texts.get(r["lang"], "") + " " + r["text"].strip())[: train_chars + 1]
    return tuple(sorted((name, t) for name, t in texts.items() if t.strip()))


def predict(docs: DataFrame, model: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text", max_symbols: int | None = None) -> DataFrame:
    """Rows (key, lang_pred, score, phrases_per_symbol) for every document."""

    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, phrases_per_symbol double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        names, scores, rates = [], [], []
        p = parser(model, max_symbols) if model else None
        for lo in range(0, len(texts), 512):
            part = [p.symbols(t) if p and t else np.zeros(0, np.uint8) for t in texts.iloc[lo : lo + 512]]
            counts = p.phrases(part) if p else np.zeros((len(part), 0))
            for t, c in zip(part, counts):
                if not len(t):
                    names.append("und"), scores.append(0.0), rates.append(None)
                    continue
                rate = c / len(t)
                best = int(np.argmin(rate))
                share = np.exp(-SHARP * (rate - rate[best]))
                names.append(p.languages[best]), scores.append(float(1 / share.sum())), rates.append(float(rate[best]))
        return pd.DataFrame({"lang_pred": names, "score": scores, "phrases_per_symbol": pd.Series(rates, dtype="float64")})

    return docs.select(F.col(key), judge(F.col(text)).alias("p")).select(key, "p.*")
