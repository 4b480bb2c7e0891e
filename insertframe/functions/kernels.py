"""Alignment and circular-search kernels: numpy over Arrow batches."""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# workers need not have the package: what a kernel uses travels with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEG = -(1 << 28)
ORDER = "ARNDCQEGHILKMFPSTWYVBZX*"


@functools.lru_cache(maxsize=1)
def blosum62() -> np.ndarray:
    """Scores by byte of observed and of expected residue, either case; other letters score 0.

    The matrix is symmetric but for one cell: X against F scores -2, F against X -1.
    """
    lines = [x for x in (Path(__file__).parent / "blosum62.txt").read_text().splitlines() if not x.startswith("#")]
    table = np.zeros((256, 256), dtype=np.int8)
    for a, line in zip(ORDER, lines):
        for b, value in zip(ORDER, map(int, line.split())):
            for x in {a, a.lower()}:
                for y in {b, b.lower()}:
                    table[ord(x), ord(y)] = value
    return table


@dataclass(frozen=True)
class Scoring:
    gap_open: int
    gap_extend: int
    match: int | None = None
    mismatch: int | None = None
    table: np.ndarray | None = field(default=None, compare=False)

    def rows(self, a: np.ndarray, b: np.ndarray):
        """The substitution scores of b against each letter of a."""
        if self.match is None:
            return lambda i: self.table[a[i], b].astype(np.int64)
        return lambda i: np.where(b == a[i], self.match, self.mismatch)

    def columns(self, a: np.ndarray, b: np.ndarray):
        """The substitution scores of a against each letter of b."""
        if self.match is None:
            return lambda i: self.table[a, b[i]].astype(np.int64)
        return self.rows(b, a)


def protein_scoring(gap_open: int = -11, gap_extend: int = -1) -> Scoring:
    return Scoring(gap_open, gap_extend, table=blosum62())


def nucleotide_scoring(match: int = 2, mismatch: int = -3, gap_open: int = -5, gap_extend: int = -1) -> Scoring:
    return Scoring(gap_open, gap_extend, match, mismatch)


#: Rows between two that are kept when an alignment is filled.
EVERY = 256


def _next_row(state: tuple, i: int, of, o: int, e: int, at: np.ndarray, along: bool = False) -> tuple[tuple, np.ndarray]:
    """The three states of row ``i`` from those of the row above, and the way each cell is left by; of a
    gap up and one along the row that are equal the former, or the latter if ``along``."""
    best, up, left = state
    new_up = np.maximum(np.maximum(best, left) + o, up + e)
    new_best = np.full(len(at), NEG)
    new_best[1:] = np.maximum(np.maximum(best, up), left)[:-1] + of(i - 1)
    new_up[0] = new_best[0] = o + (i - 1) * e
    opened = np.maximum(new_best, new_up) + o
    new_left = np.full(len(at), NEG)
    new_left[1:] = np.maximum.accumulate(opened[:-1] - e * at[:-1]) + e * at[:-1]
    top = np.maximum(np.maximum(new_best, new_up), new_left)
    gap = np.where(top == new_left, 2, 1) if along else np.where(top == new_up, 1, 2)
    way = np.where(top == new_best, 0, gap).astype(np.uint8)
    way[0] = 1
    return (new_best, new_up, new_left), way


def self_aligned(x: np.ndarray, scoring: Scoring) -> int | None:
    """The score of a sequence against itself where that is known to be the diagonal, else None.

    Where each letter's score with itself is positive and above those with all others, half of both letters' own
    scores bounds any pair's, so a path that leaves the diagonal scores less, in every cell.
    """
    if scoring.gap_open >= 0 or scoring.gap_extend >= 0:
        return None
    if scoring.match is not None:
        return scoring.match * len(x) if scoring.match > max(scoring.mismatch, 0) else None
    seen = np.unique(x)
    pairs = scoring.table[np.ix_(seen, seen)].astype(np.int64)
    own = pairs.diagonal().copy()
    np.fill_diagonal(pairs, NEG)
    if len(seen) and (own.min() <= 0 or (pairs.max(axis=1) >= own).any() or (pairs.max(axis=0) >= own).any()):
        return None
    return int(scoring.table[x, x].astype(np.int64).sum())


def global_affine(a: str, b: str, scoring: Scoring) -> tuple[int, str, str, int, int, int]:
    """Global alignment with affine gaps: score, both aligned strings, matches, mismatches, gaps.

    Rows are filled as vectors; the gap along a row is a running maximum. The path follows, in
    each cell, the best of the three states (diagonal, then gap in b, then gap in a on ties)
    and not the state it came from, so the strings may score less than the score. One row in
    ``EVERY`` is kept; on the way back the rows between two are filled again, so memory grows with
    the shorter side times the square root of work, not with the product of both lengths. The rows are those of the
    shorter string: where that is ``b``, both change places, and so do the gaps and which of equal ones is taken.
    """
    x, y = np.frombuffer(a.encode("ascii", "replace"), np.uint8), np.frombuffer(b.encode("ascii", "replace"), np.uint8)
    if a == b and (own := self_aligned(x, scoring)) is not None:
        return own, a, b, len(a), 0, 0
    turned = len(y) < len(x)
    if turned:
        x, y = y, x
    n, m = len(x), len(y)
    o, e = scoring.gap_open, scoring.gap_extend
    at = np.arange(m + 1)
    edge = o + (at - 1) * e
    state = np.full(m + 1, NEG), np.full(m + 1, NEG), np.full(m + 1, NEG)
    state[0][0], state[0][1:], state[2][1:] = 0, edge[1:], edge[1:]
    of = scoring.columns(y, x) if turned else scoring.rows(x, y)
    kept = []
    for i in range(1, n + 1):
        if (i - 1) % EVERY == 0:
            kept.append(tuple(s.astype(np.int32) for s in state))
        state, _ = _next_row(state, i, of, o, e, at, turned)
    score = int(max(s[m] for s in state))
    out_a, out_b = [], []
    short, long = (b, a) if turned else (a, b)
    i, j, first, ways = n, m, n + 1, []
    while i or j:
        if i and i < first:
            first = (i - 1) // EVERY * EVERY + 1
            state, ways = tuple(s.astype(np.int64) for s in kept.pop()), []
            for k in range(first, i + 1):
                state, way = _next_row(state, k, of, o, e, at, turned)
                ways.append(way)
        step = 2 if i == 0 else 1 if j == 0 else ways[i - first][j]
        out_a.append(short[i - 1] if step != 2 else "-")
        out_b.append(long[j - 1] if step != 1 else "-")
        i, j = i - (step != 2), j - (step != 1)
    ra, rb = "".join(reversed(out_a)), "".join(reversed(out_b))
    if turned:
        ra, rb = rb, ra
    gaps = sum(p == "-" or q == "-" for p, q in zip(ra, rb))
    matches = sum(p == q and p != "-" for p, q in zip(ra, rb))
    return score, ra, rb, matches, len(ra) - gaps - matches, gaps


def identities(a: str, others: np.ndarray, lengths: np.ndarray, scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """Matches and mismatches of ``a`` against many sequences (rows of bytes, padded) at once.

    The same cells and ways as ``global_affine``, all sequences as a second axis. A cell's way does not
    depend on where the path came from, so the counts of the path that ends in a cell are carried
    along: no way is stored, and memory is a few rows.
    """
    x = np.frombuffer(a.encode("ascii", "replace"), np.uint8)
    p, m = others.shape
    o, e = np.int32(scoring.gap_open), np.int32(scoring.gap_extend)
    at = np.arange(m + 1, dtype=np.int32)
    slope = e * at
    shape = (p, m + 1)
    best, up, left = (np.full(shape, NEG, np.int32) for _ in range(3))
    best[:, 0], best[:, 1:], left[:, 1:] = 0, o + slope[:-1], o + slope[:-1]
    # aligned pairs in the upper half of a count, matches in the lower
    counts = np.zeros(shape, np.int64)
    one = np.int64(1) << 32
    own = {c: (scoring.table[c][others].astype(np.int32) if scoring.match is None else np.where(others == c, scoring.match, scoring.mismatch).astype(np.int32), (others == c) + one) for c in np.unique(x)}
    places = np.broadcast_to(at, shape)
    for i, c in enumerate(x, 1):
        scores, pair = own[c]
        new_up = np.maximum(np.maximum(best, left) + o, up + e)
        new_best = np.empty(shape, np.int32)
        np.maximum(np.maximum(best, up), left, out=best)
        new_best[:, 1:] = best[:, :-1] + scores
        new_up[:, 0] = new_best[:, 0] = o + (i - 1) * e
        top = np.maximum(new_best, new_up)
        left = np.empty(shape, np.int32)
        left[:, 0] = NEG
        left[:, 1:] = np.maximum.accumulate(top[:, :-1] + o - slope[:-1], axis=1) + slope[:-1]
        diagonal, above = new_best >= np.maximum(new_up, left), new_up >= left
        diagonal[:, 0], above[:, 0] = False, True
        # the counts of a cell that is left along the row are those of the last that is not
        along = np.empty(shape, np.int64)
        along[:, 1:] = counts[:, :-1] + pair
        along[:, 0] = counts[:, 0]
        counts = np.where(diagonal, along, counts)
        last = np.maximum.accumulate(np.where(diagonal | above, places, 0), axis=1)
        counts = np.take_along_axis(counts, last, axis=1)
        best, up = new_best, new_up
    end = counts[np.arange(p), lengths]
    return (end & (one - 1)), (end >> 32) - (end & (one - 1))


ALIGNMENT = "score int, aligned_a string, aligned_b string, matches int, mismatches int, gaps int"


def align(a: Column, b: Column, scoring: Scoring) -> Column:
    """Alignment struct of two columns; null where either is, without any work."""

    @F.pandas_udf(ALIGNMENT)
    def of(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, str], tuple] = {}
        rows = []
        for x, y in zip(left, right):
            if x is None or y is None:
                rows.append((None,) * 6)
                continue
            if (x, y) not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[x, y] = global_affine(x, y, scoring)
            rows.append(seen[x, y])
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNMENT.split(", ")], dtype=object)
        return out.astype({c: "Int32" for c in ("score", "matches", "mismatches", "gaps")})

    return of(a, b)


def identity(al: Column, with_gaps: bool = False) -> Column:
    total = al["matches"] + al["mismatches"] + (al["gaps"] if with_gaps else F.lit(0))
    return F.when(al.isNotNull(), F.when(total == 0, F.lit(0.0)).otherwise(al["matches"] / F.greatest(total, F.lit(1))))


#: Sequences that are aligned at once.
TOGETHER = 64


def closest(query: Column, others: Column, keys: Column, below: Column, scoring: Scoring) -> Column:
    """A struct (loss, key): of a list of sequences with keys, the one of highest identity (gaps left out) to the
    query, the least key on ties; loss is less the identity. Where ``below`` is not null, only keys less than
    it are looked at. Null where there is none."""

    @F.pandas_udf("loss double, key string")
    def of(queries: pd.Series, lists: pd.Series, names: pd.Series, limits: pd.Series) -> pd.DataFrame:
        rows = []
        for q, list_, own, limit in zip(queries, lists, names, limits):
            found = sorted(((k, s) for k, s in zip(own, list_) if limit is None or k < limit), key=lambda x: len(x[1]))
            best = (None, None)
            for i in range(0, len(found), TOGETHER):
                part = found[i : i + TOGETHER]
                lengths = np.array([len(s) for _, s in part])
                block = np.zeros((len(part), max(int(lengths.max()), 1)), np.uint8)
                for k, (_, s) in enumerate(part):
                    block[k, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
                matches, mismatches = identities(q, block, lengths, scoring)
                loss = -matches / np.maximum(matches + mismatches, 1)
                least = min((float(x), k) for x, (k, _) in zip(loss, part))
                best = least if best[0] is None else min(best, least)
            rows.append(best)
        return pd.DataFrame(rows, columns=["loss", "key"], dtype=object).astype({"loss": "Float64"})

    return of(query, others, keys, below)


# --------------------------------------------------------------------------- searches

def _hits(text: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Equal letters at each offset, a bounded slice of offsets at a time."""
    windows = np.lib.stride_tricks.sliding_window_view(text, len(query))
    step = max(1, (1 << 22) // len(query))
    return np.concatenate([(windows[i : i + step] == query).sum(axis=1) for i in range(0, len(windows), step)])


def best_ungapped_identity(query: str, subject: str) -> float:
    if not query or len(query) > len(subject):
        return 0.0
    q, s = np.frombuffer(query.encode(), np.uint8), np.frombuffer(subject.encode(), np.uint8)
    return int(_hits(s, q).max()) / len(q)


def place(text: str, landmark: str) -> int:
    """The first circular offset at which the landmark stands letter by letter, -1 where there is none."""
    if not 0 < len(landmark) <= len(text):
        return -1
    if (at := text.find(landmark)) >= 0:
        return at
    lap = len(landmark) - 1  # what goes over the end begins among the last letters
    at = (text[len(text) - lap :] + text[:lap]).find(landmark)
    return at + len(text) - lap if at >= 0 else -1


def circular_search(text: str, landmark: str) -> tuple[float, int | None]:
    """The landmark's best identity at any circular offset of the text, and the first such offset.

    A landmark longer than the text is the text searched in, and has no offset.
    """
    if not text or not landmark:
        return 0.0, None
    if len(landmark) > len(text):
        return best_ungapped_identity(text, landmark), None
    # no offset is better than the first at which all letters are equal
    if (at := place(text, landmark)) >= 0:
        return 1.0, at
    circle = text + text[: len(landmark) - 1]
    t, q = np.frombuffer(circle.encode(), np.uint8), np.frombuffer(landmark.encode(), np.uint8)
    hits = _hits(t, q)
    at = int(hits.argmax())
    return int(hits[at]) / len(q), at


_PAIRS = str.maketrans("ATUGC", "TAACG")


def reverse_complement(s: str) -> str:
    return s.translate(_PAIRS)[::-1]


def normalize(text: str, landmark: str) -> tuple[str, bool, int]:
    """The better strand, rotated so that the landmark is first: sequence, reversed, rotation."""
    if (at := place(text, landmark)) >= 0:
        return text[at:] + text[:at], False, at
    back = reverse_complement(text)
    # a strand that has it letter by letter is the better one: no offset of the other is compared
    if (at := place(back, landmark)) >= 0:
        return back[at:] + back[:at], True, at
    forward, reverse = circular_search(text, landmark), circular_search(back, landmark)
    flipped = reverse[0] > forward[0]
    own, at = (back, reverse[1]) if flipped else (text, forward[1])
    at = at or 0
    return own[at:] + own[:at], flipped, at


def normalize_circular(text: Column, landmark: Column) -> Column:
    @F.pandas_udf("sequence string, reverse_complemented boolean, rotation int")
    def of(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None or k is None else normalize(t, k) for t, k in zip(texts, marks)]
        out = pd.DataFrame(rows, columns=["sequence", "reverse_complemented", "rotation"], dtype=object)
        return out.astype({"reverse_complemented": "boolean", "rotation": "Int32"})

    return of(text, landmark)


def circular_identity(text: Column, landmark: Column) -> Column:
    @F.pandas_udf("identity double, offset int")
    def of(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None or k is None else circular_search(t, k) for t, k in zip(texts, marks)]
        return pd.DataFrame(rows, columns=["identity", "offset"], dtype=object).astype({"identity": "Float64", "offset": "Int32"})

    return of(text, landmark)


def closest_mark(text: str, marks: list[str]) -> tuple[int, float]:
    """The landmark of best identity on either strand, the first of equal ones. One that is there letter by letter
    has the highest there is, so others are searched for only where there is none."""
    strands = text, reverse_complement(text)
    for k, mark in enumerate(marks):
        if text and mark and any(place(s, mark) >= 0 if len(mark) <= len(s) else s in mark for s in strands):
            return k, 1.0
    scores = [max(circular_search(s, mark)[0] for s in strands) for mark in marks]
    best = int(np.argmax(scores))
    return best, scores[best]


def orient(text: Column, vectors: list[tuple[str, str, str]]) -> Column:
    """Which vector (id, landmark, leader) a read comes from, by either strand's best landmark
    identity, the first of equal ones; and the read normalised on that vector's leader."""

    @F.pandas_udf("vector_id string, identity double, sequence string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None or not vectors:
                rows.append((None, None, t))
                continue
            best, score = closest_mark(t, [mark for _, mark, _ in vectors])
            rows.append((vectors[best][0], score, normalize(t, vectors[best][2])[0]))
        return pd.DataFrame(rows, columns=["vector_id", "identity", "sequence"], dtype=object).astype({"identity": "Float64"})

    return of(text)


def gc_shares(cleaned: str, window: int) -> tuple[float, float]:
    """The GC share of a sequence in capitals, and the largest of any window; that of the whole where it fits no window."""
    x = np.frombuffer(cleaned.encode("ascii", "replace"), np.uint8)
    sums = np.concatenate([[0], np.cumsum((x == 71) | (x == 67))])
    whole = int(sums[-1]) / max(len(x), 1)
    return whole, int((sums[window:] - sums[:-window]).max()) / window if len(x) > window > 0 else whole


def max_window_gc(cleaned: Column, window: int) -> Column:
    """The largest GC share of any window of sequences in capitals; the share of the whole where it fits no window."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else gc_shares(t, window)[1] for t in texts], dtype="Float64")

    return of(cleaned)


def gc_over(cleaned: Column, most: float, window: int, most_in_window: float) -> Column:
    """Whether the GC share of sequences in capitals, or of a window of them, is over its limit."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        shares = [None if t is None else gc_shares(t, window) for t in texts]
        return pd.Series([None if s is None else s[0] > most or s[1] > most_in_window for s in shares], dtype="boolean")

    return of(cleaned)


@dataclass(frozen=True)
class Code:
    """A genetic code for bytes: a letter's number from 0 to 4, and a codon's residue."""

    letters: np.ndarray
    residues: np.ndarray

    def frames(self, cleaned: str) -> list[str]:
        """The proteins of the three forward frames."""
        x = self.letters.astype(np.uint8)[np.frombuffer(cleaned.encode("ascii", "replace"), np.uint8)]
        codons = self.residues[25 * x[:-2] + 5 * x[1:-1] + x[2:]] if len(x) > 2 else self.residues[:0]
        return [codons[f::3].tobytes().decode() for f in range(3)]

    def first_frame(self, cleaned: str) -> str:
        """The protein of the first frame alone, a byte a letter."""
        return self._first(np.frombuffer(cleaned.encode("ascii", "replace"), np.uint8))

    def first_of(self, raw: str) -> str:
        """The same of any text: other characters than ASCII letters are left out, and either case taken."""
        x = np.frombuffer(raw.encode("ascii", "replace"), np.uint8)
        small = x | 32
        kept = (small >= 97) & (small <= 122)
        return self._first((x if kept.all() else x[kept]) & 0xDF)

    def _first(self, capitals: np.ndarray) -> str:
        x = self.letters.astype(np.uint8)[capitals]
        n = len(x) - len(x) % 3
        return self.residues[25 * x[:n:3] + 5 * x[1:n:3] + x[2:n:3]].tobytes().decode()


def protein(cleaned: Column, code: Code) -> Column:
    """The translation of sequences in capitals, in the first frame."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else code.first_frame(t) for t in texts], dtype=object)

    return of(cleaned)


def protein_to_stop(raw: Column, code: Code) -> Column:
    """The translation of any text up to its first stop, in the first frame."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else code.first_of(t).split("*", 1)[0] for t in texts], dtype=object)

    return of(raw)


def best_frame(cleaned: Column, code: Code) -> Column:
    """Of three forward frames the longest protein before a stop, the lowest frame on ties."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else max((p.split("*", 1)[0] for p in code.frames(t)), key=len) for t in texts], dtype=object)

    return of(cleaned)


def orf_from(cleaned: Column, probe: Column, code: Code) -> Column:
    """The translation from the earliest probe in any forward frame, by residue and then by frame; frame 0 from
    the start where there is none."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, probes: pd.Series) -> pd.Series:
        out = []
        for t, probe in zip(texts, probes):
            frames = None if t is None else code.frames(t)
            hits = [] if t is None or probe is None else [(at, f) for f, p in enumerate(frames) if len(t) > f and (at := p.find(probe)) >= 0]
            at, f = min(hits, default=(0, 0))
            out.append(None if t is None else frames[f][at:])
        return pd.Series(out, dtype=object)

    return of(cleaned, probe)
