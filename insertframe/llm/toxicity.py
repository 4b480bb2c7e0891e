"""Toxicity: a counterfactually regularised classifier.

Logistic regression over the words of a text and the beginnings of its words, each by
whether it occurs once, twice, three times or more. Labelled texts that mention
a group get counterfactual twins, the same words with every identity term replaced by
another of its set; training penalises the squared difference of the two scores, so a mention
of one group rather than another can't move a score, and neutral mentions stop counting.

The labelled sample is bounded (``max_rows`` rows of lowest hash of their key), its texts
are cut to word counts on the executors, and only those reach the driver. Every document is
scored whole. Null or empty text gets the model's score for no words. Without any labelled
row, or with one class only, the score is the rate of toxic rows in the sample (0 if none).
Rows with a null label teach nothing. Labels of one document that disagree all count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship

#: Sets of identity terms that may stand for one another in a sentence.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled", "autistic"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)

_BREAK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

#: A feature is a word, or a word's first bytes after a caret, that occurs at least 1, 2 or 3 times.
LEVELS = 3
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers at once.
REMEMBERED = 300_000

Feature = tuple[bytes, int]


def word_counts(text: str | None) -> Counter:
    """The lower-case words of a text, without ASCII punctuation, counted."""
    return Counter((text or "").lower().encode("utf-8", "replace").translate(_BREAK).split())


def names_of(word: bytes) -> list[bytes]:
    """What a word counts for: itself and its beginnings."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) >= k)]


def features_of(counts: Counter) -> set[Feature]:
    total: Counter = Counter()
    for word, n in counts.items():
        for name in names_of(word):
            total[name] += n
    return {(name, level) for name, n in total.items() for level in range(1, min(n, LEVELS) + 1)}


def swaps(sets: tuple[tuple[str, ...], ...] = IDENTITY_SETS) -> dict[bytes, bytes]:
    """Each identity term with the next of its set."""
    return {a.encode(): b.encode() for s in sets for a, b in zip(s, s[1:] + s[:1])}


class Model:
    """A bias and the weights of features."""

    def __init__(self, bias: float, weights: dict[Feature, float] | None = None):
        self.bias, self.weights = bias, weights or {}
        self.known = {name for name, _ in self.weights}
        self._seen: dict[bytes, tuple[bytes, ...]] = {}

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def score(self, text: str | None) -> float:
        total: dict[bytes, int] = {}
        seen = self._seen
        for word, n in word_counts(text).items():
            names = seen.get(word)
            if names is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                names = seen[word] = tuple(x for x in names_of(word) if x in self.known)
            for name in names:
                total[name] = total.get(name, 0) + n
        z = self.bias + math.fsum(self.weights.get((name, level), 0.0) for name, n in total.items() for level in range(1, min(n, LEVELS) + 1))
        return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def _select(docs: list[bytes], y: np.ndarray, min_rows: int, max_features: int, always: set[Feature]) -> list[Feature]:
    """The features that tell the classes apart best, by the z-score of their log odds."""
    pos, neg = Counter(), Counter()
    for words, label in zip(docs, y):
        (pos if label else neg).update(features_of(Counter(words.split())))
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    ranked = []
    for f in pos.keys() | neg.keys():
        a, b = pos[f], neg[f]
        if a + b >= min_rows:
            odds = math.log((a + 0.5) / (n_pos - a + 0.5)) - math.log((b + 0.5) / (n_neg - b + 0.5))
            z = abs(odds) / math.sqrt(1 / (a + 0.5) + 1 / (n_pos - a + 0.5) + 1 / (b + 0.5) + 1 / (n_neg - b + 0.5))
            ranked.append((-z, f))
    chosen = [f for z, f in sorted(ranked)[:max_features] if z <= -2.5]
    return sorted(set(chosen) | (always & (pos.keys() | neg.keys())))


def fit(docs: list[bytes], labels: list[int], penalty: float = 5.0, l2: float = 0.3, max_features: int = 2048, min_rows: int = 3, steps: int = 300, terms: dict[bytes, bytes] | None = None) -> Model:
    """Gradient descent (Adam, full batch, fixed start: deterministic) on
    log loss + l2 |w|^2 / n + penalty * mean((score - score of the twin)^2), scores as log odds.

    ``docs`` are words joined by spaces. Features are made a text at a time, so memory holds the
    texts and the counts of features, not the features of every text.
    """
    terms = swaps() if terms is None else terms
    y = np.array([1.0 if v else 0.0 for v in labels])
    if len(y) == 0 or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(math.log(rate / (1 - rate)))

    def twin_of(words: bytes) -> bytes:
        return b" ".join(terms.get(w, w) for w in words.split())

    mention = [i for i, d in enumerate(docs) if not terms.keys().isdisjoint(d.split())]
    vocabulary = {f: i for i, f in enumerate(_select(docs, y, min_rows, max_features, {(t, 1) for t in terms}))}
    for f in sorted({(terms[w], 1) for i in mention for w in docs[i].split() if w in terms}):  # terms that only twins have
        vocabulary.setdefault(f, len(vocabulary))

    def sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [(i, j) for i, t in enumerate(texts) for j in sorted(vocabulary[f] for f in features_of(Counter(t.split())) & vocabulary.keys())]
        pairs = np.array(rows, dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    r, c = sparse(docs)
    a_r, a_c = sparse([docs[i] for i in mention])
    b_r, b_c = sparse([twin_of(docs[i]) for i in mention])
    n, m = len(vocabulary), len(mention)
    w, bias = np.zeros(n), math.log(y.mean() / (1 - y.mean()))
    state = [np.zeros(n + 1), np.zeros(n + 1)]
    for t in range(1, steps + 1):
        z = bias + np.bincount(r, w[c], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        grad = np.bincount(c, error[r], n) / len(y) + 2 * l2 * w / len(y)
        if m:
            apart = np.bincount(a_r, w[a_c], m) - np.bincount(b_r, w[b_c], m)
            grad += 2 * penalty / m * (np.bincount(a_c, apart[a_r], n) - np.bincount(b_c, apart[b_r], n))
        g = np.append(grad, error.mean())
        state = [0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g]
        move = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-3})


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "words": [b" ".join(w for w, n in sorted(word_counts(t).items()) for _ in range(min(n, LEVELS))) for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0, max_rows: int = 4000, **options) -> Model:
    """Fits the model on a bounded sample of the labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    sample = (
        labels.select(F.col(key), F.col(label).cast("int").alias("label"))
        .filter(F.col(key).isNotNull() & F.col("label").isNotNull() & (fold(F.col(key), folds) != held_out))
        .orderBy(F.xxhash64(F.col(key).cast("string")), "label", key)
        .limit(max_rows)
    )
    # max_rows keys: a bounded broadcast
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(sample), key).select("label", "text")
    found = rows.mapInPandas(_word_sets, "label int, words binary").collect()
    found.sort(key=lambda r: (bytes(r["words"]), r["label"]))
    return fit([bytes(r["words"]) for r in found], [r["label"] for r in found], **options)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score) for every document; the text alone decides."""

    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.select(F.col(key), score(F.col(text)).alias("score"))
