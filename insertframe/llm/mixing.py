"""Mixing to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives every document a
posterior over domains. Document rates r >= 0 (how often a document is drawn on average) are
then fitted so that each domain's expected tokens, the sum of r * tokens * posterior, reach its
target share of the token budget: least squares by projected gradient,

    r <- max(0, r - step * sum_k posterior_k * (tokens_k(r) - target_k)),

from r = 1. What is minimised is the squared residual in tokens, and the gradient is taken in the metric
of tokens, so a document's length does not decide how fast its rate moves. Steps are implicit: the gradient
is that at the step's end, so that steps may be long (a hundred thousand times the longest stable explicit
one) however little mass a domain has; explicit ones were measured to crawl. All documents share a step's
K numbers (step * residual), so its end is found by Newton's method on these alone, where a pass
over the members gives, for several lengths of Newton's move at once, the K sums, the K x K matrix of
documents that keep a rate, and the sum of squares that the step maximises. Those are all that
reaches the driver, and K numbers are all that is sent back. A step that doesn't lower the residual
isn't taken, so no rates are returned that are worse than r = 1. It ends once no domain is off by
more than ``tolerance`` of the budget, or a step gains less than a thousandth (a target that no
nonnegative rates reach is then approached as far as they go), or after ``max_steps``.

The labelled sample is bounded (``max_rows`` rows of lowest hash). Evidence is tempered: a
document counts as ``evidence_words`` words at most, so posteriors stay soft. Null and empty
texts have no tokens and the prior as posterior. Labels without a domain teach nothing;
domains without a target get none (weight 0); without labelled rows all targets share alike.
Rows that repeat a key are documents of their own, null keys too. Without documents the
result is empty.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stage, lower_ascii

BUCKETS = 4096


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(lower_ascii(word)), F.lit(BUCKETS)).cast("int")


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SPACE, -1)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", max_rows: int = 8000) -> dict[str, tuple[float, list[float]]]:
    """Each domain's log prior and log probabilities of the word buckets."""
    sample = labelled.select(F.col(key), F.col(domain).alias("d")).filter(F.col(key).isNotNull() & F.col("d").isin(domains)).orderBy(F.xxhash64(F.col(key).cast("string")), "d").limit(max_rows)
    rows = docs.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(sample), key)
    pairs = rows.select("d", F.explode(_words(F.col("t"))).alias("w")).filter("w <> ''").groupBy("d", _bucket(F.col("w")).alias("b")).count().collect()  # domains * BUCKETS rows
    priors = dict(sample.groupBy("d").count().collect())
    out = {}
    for d in domains:
        counts = [0.5] * BUCKETS
        for r in pairs:
            if r["d"] == d:
                counts[r["b"]] += r["count"]
        total = sum(counts)
        prior = (priors.get(d, 0) + 1) / (sum(priors.values()) + len(domains))
        out[d] = (math.log(prior), [round(math.log(c / total), 6) for c in counts])
    return out


def posteriors(docs: DataFrame, model: dict[str, tuple[float, list[float]]], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",), evidence_words: int = 60) -> DataFrame:
    """Rows (key, keep..., n_tokens, p0, p1, ...), domains in the model's order.

    Words are exploded and summed per document within a task, as generated code; what is
    shuffled is a row per document.
    """
    own = [key, *[c for c in keep if c in docs.columns and c != key]]
    # numbered before they are exploded: a generator goes before what stands beside it
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), *own, F.col(text).alias("__t"))
    rows = numbered.select("__row", *own, F.explode(_words(F.col("__t"))).alias("__w"))
    rows = rows.withColumn("__b", F.when(F.col("__w") != "", _bucket(F.col("__w"))))
    log = [F.coalesce(F.get(F.lit(v), F.col("__b")), F.lit(0.0)) for _, v in model.values()]
    sums = rows.groupBy("__row", *own).agg(F.count("__b").alias("n_tokens"), *[F.sum(x).alias(f"__l{i}") for i, x in enumerate(log)])
    scale = F.least(F.lit(1.0), evidence_words / F.greatest(F.col("n_tokens"), F.lit(1)))
    logit = [F.lit(prior) + F.col(f"__l{i}") * scale for i, (prior, _) in enumerate(model.values())]
    staged = sums.select("__row", *own, "n_tokens", *[x.alias(f"__z{i}") for i, x in enumerate(logit)])
    z = [F.col(f"__z{i}") for i in range(len(model))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    total = sum((F.exp(x - top) for x in z), F.lit(0.0))
    return staged.select(*own, "n_tokens", *[(F.exp(x - top) / total).alias(f"p{i}") for i, x in enumerate(z)])


#: An implicit step, in longest stable explicit ones.
STEP = 1e5
#: Lengths of Newton's move that a pass tries.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None, tolerance: float = 1e-4, max_steps: int = 8, max_moves: int = 20, strict: bool = False) -> tuple[DataFrame, list[float], list[float]]:
    """``members`` with a column ``rate``; the domain tokens reached, and those wanted.

    Targets that are not met are warned of, or raise if ``strict``: where no rates can meet them, the
    fit is the nearest. Posteriors of a member sum up to one.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    n = F.col("n_tokens")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = members.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"a{i}_{j}") for i, j in cells]).first()
    total = float(row["n"] or 0.0)
    budget = total if budget is None else budget
    share = sum(targets)
    wanted = np.array([budget * (t / share if share else 1 / k) for t in targets])
    if not total:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * k, list(wanted)

    def matrix(values) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(cells, values):
            m[i, j] = m[j, i] = float(v or 0.0)
        return m

    def moved(rate: Column, by: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((p[i] * float(by[i]) for i in range(k)), F.lit(0.0)))

    def tried(rate: Column, moves: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each move from ``rate``: what the step maximises, the move, domain tokens, the matrix of kept documents."""
        rows = members.select(n.alias("n_tokens"), *p, *[moved(rate, m).alias(f"r{c}") for c, m in enumerate(moves)])
        sums = []
        for c in range(len(moves)):
            r = F.col(f"r{c}")
            sums += [F.sum(r * r * n), *[F.sum(r * n * p[i]) for i in range(k)], *[F.sum(F.when(r > 0, n * p[i] * p[j])) for i, j in cells]]
        found = np.array([float(v or 0.0) for v in rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]).reshape(len(moves), -1)
        return [(-(m @ m) / (2 * step) - m @ wanted - x[0] / 2, m, x[1 : k + 1], matrix(x[k + 1 :])) for m, x in zip(moves, found)]

    step = STEP / np.linalg.eigvalsh(matrix([row[f"a{i}_{j}"] for i, j in cells]))[-1]
    rate, state = F.lit(1.0), tried(F.lit(1.0), [np.zeros(k)])[0]
    reached = state[2]
    for _ in range(max_steps):
        if np.abs(reached - wanted).max() <= tolerance * budget:
            break
        for _ in range(max_moves):
            value, by, tokens, kept = state
            gradient = tokens - wanted - by / step
            if np.abs(gradient).max() <= tolerance * 1e-3 * budget:
                break
            newton = np.linalg.solve(kept + np.eye(k) / step, gradient)
            best = max(tried(rate, [by + a * newton for a in LENGTHS]), key=lambda x: x[0])
            if best[0] <= value + 1e-13 * abs(value):
                break
            state = best
        before, after = ((reached - wanted) ** 2).sum(), ((state[2] - wanted) ** 2).sum()
        if after >= before:
            break
        rate, reached = moved(rate, state[1]), state[2]
        if after >= before * (1 - 1e-3):
            break
        # the next step begins where this one ends
        squares = -state[0] - state[1] @ wanted - state[1] @ state[1] / (2 * step)
        state = (-squares, np.zeros(k), state[2], state[3])
    worst = np.abs(reached - wanted).max() / budget if budget else 0.0
    if worst > tolerance:
        said = f"mixing: the nearest rates leave a domain {worst:.2g} of the budget off its target"
        if strict:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=2)
    return members.withColumn("rate", rate), list(reached), list(wanted)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",), **options) -> DataFrame:
    """Rows (key, keep..., n_tokens, p_<domain>..., rate) for every document."""
    domains = sorted(targets)
    stage = Stage(docs.sparkSession, "mixing")
    members = stage.put(posteriors(docs, train(docs, labelled, domains, key, text), key, text, keep), "members")
    fitted, _, _ = fit_rates(members, [targets[d] for d in domains], **options)
    own = [c for c in fitted.columns if c not in {"rate", "n_tokens", *[f"p{i}" for i in range(len(domains))]}]
    return fitted.select(*own, "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def domains_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labelled table of domains: toxic, else low quality, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select(F.col(key), domain.alias("domain"))


#: The mix that the query and the pipeline ask for.
TARGETS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
