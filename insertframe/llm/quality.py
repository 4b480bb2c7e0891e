"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Boolean expression over a text and its words that is true where the
document is to be rejected. The cascade measures each rule on a sample (seconds, and the
share that it rejects), sorts the rules by rejections per second, and evaluates them as one
``CASE``: a rule runs only on documents that all earlier ones let pass. The order changes
what is computed, never the verdict, which is the conjunction of the rules.

Null and empty texts have no words and are rejected as too short. Other columns of the
input, of any name, pass through ``filter_documents`` unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words

Expression = Callable[[Column, Column], Column]

SYMBOLS = "#*$%&|<>"
SAMPLE_CHARS = 20_000


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    if len(chars) == 1:
        return F.length(text) - F.length(F.replace(text, F.lit(chars), F.lit("")))
    return F.length(text) - F.length(F.translate(text, chars, ""))


def n_words(_: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(text: Column, _: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column, _: Column) -> Column:
    return count_of(text, SYMBOLS).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))


def n_dup_lines(text: Column, _: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(_: Column, w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted as plain longs whose low bits hold the position, so equal
    windows are neighbours; neighbours are then compared word by word. Linear memory, and
    n log n time for any text.
    """
    size = F.size(w)
    bits = F.coalesce(F.length(F.bin(size.cast("long"))), F.lit(1)).cast("int")
    mask = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, F.lit(0).cast("long"))

    def of(b: Column) -> Column:
        bits, mask = b["bits"], b["mask"]
        packed = F.transform(
            F.slice(w, F.lit(1), F.greatest(size - 2, F.lit(0))),
            lambda x, i: F.coalesce(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")), F.lit(0).cast("long")),
        )

        def same(x: Column, y: Column) -> Column:
            i, j = (v.bitwiseAND(mask).cast("int") for v in (x, y))
            top = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            return top & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.sort_array(F.transform(twice, lambda x: F.coalesce(x.bitwiseAND(mask), F.lit(0).cast("long"))))

        three = F.lit(3).cast("long")
        start = F.struct((-three).alias("at"), F.lit(0).cast("long").alias("n"))
        covered = F.aggregate(
            let(F.sort_array(packed), positions),
            start,
            lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(three, x - a["at"])).alias("n")),
            lambda a: a["n"],
        )
        return covered

    return let(F.struct(bits.alias("bits"), mask.alias("mask")), of)


def too_short(text: Column, w: Column) -> Column:
    return n_words(text, w) < 50


def too_repetitive(text: Column, w: Column) -> Column:
    return 100 * n_repeat_words(text, w) > 50 * n_words(text, w)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Expression


#: The rules that every document must pass in either form of the operator.
BASE = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))


def default_rules(
    max_symbols_per_word: float = 0.1,
    word_length: tuple[float, float] = (2.0, 14.0),
    max_bangs_per_word: float = 0.25,
    min_words_with_letter: float = 0.7,
    max_bullet_lines: float = 0.9,
    max_ellipsis_lines: float = 0.3,
) -> tuple[Rule, ...]:
    """The base rules and the usual web-text heuristics with their thresholds."""

    def share(of: Callable[[Column], Column], most: float) -> Expression:
        return lambda text, _: let(_lines(text), lambda x: F.size(F.filter(x, of)) > most * F.size(x))

    low, high = word_length
    return (
        *BASE,
        Rule("symbols", lambda t, w: n_symbols(t, w) > max_symbols_per_word * F.size(w)),
        Rule("word_length", lambda t, w: ~word_chars(t, w).between(low * F.size(w), high * F.size(w))),
        Rule("bangs", lambda t, w: count_of(t, "!") > max_bangs_per_word * F.size(w)),
        Rule("letters", lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) < min_words_with_letter * F.size(w)),
        Rule("bullets", share(lambda x: x.rlike(r"^\s*[•*-]\s"), max_bullet_lines)),
        Rule("ellipsis", share(lambda x: x.rlike(r"(\.\.\.|…)\s*$"), max_ellipsis_lines)),
    )


def measure(docs: DataFrame, rules: tuple[Rule, ...], text: str, sample_share: float, sample_rows: int) -> list[dict]:
    """Cost (seconds) and selectivity (share rejected) of each rule on a sample of the rows.

    The sample, at most ``sample_rows`` texts cut to SAMPLE_CHARS, is read once, from as few
    partitions as hold it. It decides the order of the rules and nothing else.
    """
    picked = docs.select(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(SAMPLE_CHARS)).alias("t")).sample(False, sample_share, seed=7).limit(sample_rows).collect()
    sample = docs.sparkSession.createDataFrame([(r["t"],) for r in picked], "t string").coalesce(1)

    def run(of: Expression) -> tuple[float, float]:
        began = time.perf_counter()
        row = sample.select(let(words(F.col("t")), lambda w: of(F.col("t"), w).cast("int")).alias("x")).agg(F.avg("x")).first()
        return time.perf_counter() - began, float(row[0] or 0.0)

    def nothing(_: Column, w: Column) -> Column:
        return F.size(w) < 0

    run(nothing)  # reads and compiles once, so that no rule pays for it
    floor = run(nothing)[0]
    found = []
    for rule in rules:
        cost, rejected = run(rule.rejects)
        found.append({"rule": rule.name, "cost": max(cost - floor, 1e-3), "rejected": rejected})
    return found


def order(rules: tuple[Rule, ...], measured: list[dict]) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; equal ones by name."""
    by = {m["rule"]: m["rejected"] / m["cost"] for m in measured}
    return tuple(sorted(rules, key=lambda r: (-by[r.name], r.name)))


def cascade(text: Column, w: Column, rules: tuple[Rule, ...]) -> Column:
    """The first rule in this order that rejects the text, null where none does."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.rejects(text, w), F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None, sample_share: float = 0.01, sample_rows: int = 500) -> DataFrame:
    """The documents that pass every rule, with their columns as they were."""
    rules = rules or default_rules()
    ordered = order(rules, measure(docs, rules, text, sample_share, sample_rows))
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.filter(let(words(F.col(text)), lambda w: cascade(t, w, ordered)).isNull())


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] | None = None, sample_share: float = 0.01, sample_rows: int = 500) -> DataFrame:
    """A row per document: the base measures, whether the base rules reject it, the verdict.

    The base measures are wanted for every document; of the other rules, those run that the
    cascade reaches.
    """
    rules = rules or default_rules()
    base = {r.name for r in BASE}
    rest = tuple(r for r in rules if r.name not in base)
    ordered = order(rest, measure(docs, rest, text, sample_share, sample_rows))
    t = F.coalesce(F.col(text), F.lit(""))
    measures = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}

    def of(w: Column) -> Column:
        def verdict(m: Column) -> Column:
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            return F.struct(
                *[m[k].alias(k) for k in measures],
                failed.alias("base_failed"),
                F.when(failed, F.lit(False)).otherwise(cascade(t, w, ordered).isNull()).alias("kept"),
            )

        return let(F.struct(*[f(t, w).alias(k) for k, f in measures.items()]), verdict)

    return docs.select(F.col(key), let(words(F.col(text)), of).alias("m")).select(key, "m.*")
