"""Sample-name parsing as native expressions: antibody id, chain class, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insertframe.functions.seq import let

CLASSES = ("heavy", "kappa", "lambda", "light")

# Default chain synonyms by class.
SYNONYMS = {
    "heavy": ("heavychain", "heavy", "hchain", "hc", "vh", "igh", "h"),
    "kappa": ("kappachain", "kappa", "igk", "vk", "k"),
    "lambda": ("lambdachain", "lambda", "igl", "vl", "l"),
    "light": ("lightchain", "light", "lchain", "lc"),
}
# Chain suffixes of the fallback, in the order in which they are tried.
SUFFIXES = (
    ("heavychain", "heavy"), ("lightchain", "light"), ("lambdachain", "lambda"), ("kappachain", "kappa"), ("heavy", "heavy"),
    ("light", "light"), ("lambda", "lambda"), ("kappa", "kappa"), ("hchain", "heavy"), ("lchain", "light"),
    ("hc", "heavy"), ("lc", "light"), ("vh", "heavy"), ("vk", "kappa"), ("vl", "lambda"),
)
TRAILING = r"[_\- :]+$"


@dataclass(frozen=True)
class Profile:
    """How names are read: separators, synonyms by class, and whether suffixes are tried."""

    synonyms: dict[str, tuple[str, ...]]
    separators: tuple[str, ...] = ("_", "-", " ", ":")
    fallback: bool = True

    def by_token(self) -> dict[str, str]:
        """Class of each synonym; of classes that share one, the first by name."""
        out: dict[str, str] = {}
        for name in sorted(self.synonyms):
            for s in self.synonyms[name]:
                out.setdefault(lower(s), name if name in CLASSES else "unknown")
        return out


DEFAULT = Profile(SYNONYMS)


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lower_col(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper_col(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _parsed(ab_id: Column, chain: Column, confidence: str, confirm: bool) -> Column:
    return F.struct(ab_id.alias("ab_id"), chain.alias("chain_class"), F.lit(confidence).alias("confidence"), F.lit(confirm).alias("needs_confirmation"))


def _fallback(raw: Column) -> Column:
    out = None
    for suffix, chain in SUFFIXES:
        head = F.regexp_replace(F.left(raw, F.length(raw) - len(suffix)), TRAILING, "")
        fits = lower_col(raw).endswith(suffix) & (F.length(head) > 0)
        parsed = _parsed(head, F.lit(chain), "High", False)
        out = F.when(fits, parsed) if out is None else out.when(fits, parsed)
    return out


def parse_name(raw: Column, profile: Profile = DEFAULT) -> Column:
    """A struct of ab_id, chain_class, confidence and needs_confirmation.

    The rightmost token that is a synonym names the chain. As last token it is cut off with the
    separators before it; elsewhere the other tokens are joined by underscores.
    """
    table = profile.by_token()
    classes = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    cut = "|".join("\\Q" + s + "\\E" for s in profile.separators if s)
    tokens = F.filter(F.split(raw, cut, -1), lambda t: t != "") if cut else F.filter(F.array(raw), lambda t: t != "")
    unknown = _parsed(raw, F.lit("unknown"), "None", True)

    def of(t: Column) -> Column:
        def at(i: Column) -> Column:
            token = F.get(t, i)
            last = (i == F.size(t) - 1) & lower_col(raw).endswith(lower_col(token))
            head = F.regexp_replace(F.left(raw, F.length(raw) - F.length(token)), TRAILING, "")
            others = F.array_join(F.filter(t, lambda x, j: j != i), "_")
            ab_id, chain = F.when(last, head).otherwise(others), classes[lower_col(token)]
            return F.when(F.length(token) == 1, _parsed(ab_id, chain, "Low", True)).otherwise(_parsed(ab_id, chain, "High", False))

        hit = F.array_max(F.transform(t, lambda x, j: F.when(F.map_contains_key(classes, lower_col(x)), j)))
        rest = F.coalesce(_fallback(raw), unknown) if profile.fallback else unknown
        return let(hit, lambda i: F.when(F.size(t) == 0, unknown).when(i.isNotNull(), at(i)).otherwise(rest))

    return let(tokens, of)


def with_names(records: DataFrame, profile: Profile = DEFAULT, overrides: DataFrame | None = None, id_col: str = "record_id") -> DataFrame:
    """Adds ab_id, chain_class, confidence, needs_confirmation; an override by record id wins.

    ``overrides`` has (record_id, ab_id, chain_class), one row per id; Spark broadcasts it by size.
    """
    p = parse_name(F.col(id_col), profile)
    if overrides is None:
        return records.withColumn("__p", p).select("*", "__p.*").drop("__p")
    own = overrides.select(F.col("record_id").alias("__id"), F.col("ab_id").alias("__ab"), F.col("chain_class").alias("__chain"))
    joined = records.join(own, F.col(id_col) == F.col("__id"), "left").withColumn("__p", p)
    given = F.col("__id").isNotNull()
    return joined.select(
        *[F.col(c) for c in records.columns],
        F.when(given, F.col("__ab")).otherwise(F.col("__p.ab_id")).alias("ab_id"),
        F.when(given, F.col("__chain")).otherwise(F.col("__p.chain_class")).alias("chain_class"),
        F.when(given, F.lit("High")).otherwise(F.col("__p.confidence")).alias("confidence"),
        (~given & F.col("__p.needs_confirmation")).alias("needs_confirmation"),
    )


def group_by_antibody(parsed: DataFrame) -> DataFrame:
    """Rows (ab_id, record_ids) in input order (``record_idx``)."""
    ordered = F.array_sort(F.collect_list(F.struct("record_idx", "record_id")))
    return parsed.groupBy("ab_id").agg(F.transform(ordered, lambda x: x["record_id"]).alias("record_ids"))


def expected_chain_counts(parsed: DataFrame) -> DataFrame:
    """Records (not distinct classes) of each antibody."""
    return parsed.groupBy("ab_id").agg(F.count("*").cast("int").alias("expected"))
