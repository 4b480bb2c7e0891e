"""The sequence functions as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from insertframe.functions import kernels
from insertframe.functions.seq import AMINO_ACIDS, BASES, FAMILIES

_CLEAN = "upper(regexp_replace(s, '[^A-Za-z]', ''))"
_FAMILY = "map(" + ", ".join(f"'{pair}', '{amino}'" for pair, amino in FAMILIES.items()) + ")"
_AT = "(instr('{b}', substr(c, {i}, 1)) - 1)"
_INDEX = " + ".join(f"{16 // 4**i} * {_AT.format(b=BASES, i=i + 1)}" for i in range(3))
_AMINO = (
    f"CASE WHEN c RLIKE '^[{BASES}]+$' THEN substr('{AMINO_ACIDS}', {_INDEX} + 1, 1) "
    f"ELSE coalesce(try_element_at({_FAMILY}, left(c, 2)), 'X') END"
)
#: Name, parameters and body of each native function.
NATIVE = {
    "seq_clean": _CLEAN,
    "seq_revcomp": f"reverse(translate({_CLEAN}, 'ATUGC', 'TAACG'))",
    "seq_gc": f"CASE WHEN length({_CLEAN}) = 0 THEN 0D ELSE length(regexp_replace({_CLEAN}, '[^GC]', '')) / length({_CLEAN}) END",
    "seq_sha256": f"sha2({_CLEAN}, 256)",
    "seq_type": f"CASE WHEN length({_CLEAN}) > 0 AND 10 * length(regexp_replace({_CLEAN}, '[^ACGTUN]', '')) >= 9 * length({_CLEAN}) THEN 'nt' ELSE 'aa' END",
    "seq_translate": f"array_join(transform(regexp_extract_all(translate({_CLEAN}, 'U', 'T'), '(...)', 1), c -> {_AMINO}), '')",
}


def register(spark: SparkSession) -> None:
    """Adds seq_clean, seq_revcomp, seq_gc, seq_sha256, seq_type, seq_translate, align_protein,
    align_nt and circular_identity to the session's SQL."""
    for name, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURN {body}")
    for name, scoring in (("align_protein", kernels.protein_scoring()), ("align_nt", kernels.nucleotide_scoring())):
        spark.udf.register(name, _aligner(scoring))

    @F.pandas_udf("double")
    def circular_identity(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or m is None else kernels.circular_search(t, m)[0] for t, m in zip(texts, marks)], dtype="float64")

    spark.udf.register("circular_identity", circular_identity)


def _aligner(scoring: kernels.Scoring):
    columns = [c.split()[0] for c in kernels.ALIGNMENT.split(", ")]

    @F.pandas_udf(kernels.ALIGNMENT)
    def align(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 6 if x is None or y is None else kernels.global_affine(x, y, scoring) for x, y in zip(left, right)]
        return pd.DataFrame(rows, columns=columns, dtype=object).astype({c: "Int32" for c in ("score", "matches", "mismatches", "gaps")})

    return align
