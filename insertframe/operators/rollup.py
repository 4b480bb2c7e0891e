"""Per-antibody rollups, summaries, severities, and CSV, HTML and text reports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_PASSING = ("PASS", "NO_GROUND_TRUTH")
READ_PASSING = ("PASS", "SILENT_VARIANT")
# Verdicts that advise and do not fail.
ADVISORY = ("NO_GROUND_TRUTH", "GC_WARNING", "RARE_CODON_WARNING", "SILENT_VARIANT")


def severity(kind: Column) -> Column:
    return F.when(kind == "PASS", "Pass").when(kind.isin(*ADVISORY), "Advisory").otherwise("Fail")


def _grouped(verdicts: DataFrame, passing: tuple[str, ...]) -> DataFrame:
    ok = F.col("kind").isin(*passing)
    ordered = F.array_sort(F.collect_list(F.struct("record_idx", "record_id", "kind", ok.alias("ok"))))
    return verdicts.groupBy("ab_id").agg(F.bool_and(ok).alias("all_pass"), F.count("*").cast("int").alias("n"), ordered.alias("v"))


def _flags() -> Column:
    bad = F.transform(F.filter("v", lambda x: ~x["ok"]), lambda x: x["kind"])
    return F.concat(F.lit("flagged: "), F.array_join(bad, ", "))


def _chains() -> Column:
    return F.transform("v", lambda x: x["record_id"]).alias("chains")


def rollup_order(verdicts: DataFrame) -> DataFrame:
    """Rows (ab_id, passed, note, chains): passed if all chains are; chains in input order."""
    note = F.when(F.col("all_pass"), F.concat(F.col("n").cast("string"), F.lit(" chain(s) pass"))).otherwise(_flags())
    return _grouped(verdicts, ORDER_PASSING).select("ab_id", F.col("all_pass").alias("passed"), note.alias("note"), _chains())


def rollup_reads(verdicts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The same for reads; an antibody with fewer chains than expected is incomplete first of all."""
    g = _grouped(verdicts, READ_PASSING)
    g = g.join(expected.select("ab_id", "expected"), "ab_id", "left") if expected is not None else g.withColumn("expected", F.lit(None).cast("int"))
    wanted = F.coalesce("expected", "n")
    complete = F.col("n") >= wanted
    note = (
        F.when(~complete, F.concat(F.lit("INCOMPLETE_PAIR ("), F.col("n").cast("string"), F.lit(" of "), wanted.cast("string"), F.lit(" chains present)")))
        .when(F.col("all_pass"), F.concat(F.col("n").cast("string"), F.lit(" chain(s) pass")))
        .otherwise(_flags())
    )
    return g.select("ab_id", (F.col("all_pass") & complete).alias("passed"), note.alias("note"), _chains())


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def pass_count(verdicts: DataFrame, passing: tuple[str, ...]) -> DataFrame:
    return verdicts.agg(F.count_if(F.col("kind").isin(*passing)).alias("passed"), F.count("*").alias("total"))


# ------------------------------------------------------------------------------ sinks

def csv_escape(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n]'), quoted).otherwise(c)


def _text(c: str) -> Column:
    return F.coalesce(csv_escape(F.col(c).cast("string")), F.lit(""))


ORDER_COLUMNS = ("record_id", "ab_id", "chain_class", "verdict", "severity", "core_len", "premature_stop_aa", "reads_through", "reason")
READ_COLUMNS = ("record_id", "ab_id", "chain_class", "verdict", "severity", "backbone_vector", "backbone_identity", "backbone_observed", "reads_through", "suspected_identity", "reason")


def csv_rows(verdicts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows (record_idx, line): quoted only where a comma, a quote or a line end asks for it."""
    v = verdicts.withColumn("verdict", F.col("kind")).withColumn("severity", severity(F.col("kind")))
    if "backbone_identity" in columns:
        v = v.withColumn("backbone_identity", F.when(F.col("backbone_identity").isNotNull(), F.format_string("%.4f", "backbone_identity")))
    return v.select("record_idx", F.concat_ws(",", *[_text(c) for c in columns]).alias("line"))


def write_csv(verdicts: DataFrame, columns: tuple[str, ...], path: str) -> None:
    """Part files of lines in input order, the header first."""
    spark = verdicts.sparkSession
    head = spark.createDataFrame([(-1, ",".join(columns))], "record_idx long, line string")
    head.union(csv_rows(verdicts, columns).select(F.col("record_idx").cast("long"), "line")).orderBy("record_idx").select("line").write.mode("overwrite").text(path)


COLORS = {"Pass": "#1b7f3b", "Advisory": "#b07a00", "Fail": "#b3261e"}


def _esc(x) -> str:
    return html.escape("" if x is None else str(x), quote=False)


def _html_rows(df: DataFrame, section: int) -> DataFrame:
    """Rows (section, record_idx, line): the table's lines, made by tasks."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    color = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])[severity(F.col("kind"))]
    line = F.concat(F.lit("<tr><td>"), esc("record_id"), F.lit("<td>"), esc("ab_id"), F.lit("<td>"), esc("chain_class"), F.lit("<td style='color:"), color, F.lit("'>"), esc("kind"), F.lit("<td>"), esc("reason"), F.lit("</tr>"))
    return df.select(F.lit(section).alias("section"), F.col("record_idx").cast("long").alias("record_idx"), line.alias("line"))


def html_lines(title: str, order: DataFrame | None = None, reads: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Rows (section, record_idx, line) of a self-contained page of all verdicts: the page is the
    lines in order. Only the counts of kinds reach the driver.

    ``most`` limits the rows of each table; the page then says how many there are.
    """
    spark = (order if order is not None else reads).sparkSession
    fixed = [(0, 0, f"<!doctype html><meta charset='utf-8'><title>{_esc(title)}</title><style>body{{font-family:sans-serif}}td,th{{padding:4px 8px;text-align:left}}</style><h1>{_esc(title)}</h1>")]
    parts = []
    for k, (name, df) in enumerate((("Order QC", order), ("Sequencing QC", reads))):
        if df is None:
            continue
        at, rows = 10 * k + 1, df
        fixed.append((at, 0, f"<h2>{name}</h2>"))
        if name == "Order QC":
            fixed.append((at, 1, "<p>" + " ".join(f"<b>{_esc(r['kind'])}: {r['n']}</b>" for r in summary(df).collect()) + "</p>"))
        if most is not None and (total := df.count()) > most:
            fixed.append((at, 2, f"<p>The first {most} of {total} records.</p>"))
            rows = df.orderBy("record_idx").limit(most)
        fixed.append((at, 3, "<table><tr><th>Record<th>Antibody<th>Chain<th>Verdict<th>Reason</tr>"))
        parts.append(_html_rows(rows, at + 1))
        fixed.append((at + 2, 0, "</table>"))
    out = spark.createDataFrame(fixed, "section int, record_idx long, line string")
    for p in parts:
        out = out.union(p)
    return out


def write_html(path: str, title: str, **page) -> None:
    """The page as part files whose names are in its order, wherever Spark writes; tasks make and write them."""
    html_lines(title, **page).orderBy("section", "record_idx").select("line").write.mode("overwrite").text(path)


def html_report(title: str, order: DataFrame | None = None, reads: DataFrame | None = None, most: int | None = None) -> str:
    """The page as one string, for those that fit the driver."""
    return "\n".join(r["line"] for r in html_lines(title, order, reads, most).orderBy("section", "record_idx").select("line").toLocalIterator())
