"""Display helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 1)), F.lit("…")))


def sanitize_id(c: Column) -> Column:
    """ASCII letters and digits in lower case, everything else an underscore."""
    return F.translate(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def norm_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
