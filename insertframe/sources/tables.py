"""Sequence tables: FASTA, CSV and XLSX as DataFrames (record_id, sequence, source_file, record_idx).

``record_idx`` follows the order in a file and then the sorted file names, so that rules such as
"the last record wins" hold however Spark deals the files out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import sys

from insertframe.functions.seq import clean
from insertframe.operators.library import last_wins
from insertframe.operators.naming import DEFAULT, Profile, parse_name
from insertframe.sources import cells
from insertframe.sources.cells import Tables, in_order, norm_header

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(cells)

# Header names by role, the first that fits wins.
ID_NAMES = ("sequence_id", "seq_id", "id", "name", "sequenceid", "seqid")
SEQUENCE_NAMES = ("sequence", "seq")
ANTIBODY_NAMES = ("ab_id", "abid", "antibody", "antibodyid", "id", "name", "sequence_id", "seqid", "sequenceid", "clone", "cloneid", "clone_id", "mab", "mabid")
HEAVY_NAMES = ("h_seq", "hseq", "heavy", "heavyseq", "heavy_seq", "heavychain", "hchain", "hc", "vh", "vh_aa", "heavy_aa", "h")
LIGHT_NAMES = ("l_seq", "lseq", "light", "lightseq", "light_seq", "lightchain", "lchain", "lc", "vl", "vl_aa", "light_aa", "l")
# Formats by file extension.
EXTENSIONS = {"fasta": "fasta", "fa": "fasta", "fna": "fasta", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "gb": "genbank", "gbk": "genbank", "genbank": "genbank", "ab1": "ab1"}


def format_of(path: str, declared: str = "") -> str:
    """The declared format, else that of the extension, else FASTA."""
    return declared.lower() if declared else EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "fasta")


def find_column(headers: list[str], names: tuple[str, ...]) -> str | None:
    """The header that fits a name; earlier names win over earlier headers."""
    known: dict[str, str] = {}
    for h in headers:
        known.setdefault(norm_header(h), h)
    return next((known[norm_header(n)] for n in names if norm_header(n) in known), None)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records after each ``>``: the first word is the id (may be empty), the lines are joined.

    The reader splits at line ends before a ``>``, so a file of any size is read by many tasks.
    """
    return fasta_records(fasta_parts(spark.read, path))


def fasta_parts(reader, path: str) -> DataFrame:
    """Rows (source_file, block, part): what stands between two marks; from a reader of files or of a stream of them."""
    meta = F.col("_metadata")
    return reader.format("text").option("lineSep", "\n>").load(path).select(meta["file_path"].alias("source_file"), meta["file_block_start"].alias("block"), F.regexp_replace("value", "\r", "").alias("part"))


def fasta_records(parts: DataFrame) -> DataFrame:
    """The records of parts. Numbers follow the stretches of the files that tasks read: a row per stretch is summed up."""
    parts = parts.withColumn("n", F.monotonically_increasing_id())
    # rows of a stretch are numbered one after another; a row per stretch
    blocks = parts.groupBy("source_file", "block").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("source_file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.min("block").over(Window.partitionBy("source_file"))
    shift = blocks.select("source_file", "block", "first", (before - F.col("first")).alias("shift"), (F.col("block") == start).alias("top"))
    rows = parts.join(shift, ["source_file", "block"])
    # what a file begins with is a record only if it begins with its mark
    head_row = F.col("top") & (F.col("n") == F.col("first"))
    rows = rows.filter(~head_row | F.col("part").startswith(">")).withColumn("part", F.when(head_row, F.substring(F.col("part"), F.lit(2), F.length("part"))).otherwise(F.col("part")))
    head = F.substring_index("part", "\n", 1)
    body = F.substring(F.col("part"), F.length(head) + 2, F.length("part"))
    return rows.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("record_id"), clean(body).alias("sequence"), "source_file", (F.col("n") + F.col("shift")).cast("long").alias("record_idx"))


def read_headers(spark: SparkSession, path: str) -> list[str]:
    """The header of a file, or of a folder's first file by name."""
    files = _tables(spark, path, format_of(path)).files.filter("error is null")
    first = files.agg(F.min_by("names", "source_file").alias("names")).first()["names"]
    return [re.sub('^"|"$', "", n).replace('""', '"') for n in first or []]


def _tables(spark: SparkSession, path: str, kind: str) -> Tables:
    if kind == "csv":
        return Tables.of_csv(spark, path)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")
    return workbooks(files, len(files.inputFiles()))


def workbooks(files: DataFrame, n_files: int) -> Tables:
    """The first sheets of workbooks (source_file, content), wherever they come from."""
    return Tables.of_sheets(files.mapInPandas(_sheets, "source_file string, n long, cells array<string>, error string"), n_files)


#: What a record of any table needs, and what to call it in an error.
RECORD_ROLES, RECORD_NEEDS = {"record_id": ID_NAMES, "cell": SEQUENCE_NAMES}, {"record_id": "id", "cell": "sequence"}


def errors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (source_file, error): FASTA, CSV and XLSX files that reading a folder leaves out."""
    if kind == "fasta":
        name = F.col("_metadata.file_path").alias("source_file")
        # an empty file has no line, and so no row here: it has no record and no error
        lines = spark.read.text(path).select(name, "value").groupBy("source_file")
        told = lines.agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.bool_or(F.col("value").startswith(">")).alias("some"))
        return told.select("source_file", F.when(F.col("bad"), "not UTF-8 text").when(~F.col("some"), "no record").alias("error")).filter("error is not null")
    return _tables(spark, path, kind).placed(RECORD_ROLES, RECORD_NEEDS).filter("error is not null").select("source_file", "error")


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["source_file"], pdf["content"]):
            try:
                rows, error = sheet_rows(content) or [[]], None
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
                rows, error = [[]], f"not a workbook: {e}"
            yield pd.DataFrame({"source_file": [path] * len(rows), "n": range(len(rows)), "cells": rows, "error": [error] * len(rows)})


def sheet_rows(content: bytes) -> list[list[str]]:
    """The first sheet of a workbook as text: strings as they are, whole numbers without a point."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in root]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            return []
        root = ElementTree.fromstring(z.read(sheets[0]))
    out = []
    for row in (e for e in root.iter() if tag(e) == "row"):
        cells: list[str] = []
        for c in row:
            ref = re.match("[A-Z]+", c.get("r", ""))
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1 if ref else len(cells)
            cells += [""] * (at - len(cells))
            value = next((e.text or "" for e in c if tag(e) == "v"), "")
            kind = c.get("t", "n")
            if kind == "s":
                text = shared[int(value)] if value else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
            elif kind == "b":
                text = "true" if value == "1" else "false"
            elif kind in ("str", "n"):
                text = value
                if kind == "n" and value:
                    number = float(value)
                    text = str(int(number)) if number == int(number) else repr(number)
            else:
                text = ""
            cells.append(text)
        out.append(cells)
    return out


def read_id_sequence(spark: SparkSession, path: str, declared: str = "", strict: bool = True) -> DataFrame:
    """Records of a FASTA, CSV or XLSX file or folder, each file under its own header; rows without an
    id are dropped, and files without an id or a sequence column left out (``errors`` names them).

    CSV rows that end before their sequence cell are dropped, XLSX ones kept as empty.
    """
    kind = format_of(path, declared)
    if kind == "fasta":
        return read_fasta(spark, path)
    if kind not in ("csv", "xlsx"):
        raise ValueError(f"{path}: a table of sequences is FASTA, CSV or XLSX, not {kind}")
    return records_of(_tables(spark, path, kind), kind == "csv", strict)


def records_of(found: Tables, drop_short: bool, strict: bool = True) -> DataFrame:
    """The records of tables; with ``drop_short``, rows that end before their sequence cell go."""
    rows = found.read(RECORD_ROLES, RECORD_NEEDS, strict)
    if drop_short:
        rows = rows.filter("cell is not null")
    out = rows.select(F.trim("record_id").alias("record_id"), clean(F.coalesce("cell", F.lit(""))).alias("sequence"), "source_file", "block", "n")
    return in_order(out.filter("record_id <> ''"), found, "record_id", "sequence", "source_file")


def records_of_folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of all files that can be read; none where no file can."""
    if kind == "fasta":
        return read_fasta(spark, path).join(errors(spark, path, kind), "source_file", "left_anti").select("record_id", "sequence", "source_file", "record_idx")
    return read_id_sequence(spark, path, kind, strict=False)


def read_panel(spark: SparkSession, path: str, columns: dict[str, str] | None = None, declared: str = "") -> DataFrame:
    """Rows (ab_id, heavy, light, idx) of a panel table; given column names are tried first."""
    given = {r: (own,) if own else () for r, own in ((r, (columns or {}).get(r)) for r in ("ab_id", "heavy", "light"))}
    roles = {"ab_id": given["ab_id"] + ANTIBODY_NAMES, "heavy": given["heavy"] + HEAVY_NAMES, "light": given["light"] + LIGHT_NAMES}
    found = _tables(spark, path, format_of(path, declared))
    rows = found.read(roles, {"ab_id": "antibody"})
    cell = lambda name: F.nullif(clean(F.col(name)), F.lit("")).alias(name)
    out = rows.select(F.trim("ab_id").alias("ab_id"), cell("heavy"), cell("light"), "source_file", "block", "n")
    return in_order(out.filter("ab_id <> ''"), found, "ab_id", "heavy", "light").withColumnRenamed("record_idx", "idx")


def panel_from_fasta(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """A panel from named records: heavy chains to heavy, all others to light, the last of each."""
    named = records.withColumn("p", parse_name(F.col("record_id"), profile)).select(F.col("p.ab_id").alias("ab_id"), (F.col("p.chain_class") == "heavy").alias("h"), "sequence", "record_idx")
    last = last_wins(named, ["ab_id", "h"], "record_idx", ["sequence", "record_idx"])
    side = lambda h: F.max(F.when(F.col("h") == h, F.col("sequence")))
    return last.groupBy("ab_id").agg(side(True).alias("heavy"), side(False).alias("light"), F.max("record_idx").alias("idx"))
