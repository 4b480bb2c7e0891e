"""Reads of any format from files and folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insertframe.functions.seq import clean
from insertframe.sources import abif, genbank, tables
from insertframe.sources.tables import EXTENSIONS, format_of, read_id_sequence


def read(spark: SparkSession, path: str, declared: str = "") -> DataFrame:
    """Rows (record_id, sequence, source_file, record_idx); trace files are named by their stem.

    Trace files that can't be read are left out; ``abif.read`` tells which and why.
    """
    if format_of(path, declared) != "ab1":
        return read_id_sequence(spark, path, declared)
    good = abif.read(spark, path).filter("error is null")
    # names come from the listing: no trace is read to be numbered
    names = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file")).distinct()
    number = (F.row_number().over(Window.orderBy("source_file")) - 1).cast("long").alias("record_idx")
    return good.join(names.select("source_file", number), "source_file").select("record_id", clean(F.col("bases")).alias("sequence"), "source_file", "record_idx")


def _all_of(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/*.{{{','.join(e for e, f in EXTENSIONS.items() if f == kind)}}}"


def _errors(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    at = _all_of(folder, kind)
    if kind in ("ab1", "genbank"):
        return (abif if kind == "ab1" else genbank).read(spark, at).filter("error is not null").select("source_file", "error")
    return tables.errors(spark, at, kind)


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (source_file, error): the folder's files of any format that reading leaves out, and why."""
    parts = [_errors(spark, folder, kind) for kind in _kinds(spark, folder)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "source_file string, error string")


def _kinds(spark: SparkSession, folder: str) -> list[str]:
    """The formats of a folder's files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted({EXTENSIONS[n.rsplit(".", 1)[-1].lower()] for n in names if n.rsplit(".", 1)[-1].lower() in EXTENSIONS})


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All reads of a folder, by format; records of later formats are numbered after earlier ones.
    Files that can't be read are left out, each as a whole; ``unreadable`` names them."""
    kinds = [k for k in _kinds(spark, folder) if k != "genbank"]
    parts = []
    for k, kind in enumerate(kinds):
        own = tables.records_of_folder(spark, _all_of(folder, kind), kind) if kind != "ab1" else read(spark, _all_of(folder, kind), kind)
        parts.append(own.withColumn("record_idx", F.col("record_idx") + (k << 40)))
    if not parts:
        return spark.createDataFrame([], "record_id string, sequence string, source_file string, record_idx long")
    return reduce(DataFrame.unionByName, parts)
