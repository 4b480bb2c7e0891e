"""Cells of CSV files and workbooks, each file under its own header.

A file's header is its first record. A side table has a row per file: where its header has each
role's column, or why the file can't be used. It is joined to the rows by file, so files of one folder
may have their columns in any order, under any of the names. Only roles' cells are read.

CSV is split at line ends and read by many tasks. Files in which some quoted cell holds a line end
are told by a first pass over the quotes, of which a row per split is kept; their lines are put together to records again by
the number of quotes before them in the file, where they are read: only what stands at the ends of splits is shuffled. A
record that is not closed by the end of its file, or text that is no UTF-8, makes the file
unreadable. In files with such cells, quotes within unquoted cells are not told from others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insertframe.functions.seq import let
from insertframe.operators.staging import staged

#: Ends a record when its cells are read, to tell a cell that is empty from one that isn't there.
MARK = "\x01"


def norm_header(h: str) -> str:
    return re.sub("[^a-z0-9]", "", h.strip().lower())


def place_of(names: Column, wanted: tuple[str, ...]) -> Column:
    """The 1-based place of the first name that fits; wanted names are tried in order. Null if none."""
    plain = F.transform(names, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    return F.coalesce(*[F.nullif(F.array_position(plain, norm_header(w)), F.lit(0)) for w in wanted]).cast("int")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source_file, block, n, text, quotes): the lines; ``n`` grows within a block."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("source_file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    return lines.withColumn("quotes", quotes_in(F.col("text")))


def quotes_in(t: Column) -> Column:
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit('"')))


def csv_splits(lines: DataFrame) -> DataFrame:
    """Rows (source_file, block, quotes, open, bad): a row per split. ``open``: it has a line that leaves a quoted cell open,
    if that begins outside of one."""
    # quotes within cells that don't begin with one are letters like others
    closed = quotes_in(F.regexp_replace("text", '(^|,)[^",][^,]*', "$1"))
    leaves = F.when(F.col("quotes") > 0, closed % 2 == 1).otherwise(F.lit(False))
    return lines.groupBy("source_file", "block").agg(F.sum("quotes").alias("quotes"), F.bool_or(leaves).alias("open"), F.bool_or(~F.is_valid_utf8("text")).alias("bad"))


def csv_files(splits: DataFrame) -> DataFrame:
    """Rows (source_file, spans_lines, error): a row per file."""
    per = splits.groupBy("source_file").agg(F.bool_or("open").alias("spans_lines"), (F.sum("quotes") % 2 == 1).alias("odd"), F.bool_or("bad").alias("bad"))
    return per.select("source_file", "spans_lines", F.when(F.col("bad"), "not UTF-8 text").when(F.col("spans_lines") & F.col("odd"), "a quoted cell is not closed").alias("error"))


#: So many files, or splits, at most make a side table that is broadcast: a few short columns each.
FEW = 20_000


def by_file(rows: DataFrame, side: DataFrame, n_files: int) -> DataFrame:
    """Joins a row per file to rows; these are not shuffled unless there are very many files."""
    return rows.join(F.broadcast(side) if n_files <= FEW else side, "source_file")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of splits, in their order and each with its line end, put together to records: those that
    are whole within their split, and the rest at its ends (not ``whole``), of which the last begins there (``begins``).

    Lines stand one behind the other, so records are other bounds within the same bytes."""
    split, inside, held, at, began = None, False, [], None, False

    def rest(whole: bool) -> Iterator[pa.RecordBatch]:
        if held:
            text = "".join(t for part in held for t in part.to_pylist())
            yield pa.RecordBatch.from_pydict({"source_file": [at[0]], "block": pa.array([at[1]], pa.int64()), "n": pa.array([at[2]], pa.int64()), "text": [text], "whole": [whole and began], "begins": [began]})

    for batch in batches:
        of = {name: batch.column(name) for name in batch.schema.names}
        splits, quotes = of["split"].to_numpy(), of["quotes"].to_numpy()
        starts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)] if len(splits) else []
        for i, j in zip(starts[:-1], starts[1:]):
            if splits[i] != split:
                yield from rest(not inside)
                split, held, inside = splits[i], [], of["inside"][i].as_py()
                if inside is None:
                    raise ValueError(f"{of['source_file'][i].as_py()}: its splits changed while it was read")
            seen = int(inside) + np.concatenate([[0], np.cumsum(quotes[i:j])])
            begin, inside = i + np.flatnonzero(seen[:-1] % 2 == 0), bool(seen[-1] % 2)
            first = int(begin[0]) if len(begin) else j
            if first > i:
                if not held:
                    at, began = [of[c][i].as_py() for c in ("source_file", "block", "n")], False
                held.append(of["text"].slice(i, first - i))
            if not len(begin):
                continue
            yield from rest(True)
            last = int(begin[-1])
            if len(begin) > 1:
                text, own = of["text"], pa.array(begin[:-1])
                kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
                bounds = np.frombuffer(text.buffers()[1], kind)[text.offset + begin]
                same = pa.Array.from_buffers(text.type, len(own), [None, pa.py_buffer(bounds.tobytes()), text.buffers()[2]]).cast(pa.string())
                yes = pa.array(np.ones(len(own), bool))
                yield pa.RecordBatch.from_pydict({**{c: of[c].take(own) for c in ("source_file", "block", "n")}, "text": same, "whole": yes, "begins": yes})
            held, at, began = [of["text"].slice(last, j - last)], [of[c][last].as_py() for c in ("source_file", "block", "n")], True
    yield from rest(not inside)


def csv_records(lines: DataFrame, splits: DataFrame, files: DataFrame, n_splits: int) -> DataFrame:
    """Rows (source_file, block, n, text): a record each, at the place of its first line."""
    good = files.filter("error is null").select("source_file", "spans_lines")
    kinds = {r["spans_lines"] for r in good.select("spans_lines").distinct().collect()}
    rows = by_file(lines, good, n_splits)
    plain = rows.filter("not spans_lines and text <> ''").select("source_file", "block", "n", "text")
    if True not in kinds:
        return plain
    # whether a split begins within a quoted cell: a row per split
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sides = splits.select("source_file", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    few = n_splits <= FEW
    long = rows.filter("spans_lines").join(F.broadcast(sides) if few else sides, ["source_file", "block"], "left")
    if not few:
        long = long.repartition("source_file", "block").sortWithinPartitions("source_file", "block", "n")
    long = long.select("source_file", "block", "n", F.concat("text", F.lit("\n")).alias("text"), F.col("quotes").cast("long").alias("quotes"), "inside", F.xxhash64("source_file", "block").alias("split"))
    parts = staged(long.mapInArrow(gathered, "source_file string, block long, n long, text string, whole boolean, begins boolean"))
    # what stands at the ends of splits, two rows of each at most, belongs to the last record that began
    before = Window.partitionBy("source_file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.filter("not whole").withColumn("at", F.last(F.when(F.col("begins"), F.struct("block", "n")), True).over(before))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]), "")
    joined = ends.groupBy("source_file", "at").agg(text.alias("text")).select("source_file", "at.block", "at.n", "text")
    found = parts.filter("whole").select("source_file", "block", "n", "text").union(joined)
    found = found.withColumn("text", F.substring(F.col("text"), F.lit(1), F.length("text") - 1)).filter("text <> ''")
    return plain.union(found) if False in kinds else found


def header_names(record: Column) -> Column:
    """The cells of a header, quotes and all: names are compared by letters and digits alone."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("[^"]*(?:""[^"]*)*"[^,]*|[^,]*)'), F.lit(1))


def csv_cells(record: Column, count: int) -> Column:
    """The first ``count`` cells of a record; null beyond its end, empty where there is nothing."""
    schema = ", ".join(f"c{i} string" for i in range(count))
    read = F.from_csv(F.concat(record, F.lit("," + MARK)), F.lit(schema), {"escape": '"', "maxCharsPerColumn": "-1"})
    # parsed once, whatever asks for its cells
    each = let(read, lambda r: F.array(*[r[f"c{i}"] for i in range(count)]))

    def told(cells: Column) -> Column:
        end = F.coalesce(F.array_position(cells, MARK), F.lit(0))
        return let(end, lambda at: F.transform(cells, lambda c, i: F.when(at.between(1, i + 1), F.lit(None)).otherwise(F.coalesce(c, F.lit("")))))

    return let(each, told)


class Tables:
    """The tables of a path. ``files`` has a row per file: source_file, names, error; ``rows`` the records
    behind the headers, (source_file, block, n, and what ``cell`` reads)."""

    def __init__(self, files: DataFrame, rows: DataFrame, cells, n_files: int):
        self.files, self._rows, self._cells, self._n = files, rows, cells, n_files
        #: of the rows that ``read`` took, (source_file, block, n)
        self.places: DataFrame | None = None

    @classmethod
    def of_csv(cls, spark: SparkSession, path: str) -> Tables:
        lines = csv_lines(spark, path)
        # a short row per split, kept: all that is asked of files is made of these
        splits = staged(csv_splits(lines))
        files, n = csv_files(splits), splits.count()
        records = csv_records(lines, splits, files, n)
        at = F.struct("block", "n")
        first = records.groupBy("source_file").agg(F.min_by("text", at).alias("header"), F.min(at).alias("first"))
        files = files.join(first, "source_file", "left").select("source_file", header_names(F.col("header")).alias("names"), "first", F.coalesce("error", F.when(F.col("header").isNull(), "no header")).alias("error"))
        return cls(files, records, csv_cells, n)

    @classmethod
    def of_sheets(cls, table: DataFrame, n_files: int) -> Tables:
        """Of rows (source_file, n, cells, error), the first of a file being its header."""
        rows = table.select("source_file", F.lit(0).cast("long").alias("block"), "n", "cells", "error")
        first = F.struct("block", "n")
        files = rows.groupBy("source_file").agg(F.min_by("cells", first).alias("names"), F.min(first).alias("first"), F.max("error").alias("e"))
        files = files.select("source_file", "names", "first", F.coalesce("e", F.when(F.size("names") < 1, "no header")).alias("error"))
        return cls(files, rows.filter("error is null").drop("error").withColumnRenamed("cells", "text"), lambda row, count: row, n_files)

    def placed(self, roles: dict[str, tuple[str, ...]], needed: dict[str, str]) -> DataFrame:
        """Files with each role's place, and an error where a needed one is missing (role: what to call it)."""
        at = self.files.withColumns({f"at_{r}": place_of(F.col("names"), names) for r, names in roles.items()})
        missing = [F.when(F.col(f"at_{r}").isNull(), f"no {what} column found") for r, what in needed.items()]
        return at.withColumn("error", F.coalesce("error", *missing))

    def read(self, roles: dict[str, tuple[str, ...]], needed: dict[str, str], strict: bool = True) -> DataFrame:
        """Rows (source_file, block, n, and a cell for each role, null where there is none).

        Files that lack a needed column are left out; if all do, raises ValueError where ``strict``.
        """
        placed = self.placed(roles, needed)
        widest = F.greatest(F.lit(1), *[F.coalesce(f"at_{r}", F.lit(0)) for r in roles])
        # one row: how many files can be read, the last column any of them needs
        told = placed.agg(F.count_if(F.col("error").isNull()).alias("good"), F.max(F.when(F.col("error").isNull(), widest)).alias("wide"), F.min(F.struct("source_file", "error")).alias("e")).first()
        if strict and not told["good"] and told["e"] is not None:
            raise ValueError(f"{told['e']['source_file']}: {told['e']['error']}")
        own = placed.filter("error is null").select("source_file", "first", *[f"at_{r}" for r in roles])
        rows = by_file(self._rows, own, self._n).filter(F.struct("block", "n") > F.col("first"))
        self.places = rows.select("source_file", "block", "n")
        cells = rows.withColumn("cells", self._cells(F.col("text"), told["wide"] or 1))
        return cells.select("source_file", "block", "n", *[F.get("cells", F.col(f"at_{r}") - 1).alias(r) for r in roles])


def in_order(rows: DataFrame, found: Tables, *columns: str) -> DataFrame:
    """Adds ``record_idx`` to rows that ``found`` has read: by file name, then by place. A row per split of a file is summed up,
    before cells are parsed."""
    splits = found.places.groupBy("source_file", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    before = F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(Window.orderBy("source_file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = splits.select("source_file", "block", (before - F.col("low")).alias("shift"))
    return rows.join(F.broadcast(shift) if found._n <= FEW else shift, ["source_file", "block"]).select(*columns, (F.col("n") + F.col("shift")).cast("long").alias("record_idx"))
