"""ABIF (AB1) trace files: base calls and their qualities."""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRY = ">4sihhiii"


def parse(data: bytes) -> tuple[str, bytes | None]:
    """Base calls (edited ones, tag number 2, before others) and qualities; ValueError if none."""
    if len(data) < 34 or data[:4] != b"ABIF":
        raise ValueError("not an ABIF/AB1 file (bad magic)")
    count, start = struct.unpack_from(ENTRY, data, 6)[4], struct.unpack_from(ENTRY, data, 6)[6]
    calls: dict[bool, str] = {}
    quality = None
    for at in range(start, start + 28 * max(count, 0), 28):
        if at < 0 or at + 28 > len(data):
            break
        name, number, kind, _, _, size, offset = struct.unpack_from(ENTRY, data, at)
        # values of up to four bytes stand in the offset's place
        begin = at + 20 if size <= 4 else offset
        if begin < 0 or begin + max(size, 0) > len(data):
            continue
        value = data[begin : begin + max(size, 0)]
        if name == b"PBAS":
            calls.setdefault(number == 2, re.sub("[^A-Za-z]", "", value.decode("latin-1")))
        elif name == b"PCON" and kind in (1, 2):
            quality = value
    if not calls:
        raise ValueError("no PBAS base-call tag found")
    return calls[True] if True in calls else calls[False], quality


#: Files that are parsed at once: what a worker holds beside its Arrow batch.
TOGETHER = 256
SCHEMA = pa.schema([("source_file", pa.string()), ("bases", pa.string()), ("quality", pa.binary()), ("error", pa.string())])


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part, rows = batch.slice(at, TOGETHER), []
            for path, content in zip(part.column("source_file"), part.column("content")):
                try:
                    bases, quality = parse(content.as_py())
                    rows.append((path.as_py(), bases, quality, None))
                except ValueError as e:
                    rows.append((path.as_py(), None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source_file, record_id, bases, quality, error); the id is the file's stem."""
    return of_files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content"))


def of_files(files: DataFrame) -> DataFrame:
    """The same of rows (source_file, content), wherever they come from."""
    out = files.select("source_file", "content").mapInArrow(_parse_files, "source_file string, bases string, quality binary, error string")
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return out.select("source_file", stem.alias("record_id"), "bases", "quality", "error")
