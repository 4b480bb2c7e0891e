"""What the corpus operators share: text primitives, staged tables, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Higher-order functions read what they close over for every element; an alias can be
    inlined into them by the optimizer, a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def unused(df: DataFrame, n: int) -> list[str]:
    """Column names that a table does not have, in whatever case."""
    there, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"own_{i}" not in there:
            out.append(f"own_{i}")
        i += 1
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="insertframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they can import it."""
    context = spark.sparkContext
    if getattr(context, "_insertframe_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="insertframe-")) / f"insertframe-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(str(path))
    context._insertframe_shipped = True


class Stage:
    """Tables written to the shared folder to cut lineage; lost executors lose none of them.

    ``drop`` removes one that nothing reads any more; what is left goes when Python ends.
    A table once written, the shuffles that made it are dead, but Spark keeps their files until the
    driver collects its garbage: ``release`` asks it to.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session is gone, and its shared folder is the cluster's to clear
            pass
