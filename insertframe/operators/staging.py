"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in ``spark.checkpoint.dir``, so that lost executors lose none.

    A folder of our own is set only where the session names none and runs on one machine.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="insertframe-")
        context.setCheckpointDir(path)
    return df.checkpoint()
