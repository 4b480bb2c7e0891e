"""What the jobs share: their config, their command line, and mapping tables to the columns they know."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def default_config(name: str) -> dict:
    """The config that is shipped beside a job's file."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def read_config(spark: SparkSession, path: str) -> dict:
    """A config from wherever Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def mapped(table: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """A table's rows under the names a job knows, by SQL expressions from its config."""
    rows = table.filter(where) if where else table
    return rows.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def prepared(spark: SparkSession, path: str, schema: str, partitions: list[str]) -> None:
    """Makes an empty table of a folder that isn't there; leaves one that is."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)


def main(name: str, about: str, arguments: dict[str, str], work: Callable[..., dict]) -> None:
    """Creates and stops the session around ``work(spark, config, **arguments)``."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for a, said in arguments.items():
        parser.add_argument(f"--{a}", required=True, help=said)
    parser.add_argument("--config", help=f"a JSON file; jobs/{name}.json if not given")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        path = given.pop("config")
        print(json.dumps(work(spark, read_config(spark, path) if path else default_config(name), **given)))
    finally:
        spark.stop()
