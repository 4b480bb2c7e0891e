"""Releases an order: which ordered fragments are right, and which antibodies may go to the vendor.

    python -m jobs.order_release --tables DIR --order 2024-17 --out DIR [--config FILE]

Reads the order's table and the panel's, runs order QC on every record, and writes, all in
folders of the order's own:

    OUT/verdicts/order=ID/severity=.../    Parquet: a row per record
    OUT/antibodies/order=ID/released=.../  Parquet: chains, failures and the decision of each antibody
    OUT/release/order=ID/                  CSV: the sequences of the released antibodies, to be sent

An antibody is released if it has at least ``min_chains`` records and all of them pass. A rerun
overwrites the order's folders, and only those, with the same rows. The rollup takes counts and minima, which are summed
up before they are shuffled, so an antibody with any share of the rows gathers nothing.

The config maps the tables' columns to (record_idx, record_id, sequence) and (ab_id, heavy, light,
idx) by SQL expressions, and holds the library: vectors, overhang sets, naming profiles, thresholds.
Records with a null id or sequence are judged as empty ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from insertframe.functions import seq
from insertframe.operators import library, order_qc, rollup
from jobs.common import log, main, mapped


def _records(spark: SparkSession, tables: str, spec: dict) -> DataFrame:
    return mapped(spark.read.format(spec["format"]).load(f"{tables}/{spec['table']}"), spec["columns"], spec.get("where"))


def antibodies(verdicts: DataFrame, min_chains: int) -> DataFrame:
    """Rows (ab_id, n_chains, n_failed, first_failed, released)."""
    failed = ~F.col("kind").isin(*order_qc.PASSING)
    sums = verdicts.groupBy("ab_id").agg(
        F.count("*").alias("n_chains"),
        F.count_if(failed).alias("n_failed"),
        F.min(F.when(failed, F.struct("record_idx", "record_id", "kind"))).alias("first"),
    )
    shown = F.concat(F.col("first.record_id"), F.lit(": "), F.col("first.kind"))
    return sums.select("ab_id", "n_chains", "n_failed", shown.alias("first_failed"), ((F.col("n_failed") == 0) & (F.col("n_chains") >= min_chains)).alias("released"))


def run(spark: SparkSession, config: dict, tables: str, order: str, out: str) -> dict:
    """Judges the order and writes its folders; returns how many rows were read and written."""
    lib = library.Library.from_json5(json.dumps(config["library"]))
    project = library.Project.ad_hoc(lib)
    at = {name: f"{out.rstrip('/')}/{name}/order={order}" for name in ("verdicts", "antibodies", "release")}

    seen, told, summed, sent = (Observation(x) for x in ("read", "judged", "antibodies", "released"))
    records = _records(spark, tables, config["order"])
    own = records.withColumns({"record_id": F.coalesce("record_id", F.lit("")), "sequence": F.coalesce("sequence", F.lit(""))})
    panel = _records(spark, tables, config["panel"]) if config.get("panel") else None
    log.info("order %s: reading %s/%s", order, tables, config["order"]["table"])
    judged = order_qc.run(own.observe(seen, F.count("*").alias("n")), lib, project, panel, has_overhangs=config.get("has_overhangs", True))
    judged = judged.withColumn("severity", rollup.severity(F.col("kind"))).observe(told, F.count("*").alias("n"))
    judged.write.mode("overwrite").partitionBy("severity").parquet(at["verdicts"])
    log.info("read %d records, wrote %d verdicts to %s", seen.get["n"], told.get["n"], at["verdicts"])

    # the verdicts are read back: what was judged is not judged again
    verdicts = spark.read.schema(judged.schema).parquet(at["verdicts"])
    decided = antibodies(verdicts, config["min_chains"]).observe(summed, F.count("*").alias("n"), F.count_if("released").alias("released"))
    decided.write.mode("overwrite").partitionBy("released").parquet(at["antibodies"])
    log.info("wrote %d antibodies, %d of them released, to %s", summed.get["n"], summed.get["released"], at["antibodies"])

    good = spark.read.schema(decided.schema).parquet(at["antibodies"]).filter("released").select("ab_id")
    chosen = verdicts.select("record_idx", "ab_id").join(good, "ab_id", "left_semi").select("record_idx")
    release = own.join(chosen, "record_idx", "left_semi").select("record_idx", "record_id", seq.clean(F.col("sequence")).alias("sequence")).observe(sent, F.count("*").alias("n"))
    release.write.mode("overwrite").option("header", True).csv(at["release"])
    log.info("wrote %d sequences to %s", sent.get["n"], at["release"])
    return {"read": seen.get["n"], "verdicts": told.get["n"], "antibodies": summed.get["n"], "released": summed.get["released"], "sent": sent.get["n"]}


def written(spark: SparkSession, out: str) -> DataFrame:
    """All orders' output: a row per record with its antibody's decision and the length that is sent."""
    base = out.rstrip("/")
    kinds = "record_idx long, record_id string, ab_id string, chain_class string, kind string, core_len int, severity string, order string"
    verdicts = spark.read.schema(kinds).parquet(f"{base}/verdicts")
    decided = spark.read.schema("ab_id string, n_chains long, n_failed long, first_failed string, released boolean, order string").parquet(f"{base}/antibodies")
    sent = spark.read.schema("record_idx long, record_id string, sequence string, order string").option("header", True).csv(f"{base}/release")
    lengths = sent.select("order", "record_idx", F.length(F.coalesce("sequence", F.lit(""))).alias("sent_length"))
    return verdicts.join(decided, ["order", "ab_id"]).join(lengths, ["order", "record_idx"], "left")


if __name__ == "__main__":
    main("order_release", __doc__.split("\n")[0], {"tables": "the folder of the tables", "order": "the order's id", "out": "where to write"}, run)
