"""Takes new sequence files into a registry of constructs: only new files, each once.

    python -m jobs.registry_intake --source DIR --out DIR --checkpoint DIR [--config FILE]

A file stream lists the source; its checkpoint knows the files of earlier runs, so a run
(``availableNow``) takes what has come since. Each batch of files is merged additively:

* a sequence that the registry doesn't have is entered,
* one that it has under the same id is skipped,
* one that it has under another id is entered as well, and reported with the first id.

It writes, for batch N:

    OUT/registry/batch=N/chain_class=.../  Parquet: entries with what can be told of the sequence alone
    OUT/conflicts/batch=N/                 Parquet: entries whose sequence has another, earlier id
    OUT/antibodies/batch=N/                Parquet: the batch's share of each antibody's counts

A batch that was stopped is run again under its number: it is merged with earlier batches alone and
overwrites its own folders, so nothing is entered or counted twice. ``antibodies`` sums the shares up, so
no run touches what earlier ones wrote. Of equal sequences in one batch the one of least idx is the
first, of earlier batches the earliest.

A hash's first entry is a partial minimum and no hash or antibody gathers its rows; the registry is read
by its hashes alone, and only entries whose hash arrives again take part in the merge.

The config maps the files' columns to (id, idx, sequence) by SQL expressions. Null ids and
sequences count as empty, a null idx as 0; an empty sequence is one like any other. Files that were taken and change later are not read again.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from insertframe.functions import seq
from insertframe.operators import library, naming
from jobs.common import log, main, mapped, prepared

REGISTRY = "id string, idx long, ab_id string, sha256 string, n long, kind string, gc double, max_gc double, protein_length long, sequence string, batch long, chain_class string"
CONFLICTS = "id string, sha256 string, existing_id string, batch long"
ANTIBODIES = "ab_id string, chain_class string, n_entries long, shortest long, longest long, batch long"


def facts(rows: DataFrame, gc_window: int) -> DataFrame:
    """Entries of rows (id, idx, sequence): names, hash, and what can be told of the sequence alone."""
    named = naming.with_names(rows.withColumns({"id": F.coalesce("id", F.lit("")), "sequence": seq.clean(F.coalesce("sequence", F.lit("")))}), id_col="id")
    s = F.col("sequence")
    return named.select(
        "id",
        F.coalesce(F.col("idx").cast("long"), F.lit(0)).alias("idx"),
        "ab_id",
        seq.sha256_hex(s).alias("sha256"),
        F.length(s).cast("long").alias("n"),
        seq.detect_type(s).alias("kind"),
        F.round(seq.gc_fraction(s), 6).alias("gc"),
        F.round(seq.max_windowed_gc(s, gc_window), 6).alias("max_gc"),
        F.length(seq.best_frame_protein(s)).cast("long").alias("protein_length"),
        "sequence",
        "chain_class",
    )


def _table(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{name}")


def take(batch: DataFrame, number: int, out: str, config: dict) -> dict:
    """Merges one batch into the registry; returns how many rows it read and wrote."""
    spark = batch.sparkSession
    at = {name: f"{out.rstrip('/')}/{name}/batch={number}" for name in ("registry", "conflicts", "antibodies")}
    seen, entered, told = (Observation(f"{x}-{number}") for x in ("read", "entered", "conflicts"))
    # told of each sequence once; kept on the executors' disks, as the merge reads them several times
    incoming = facts(mapped(batch.observe(seen, F.count("*").alias("n")), config["columns"]), config["gc_window"]).persist(StorageLevel.DISK_ONLY)
    try:
        known = _table(spark, out, "registry", REGISTRY).filter(F.col("batch") < number).select("sha256", "id", "batch", "idx")
        known = known.join(incoming.select("sha256").distinct(), "sha256", "left_semi")
        firsts = known.groupBy("sha256").agg(F.min(F.struct("batch", "idx", "id")).alias("f")).select("f.id", "sha256", "f.idx")
        rows, conflicts = library.merge(firsts, incoming)
        rows.observe(entered, F.count("*").alias("n")).write.mode("overwrite").partitionBy("chain_class").parquet(at["registry"])
        conflicts.observe(told, F.count("*").alias("n")).write.mode("overwrite").parquet(at["conflicts"])
    finally:
        incoming.unpersist()
    mine = spark.read.schema(REGISTRY).parquet(at["registry"])
    shares = mine.groupBy("ab_id", "chain_class").agg(F.count("*").alias("n_entries"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    shares.write.mode("overwrite").parquet(at["antibodies"])
    counts = {"read": seen.get["n"], "entered": entered.get["n"], "conflicts": told.get["n"]}
    log.info("batch %d: read %d rows, entered %d, %d of them under a second id, in %s", number, *counts.values(), out)
    return counts


def run(spark: SparkSession, config: dict, source: str, out: str, checkpoint: str) -> dict:
    """Takes what is new in ``source``; returns the sums over the batches of this run."""
    schema = config.get("schema") or spark.read.format(config["format"]).options(**config.get("options", {})).load(source).schema
    stream = spark.readStream.format(config["format"]).options(**config.get("options", {})).schema(schema).load(source)
    for name, columns in (("registry", REGISTRY), ("conflicts", CONFLICTS), ("antibodies", ANTIBODIES)):
        prepared(spark, f"{out.rstrip('/')}/{name}", columns, ["batch"])
    done: list[dict] = []
    log.info("taking what is new in %s", source)
    query = stream.writeStream.foreachBatch(lambda df, n: done.append(take(df, n, out, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    sums = {k: sum(x[k] for x in done) for k in ("read", "entered", "conflicts")} | {"batches": len(done)}
    log.info("took %(batches)d batches: read %(read)d rows, entered %(entered)d, %(conflicts)d conflicts", sums)
    return sums


def antibodies(spark: SparkSession, out: str) -> DataFrame:
    """Rows (ab_id, chain_class, n_entries, shortest, longest) over all batches."""
    shares = _table(spark, out, "antibodies", ANTIBODIES)
    return shares.groupBy("ab_id", "chain_class").agg(F.sum("n_entries").alias("n_entries"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))


def written(spark: SparkSession, out: str) -> DataFrame:
    """The registry as it stands: entries with the earlier id of their sequence, and their antibody's counts."""
    entries = _table(spark, out, "registry", REGISTRY)
    # a conflict is of an entry: rows that repeat an id and a sequence have one each
    conflicts = _table(spark, out, "conflicts", CONFLICTS).distinct()
    return entries.join(conflicts, ["batch", "id", "sha256"], "left").join(antibodies(spark, out), ["ab_id", "chain_class"])


if __name__ == "__main__":
    main("registry_intake", __doc__.split("\n")[0], {"source": "a folder of files, or a pattern of paths", "out": "where to write", "checkpoint": "the stream's checkpoint"}, run)
