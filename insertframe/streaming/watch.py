"""A folder of FASTA files as a stream of verdicts: each new file is judged as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from insertframe.sources.tables import fasta_parts, fasta_records


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the parts of new FASTA files, as ``judge`` takes them. A file of any size is read by
    many tasks, split at its records."""
    return fasta_parts(spark.readStream, folder)


def judge(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a gate over the records of each micro-batch of files (record_id, sequence, source_file,
    record_idx, which counts within the batch as it would over a folder of its files); a batch's
    verdicts replace themselves if it is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        gate(fasta_records(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
