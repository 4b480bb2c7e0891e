"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as
Parquet and reads again as the next stage's documents. All but the last keep the columns of
``documents``.

1. quality: documents that the quality cascade rejects go.
2. lines: fuzzy repeated lines go, all but their first occurrence; a document that loses every
   line goes.
3. near_duplicates: of each SimHash component one document stays, the one of smallest doc_id.
4. decontamination: documents with a passage of a benchmark item go.
5. mixing: every document with its tokens, its domain posteriors and the rate at which it is
   to be drawn so that the domains' expected tokens meet the targets.

Columns but ``doc_id`` and ``text`` are not looked at by the stages (mixing keeps ``source``). An empty table
gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from insertframe.llm import decontaminate, linededup, mixing, quality, simhash
from insertframe.llm.common import Stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that all rules accept. A null or empty text has no words and is rejected; rows
    that repeat are each judged, and null keys stand for nothing."""
    return quality.filter_documents(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines, and without those that lose every line. Of equal or similar lines the
    first by key and number stays. Rows without a key keep all lines; a null text stays null; rows that repeat
    key and text are one document, so what stays in one stays in all."""
    return linededup.deduplicate(docs, **linededup.WHOLE)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest key of each component. Null and empty texts have fingerprint zero and are linked like
    any other; rows that repeat a kept key all stay; rows without a key stay."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of a benchmark item. Null and empty texts and items hold none; rows that
    repeat are each judged."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its rate. Null and empty texts have no tokens and the prior as posterior; rows that repeat a
    key, and null keys, are documents of their own; labels without a domain teach nothing."""
    return mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SimHash, alignment and the fit are beyond SQL. The tests hold the operators behind the stages against brute force,
#: and the stages by their counts and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = stage.put(apply(spark, docs, sf_dir), name)
        if k:
            stage.drop(STAGES[k - 1][0])
    return docs
