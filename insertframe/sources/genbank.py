"""GenBank records: locus, features with qualifiers, sequence; and the roles of features."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insertframe.functions.seq import let

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "source_file string, name string, length int, circular boolean, sequence string, features array<struct<kind:string,start:int,end:int,complement:boolean,qualifiers:map<string,string>>>, error string"


def location(text: str) -> tuple[int, int, bool]:
    """The outermost 1-based ends of a location, and whether it is on the other strand; 0, 0 if none."""
    spans = [[int(n) for n in re.findall(r"\d+", part)] for part in re.split(r"[^0-9.]+", text)]
    ends = [(min(s[0], s[-1]), max(s[0], s[-1])) for s in spans if s]
    if not ends:
        return 0, 0, False
    return min(a for a, _ in ends), max(b for _, b in ends), "complement" in text


def parse(text: str) -> dict:
    """One record, up to its ``//``; raises ValueError where there is no sequence.

    Repeated qualifiers keep the last value; continued lines join it with a space.
    """
    text = re.split(r"(?m)^//", text, maxsplit=1)[0]
    locus = re.search(r"(?m)^LOCUS.*$", text)
    words = locus[0].split() if locus else []
    size = next((int(a) for a, b in zip(words, words[1:]) if b == "bp" and a.isdigit()), 0)
    sections = re.split(r"(?m)^(FEATURES|ORIGIN)[^\n]*\n?", text)
    of = dict(zip(sections[1::2], sections[2::2]))
    sequence = re.sub("[^A-Za-z]", "", of.get("ORIGIN", "")).upper()
    if not sequence:
        raise ValueError("no ORIGIN sequence found")
    features: list[dict] = []
    key = None
    for raw in of.get("FEATURES", "").splitlines():
        line = raw.lstrip()
        if line and not line.startswith("/") and len(raw) - len(line) <= 7:
            kind, _, place = line.partition(" ")
            start, end, complement = location(place)
            features.append({"kind": kind, "start": start, "end": end, "complement": complement, "qualifiers": {}})
            key = None
        elif features and line.startswith("/"):
            key, _, value = line[1:].partition("=")
            features[-1]["qualifiers"][key] = value.strip('"')
        elif features and key is not None:
            own = features[-1]["qualifiers"]
            own[key] = (own[key] + " " if own[key] else "") + line.strip('"')
    return {"name": words[1] if len(words) > 1 else "", "length": size or len(sequence), "circular": bool(locus) and "circular" in locus[0].lower(), "sequence": sequence, "features": features}


#: So many records are parsed before they are handed on: what a worker holds beside its batch.
TOGETHER = 256


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), TOGETHER):
            pdf, rows = whole.iloc[at : at + TOGETHER], []
            for path, content in zip(pdf["source_file"], pdf["content"]):
                try:
                    text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                    rows.append({"source_file": path, **parse(text), "error": None})
                except ValueError as e:
                    rows.append({"source_file": path, "name": None, "length": None, "circular": None, "sequence": None, "features": None, "error": str(e)})
            yield pd.DataFrame(rows).astype({"length": "Int32", "circular": "boolean"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per file, of its first record; files that can't be read have an ``error`` and no record."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")
    return files.mapInPandas(_parse_files, SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of flat files that hold any number of them; records that can't be read have an ``error``.

    The reader splits at the ``//`` that ends a record, so a file of any size is read by many tasks.
    """
    parts = spark.read.format("text").option("lineSep", "\n//").load(path)
    records = parts.filter(F.col("value").rlike(r"\S")).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))
    return records.mapInPandas(_parse_files, SCHEMA)


# Words that tell a feature's role, tried in this order.
SIGNAL = ("signal peptide", "sig_peptide")
CONSTANT = ("c region", "ighg", "igha", "igkc", "iglc", "constant")
RESISTANCE = ("ampr", "kanr", "resistance")
ORIGIN = ("ori", "origin", "puc")


def role_of(kind: str, qualifiers: dict) -> str | None:
    own = qualifiers.get("standard_name", qualifiers.get("gene", qualifiers.get("note", "")))
    text = f"{kind} {own} {qualifiers.get('note', '')}".lower()
    has = lambda words: any(w in text for w in words)
    rules = (
        ("signal_peptide", has(SIGNAL)),
        ("constant_region", has(CONSTANT)),
        ("resistance", has(RESISTANCE) and "promoter" not in text),
        ("origin", has(ORIGIN)),
        ("promoter", "cmv" in text or ("promoter" in text and "ampr" not in text)),
    )
    return next((name for name, fits in rules if fits), None)


def roles(features: list[dict]) -> dict[str, dict]:
    """The first feature of each role, with its 1-based ends."""
    out: dict[str, dict] = {}
    for f in features:
        role = role_of(f["kind"], f["qualifiers"]) if f["start"] else None
        if role and role not in out:
            q = f["qualifiers"]
            out[role] = {"start": f["start"], "end": f["end"], "name": q.get("standard_name", q.get("gene", q.get("note")))}
    return out


def role_column(kind: Column, qualifiers: Column) -> Column:
    """``role_of`` as a column; null where there is none."""
    own = F.coalesce(qualifiers["standard_name"], qualifiers["gene"], qualifiers["note"], F.lit(""))
    text = F.lower(F.concat_ws(" ", kind, own, F.coalesce(qualifiers["note"], F.lit(""))))
    has = lambda words: text.rlike("|".join("\\Q" + w + "\\E" for w in words))
    return (
        F.when(has(SIGNAL), "signal_peptide")
        .when(has(CONSTANT), "constant_region")
        .when(has(RESISTANCE) & ~text.contains("promoter"), "resistance")
        .when(has(ORIGIN), "origin")
        .when(text.contains("cmv") | (text.contains("promoter") & ~text.contains("ampr")), "promoter")
    )


ROLES = ("signal_peptide", "constant_region", "resistance", "origin", "promoter")


def roles_column(features: Column) -> Column:
    """``roles`` as a column: an array of (role, start, end, name), the first feature of each role."""

    def told(f: Column) -> Column:
        q = f["qualifiers"]
        name = F.coalesce(q["standard_name"], q["gene"], q["note"])
        return F.struct(F.when(f["start"] > 0, role_column(f["kind"], q)).alias("role"), f["start"].alias("start"), f["end"].alias("end"), name.alias("name"))

    def of(all_: Column, role: str) -> Column:
        return F.get(F.filter(all_, lambda x: x["role"] == role), F.lit(0))

    return let(F.transform(features, lambda f: told(f)), lambda all_: F.filter(F.array(*[of(all_, r) for r in ROLES]), lambda x: x.isNotNull()))


def feature_roles(records: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, role, start, end, name) of any number of maps, by ``source_file`` if no keys are named: the first
    feature of each role, with its 1-based ends. Features without a place have no role. A record's roles are
    told where the record is: nothing is shuffled."""
    keys = keys or ("source_file",)
    return records.filter("error is null").select(*keys, F.explode(roles_column(F.col("features"))).alias("t")).select(*keys, "t.*")
