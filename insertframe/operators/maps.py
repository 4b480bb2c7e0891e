"""Vectors from any number of GenBank maps, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insertframe.functions import seq
from insertframe.sources.genbank import roles_column

PLACE = "struct<start:int,end:int,name:string>"


def vectors_of_maps(records: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Vectors of maps (as ``genbank.read`` gives them) for the requests (source_file, vector_id,
    chain_class, oh5, oh3): a row per request whose map can be read. Without requests each record has its own in
    columns of these names, and nothing is shuffled.

    The insertion ends are where the overhangs stand in the map; without the 5' one, the signal
    peptide's end (0 if there is none); without the 3' one, the constant region's start, else the 5'
    end. The anchor is the first eight residues from the 3' end, up to a stop.

    Columns: source_file, vector_id, chain_class, topology, length, sequence, sha256, oh5_end, oh3_start,
    constant_anchor_aa, features (role to place), map_name. An empty or null overhang is none.
    """
    asked = ["vector_id", "chain_class", "oh5", "oh3"]
    features = F.map_from_entries(F.transform(roles_column(F.col("features")), lambda x: F.struct(x["role"], F.struct(x["start"], x["end"], x["name"])))).cast(f"map<string,{PLACE}>")
    maps = records.filter("error is null").select(
        "source_file", *([] if requests is not None else asked), seq.clean(F.col("sequence")).alias("sequence"), F.col("name").alias("map_name"),
        F.when(F.col("circular"), "circular").otherwise("linear").alias("topology"), features.alias("features"),
    )
    rows = maps if requests is None else requests.join(maps, "source_file")
    place = lambda overhang: F.when(F.length(overhang) > 0, F.nullif(F.instr(F.col("sequence"), F.col(overhang)), F.lit(0)))
    at5, at3 = place("oh5"), place("oh3")
    end5 = F.coalesce(at5 - 1 + F.length("oh5"), F.col("features")["signal_peptide"]["end"], F.lit(0))
    rows = rows.withColumn("oh5_end", end5.cast("int"))
    # features have places from 1 on
    start3 = F.coalesce(at3 - 1, F.col("features")["constant_region"]["start"] - 1, F.col("oh5_end"))
    rows = rows.withColumn("oh3_start", start3.cast("int"))
    anchor = F.left(seq.translate_to_stop(F.substring(F.col("sequence"), F.col("oh3_start") + 1, F.length("sequence"))), F.lit(8))
    none = F.create_map().cast(f"map<string,{PLACE}>")
    return rows.select(
        "source_file", "vector_id", "chain_class", "topology", F.length("sequence").alias("length"), "sequence", F.sha2("sequence", 256).alias("sha256"),
        "oh5_end", "oh3_start", anchor.alias("constant_anchor_aa"), F.coalesce("features", none).alias("features"), "map_name",
    )
