"""Coverage of circular references by reads, placed by exact 18-nt seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insertframe.functions import seq

SEED = 18


def seed_index(references: DataFrame, key: str = "ref_id") -> DataFrame:
    """Rows (key, seed, at): the first place of every seed on a circular reference (key, ref).

    A reference's seeds are made in one task, so their minima are whole before they are shuffled.
    """
    # every stretch of the circle in one pass; a short reference is read round once, not more often
    circle = F.concat("ref", F.left("ref", F.lit(SEED - 1)))
    seeds = F.regexp_extract_all(circle, F.lit(f"(?=(.{{{SEED}}}))"), F.lit(1))
    return references.select(key, F.posexplode(seeds).alias("at", "seed")).groupBy(key, "seed").agg(F.min("at").alias("at"))


#: So many distinct reads of a reference at most are sought in its letters; more go by the index of its seeds.
FEW = 256


def anchors(reads: DataFrame, references: DataFrame, key: str = "ref_id") -> DataFrame:
    """Rows (key, start, span, n, times): where reads (key, read) begin on their reference (key, reference).

    The first 18 letters are sought on the circle, first of the read, then of its reverse complement;
    shorter reads and reads that are not found make no row. Reads of one start, strand and length are
    one row with their number. A read travels as its two seeds. A reference travels once and its few reads are
    sought in it where they meet; of references with many reads the seeds travel instead, and no read looks through the letters.
    Both ways give the same places.
    """
    refs = references.select(key, seq.clean(F.col("reference")).alias("ref")).filter(F.length("ref") > 0)
    r = reads.select(key, seq.clean(F.col("read")).alias("read")).filter(F.length("read") >= SEED)
    head = lambda s: F.left(s, F.lit(SEED))
    seeds = r.select(key, head(F.col("read")).alias("forward"), head(seq.revcomp(F.right("read", F.lit(SEED)))).alias("backward"), F.length("read").alias("span"))
    seeds = seeds.groupBy(key, "forward", "backward", "span").agg(F.count("*").alias("times"))
    deep = seeds.groupBy(key).agg(F.count("*").alias("m")).filter(F.col("m") > FEW).select(key)

    found = ["start", "span", "n", "times"]
    n, ref = F.length("ref"), F.col("ref")
    circle = F.concat(ref, F.left(ref, F.lit(SEED - 1)))
    at = lambda strand: F.nullif(F.call_function("instr", F.col("circle"), F.col(strand)), F.lit(0)) - 1
    shallow = seeds.join(deep, key, "left_anti").join(refs.select(key, n.alias("n"), circle.alias("circle")), key)
    few = shallow.select(key, F.coalesce(at("forward"), at("backward")).alias("start"), F.least("span", "n").alias("span"), "n", "times")

    crowded = refs.join(deep, key, "left_semi")
    index = seed_index(crowded, key)
    place = lambda strand: index.select(key, F.col("seed").alias(strand), F.col("at").alias(f"at_{strand}"))
    met = seeds.join(deep, key, "left_semi").join(place("forward"), [key, "forward"], "left").join(place("backward"), [key, "backward"], "left")
    met = met.withColumn("start", F.coalesce("at_forward", "at_backward")).filter("start is not null").join(crowded.select(key, n.alias("n")), key)
    many = met.select(key, "start", F.least("span", "n").alias("span"), "n", "times")
    return few.filter("start is not null").select(key, *found).union(many.select(key, *found))


def stretches(reads: DataFrame, references: DataFrame, key: str = "ref_id") -> DataFrame:
    """Rows (key, pos, width, n, depth): the stretches of one depth that every reference (of ``n`` letters) falls into.

    Reads become +1 and -1 steps, so a read is two rows whatever its length; a running sum over
    the steps that were counted per position gives the depth up to the next step. No row is made of a position.
    """
    found = anchors(reads, references, key)
    end, n = F.col("start") + F.col("span"), F.col("n")
    wraps = end > n
    # up at the start, down at the end; round the circle once more up at 0
    steps = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")),
        F.struct(F.when(wraps, n).otherwise(end).alias("pos"), F.lit(-1).alias("d")),
        F.struct(F.lit(0).alias("pos"), F.when(wraps, 1).otherwise(0).alias("d")),
        F.struct(F.when(wraps, end - n).otherwise(0).alias("pos"), F.when(wraps, -1).otherwise(0).alias("d")),
    )
    moved = found.select(key, "times", F.explode(steps).alias("s")).select(key, F.col("s.pos").alias("pos"), (F.col("s.d") * F.col("times")).alias("d"), F.lit(None).cast("int").alias("n"))
    # every reference begins at 0 and is as long as it is, with reads or without
    whole = references.select(key, F.lit(0).alias("pos"), F.lit(0).cast("long").alias("d"), F.length(seq.clean(F.col("reference"))).alias("n")).filter("n > 0")
    counted = moved.union(whole).groupBy(key, "pos").agg(F.sum("d").alias("d"), F.max("n").alias("n"))
    along = Window.partitionBy(key).orderBy("pos")
    depth = F.sum("d").over(along).cast("int")
    size = F.first("n", ignorenulls=True).over(along)
    rows = counted.select(key, "pos", F.lead("pos").over(along).alias("next"), size.alias("n"), depth.alias("depth"))
    # what steps down at the end is no stretch
    return rows.filter("pos < n").select(key, "pos", (F.coalesce("next", "n") - F.col("pos")).alias("width"), "n", "depth")


def depth(reads: DataFrame, references: DataFrame, key: str = "ref_id") -> DataFrame:
    """Rows (key, pos, depth) for every position of every reference, made of its stretches where they are."""
    rows = stretches(reads, references, key)
    return rows.select(key, F.explode(F.sequence("pos", F.col("pos") + F.col("width") - 1)).alias("pos"), "depth")


def statistics(depths: DataFrame, key: str = "ref_id") -> DataFrame:
    """Rows (key, length, mean, max, breadth) of positions (key, pos, depth) or of stretches."""
    width = F.col("width").cast("long") if "width" in depths.columns else F.lit(1).cast("long")
    covered, length, total = F.sum(F.when(F.col("depth") > 0, width).otherwise(0)), F.sum(width), F.sum(F.col("depth") * width)
    return depths.groupBy(key).agg(length.alias("length"), (total / length).alias("mean"), F.max("depth").alias("max"), (covered / length).alias("breadth"), total.alias("total"), covered.alias("covered"))


def chart(depths: DataFrame, columns: int, key: str = "ref_id") -> DataFrame:
    """The largest depth in each of ``columns`` equal parts, of positions (key, pos, depth) or of stretches."""
    if "width" not in depths.columns:
        depths = depths.withColumns({"n": F.count("*").over(Window.partitionBy(key)), "width": F.lit(1)})
    part = lambda pos: F.floor(pos.cast("long") * columns / F.col("n")).cast("int")
    rows = depths.withColumn("column", F.explode(F.sequence(part(F.col("pos")), part(F.col("pos") + F.col("width") - 1))))
    # of a reference shorter than the chart, columns without a position are no rows
    rows = rows.filter(part(F.ceil(F.col("column").cast("long") * F.col("n") / columns)) == F.col("column"))
    return rows.groupBy(key, "column").agg(F.max("depth").alias("depth"))


def construct(records: DataFrame) -> DataFrame:
    """Facts of assembled constructs (record_id, vector_seq, core, oh5_end, oh3_start): length, insert,
    the insert's GC share, ORF residues before the first stop, and the junction's 22 letters on either side."""
    whole = seq.assemble(F.col("vector_seq"), F.col("core"), F.col("oh5_end"), F.col("oh3_start"))
    lo = F.greatest(F.col("oh5_end") - 22, F.lit(0))
    return records.select(
        "record_id",
        F.length(whole).alias("total_bp"),
        F.length("core").alias("insert_bp"),
        seq.gc_fraction(F.col("core")).alias("gc"),
        F.length(seq.translate_to_stop(whole)).alias("orf_aa"),
        F.substring(whole, lo + 1, F.col("oh5_end") + 22 - lo).alias("junction"),
    )
