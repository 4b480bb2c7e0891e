"""Constructs behind verdicts: the ordered insert in its vector, its features, its reads' coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insertframe.functions import seq
from insertframe.operators import coverage
from insertframe.operators.library import Library, Project, first_wins
from insertframe.operators.naming import DEFAULT, parse_name, upper_col
from insertframe.operators.order_qc import _case, order_cores


def insert_window(oh5_end: Column, core_len: Column) -> Column:
    """The half-open stretch of the insert in its construct, as (start, end)."""
    return F.struct(oh5_end.alias("start"), (oh5_end + core_len).alias("end"))


def ordered(verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """Verdicts with ``sequence``, that of the first ordered record of their id; others go."""
    first = first_wins(records, ["record_id"], "record_idx", ["sequence"])
    return verdicts.join(first, "record_id")


def _placed(rows: DataFrame, library: Library, project: Project) -> DataFrame:
    """Rows with a ``locus`` get its assigned vector and overhangs; those whose locus has none go."""
    own = library.overhang_sets.get(project.overhang_set, {})
    found = {x: library.vector(project.assignments.get(c)) for x, c in seq.CLASS_OF.items()}
    dim = [(x, v.id, v.clean, v.oh5_end, v.oh3_start, *(e or "" for e in own.get(x, (None, None)))) for x, v in found.items() if v is not None]
    # three rows at most
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(dim, "locus string, vector_id string, vector_seq string, oh5_end int, oh3_start int, oh5 string, oh3 string")), "locus")


def build_construct(verdicts: DataFrame, records: DataFrame, library: Library, project: Project, has_overhangs: bool = True) -> DataFrame:
    """A row per order verdict whose construct can be built: its record, locus, vector and core.

    The locus is that of the chain's class; of a chain that is only light, or unknown, that of the
    overhangs. A record without both overhangs, a locus without a vector and a project
    without an overhang set give no row.
    """
    own, most = library.overhang_sets.get(project.overhang_set), library.alignment.overhang_max_mismatch
    if own is None:
        verdicts, own = verdicts.filter(F.lit(False)), {}
    sequence, chain = F.col("sequence"), F.col("chain_class")
    known = F.coalesce(*[F.when(chain == c, x) for x, c in seq.CLASS_OF.items()])
    rows = ordered(verdicts, records).select("record_id", "sequence", F.coalesce(known, seq.locus_from_overhangs(sequence, own, most)).alias("locus"))
    rows = _placed(rows, library, project)
    if has_overhangs:
        core = seq.let(seq.strip_overhangs(sequence, F.col("oh5"), F.col("oh3"), most), lambda st: F.when(st["oh5_present"] & st["oh3_present"], st["core"]))
    else:
        core = seq.clean(sequence)
    rows = rows.select("record_id", "locus", "vector_id", "vector_seq", "oh5_end", "oh3_start", core.alias("core")).filter("core is not null")
    return rows.withColumn("window", insert_window(F.col("oh5_end"), F.length("core")))


def facts(constructs: DataFrame) -> DataFrame:
    """Lengths, GC of the insert, ORF and junction of ``build_construct``'s rows."""
    return coverage.construct(constructs)


def features(constructs: DataFrame, library: Library) -> DataFrame:
    """Rows (record_id, name, start, end), 0-based and half-open: the insert, and the vector's own
    features, each end at or beyond the insertion site moved on by the insert's length."""
    rows = constructs.select("record_id", "vector_id", "oh3_start", "window", F.length("core").alias("insert_bp"))
    insert = F.struct(F.lit("insert").alias("name"), F.col("window.start").alias("start"), F.col("window.end").alias("end"))
    moved = lambda at: F.lit(at) + F.when(F.lit(at) >= F.col("oh3_start"), F.col("insert_bp")).otherwise(0)
    parts = F.array(insert)
    for v in library.vectors:
        spans = [F.struct(F.lit(role.replace("_", " ")).alias("name"), moved(max(f["start"] - 1, 0)).alias("start"), moved(f["end"]).alias("end")) for role, f in sorted(v.features.items())]
        if spans:
            parts = F.when(F.col("vector_id") == v.id, F.array(insert, *spans)).otherwise(parts)
    return rows.select("record_id", F.explode(parts).alias("f")).select("record_id", "f.*")


def references_for(verdicts: DataFrame, records: DataFrame, library: Library, project: Project, has_overhangs: bool = True) -> DataFrame:
    """Rows (ref_id, ab_key, chain, locus, vector_id, core, reference): what the reads of a verdict's
    antibody should cover, one for each antibody and chain of heavy or not.

    The core is the ordered one of the first of heavy, kappa and lambda that the antibody has; a heavy
    verdict takes a heavy core alone.
    """
    heavy = F.col("chain_class") == "heavy"
    wanted = verdicts.select(upper_col(F.col("ab_id")).alias("ab_key"), F.when(heavy, "heavy").otherwise("other").alias("chain")).distinct()
    locus = _case(F.col("core_class"), {seq.CLASS_OF[x]: x for x in seq.LOCI}, "string")
    cores = order_cores(records, library, project, has_overhangs).withColumn("locus", locus).filter("locus is not null")
    fit = wanted.join(cores, "ab_key").filter((F.col("chain") != "heavy") | (F.col("locus") == "IGH"))
    # loci in the order of their names
    best = first_wins(fit, ["ab_key", "chain"], "locus", ["locus", "core"])
    rows = _placed(best, library, project)
    whole = seq.assemble(F.col("vector_seq"), F.col("core"), F.col("oh5_end"), F.col("oh3_start"))
    return rows.select(F.concat_ws("/", "ab_key", "chain").alias("ref_id"), "ab_key", "chain", "locus", "vector_id", "core", whole.alias("reference")).filter("reference <> ''")


def reads_of(references: DataFrame, reads: DataFrame, library: Library) -> DataFrame:
    """Rows (ref_id, read): all reads whose names, by the library's first profile, give the
    reference's antibody in whatever case."""
    profile = next(iter(library.profiles.values()), DEFAULT)
    named = reads.select(upper_col(parse_name(F.col("record_id"), profile)["ab_id"]).alias("ab_key"), F.col("sequence").alias("read"))
    return references.select("ref_id", "ab_key").join(named, "ab_key").select("ref_id", "read")


def coverage_for(verdicts: DataFrame, records: DataFrame, reads: DataFrame, library: Library, project: Project, has_overhangs: bool = True) -> DataFrame:
    """Rows (ref_id, pos, depth): how often the reads of a verdict's antibody cover its construct.

    ``ref_id`` is the antibody in upper case with ``/heavy`` or ``/other``. Constructs without
    a read of their antibody give no row.
    """
    references = references_for(verdicts, records, library, project, has_overhangs)
    own = reads_of(references, reads, library)
    return coverage.depth(own, references.join(own.select("ref_id").distinct(), "ref_id", "left_semi"), "ref_id")
