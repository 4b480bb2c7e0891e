"""Sequencing QC: does each read show the intended construct?

Reads are oriented by an Arrow kernel against the few library vectors; expected proteins come
from equi-joins with the order's cores and the panel; the verdict is one ordered CASE. Each
alignment runs only for reads that reach it: those that the verdict doesn't look at are aligned for the columns that
show them, in a step of their own that goes where these columns aren't asked for. A read that is as expected is
not aligned where the scores prove the diagonal best. The search for swapped samples pairs only reads with
substitutions with the panel, distinct proteins once; for it the reads' own columns are computed once
and kept in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insertframe.functions import kernels, seq
from insertframe.operators.library import Library, Project, vectors_frame
from insertframe.operators.naming import DEFAULT, upper_col, with_names
from insertframe.operators.order_qc import _case, panel, truth_protein
from insertframe.operators.staging import staged

PASSING = ("PASS", "SILENT_VARIANT")
# Severity ranks of verdicts, worst first.
RANK = {"WRONG_VECTOR": 7, "EMPTY_VECTOR": 6, "JUNCTION_FRAMESHIFT": 5, "WRONG_INSERT_SWAP": 4, "POINT_MUTATION": 3, "SILENT_VARIANT": 2, "INSUFFICIENT_READ": 1, "PASS": 0}


def rank(kind: Column) -> Column:
    """How bad a verdict on a read is, from 7 for the wrong vector to 0 for a pass."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), kind)


def worst(verdicts: DataFrame) -> DataFrame:
    """Rows (ab_id, kind, rank): each antibody's worst verdict."""
    r = verdicts.withColumn("rank", rank(F.col("kind")))
    return r.groupBy("ab_id").agg(F.max(F.struct("rank", "kind")).alias("w")).select("ab_id", "w.kind", "w.rank")


MUTATIONS = "array<struct<position_aa:int,wt:string,mut_aa:string>>"


def mode_of(name: str) -> str:
    """``full`` for whole plasmids (also for mixed input), ``flanks_only`` for partial reads."""
    return "flanks_only" if name.lower() in ("partial_sanger", "flanks_only") else "full"


def mutations(observed: Column, expected: Column, leader: Column) -> Column:
    """Substitutions of an alignment as (position after the leader, wt, mut_aa), positions from 1."""
    pairs = F.zip_with(F.split(observed, ""), F.split(expected, ""), lambda o, e: F.struct(o.alias("o"), e.alias("e")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast(MUTATIONS).alias("m"))

    def step(s: Column, p: Column) -> Column:
        n = s["n"] + ((p["e"] != "-") & (p["e"] != "")).cast("int")
        hit = (p["o"] != "-") & (p["e"] != "-") & (p["o"] != p["e"]) & (n - leader >= 1)
        new = F.array(F.struct((n - leader).alias("position_aa"), p["e"].alias("wt"), p["o"].alias("mut_aa")))
        return F.struct(n.alias("n"), F.when(hit, F.concat(s["m"], new)).otherwise(s["m"]).alias("m"))

    # most reads have none: their letters are not gone through
    return F.when(observed == expected, F.array().cast(MUTATIONS)).otherwise(F.aggregate(pairs, start, step, lambda s: s["m"]))


#: Identity, gaps counted, above which a read is the vector without an insert.
EMPTY_IDENTITY = 0.97
#: Residues whose alignment with themselves is the diagonal by most scores.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def run(reads: DataFrame, library: Library, project: Project, cores: DataFrame | None = None, truth: DataFrame | None = None, mode: str = "full", overrides: DataFrame | None = None) -> DataFrame:
    """Verdicts of reads (record_id, sequence, ...).

    Columns: record_id, ab_id, chain_class, kind, reason, backbone_vector, backbone_identity,
    backbone_observed, mutations, premature_stop_aa, reads_through, suspected_identity,
    aligned_observed, aligned_expected, leader_aa_len, n_gap_columns; record_idx where there is one.
    """
    spark, settings = reads.sparkSession, library.alignment
    protein = kernels.protein_scoring(settings.protein_gap_open, settings.protein_gap_extend)
    nucleotide = kernels.nucleotide_scoring(settings.nt_match, settings.nt_mismatch, settings.nt_gap_open, settings.nt_gap_extend)
    vectors = project.candidates(library)
    df = with_names(reads, library.profiles.get(project.profile, DEFAULT), overrides)
    chain = F.col("chain_class")
    locus = F.when(chain == "light", seq.locus_from_protein(seq.best_frame_protein(F.when(chain == "light", F.col("sequence"))))).otherwise(_case(chain, seq.LOCUS_OF, "string"))
    df = df.withColumn("locus", locus).withColumn("clean", seq.clean(F.col("sequence")))
    enough = F.length("clean") >= 60
    df = df.withColumn("enough", F.coalesce(enough, F.lit(False)))
    full = mode_of(mode) == "full"
    if full:
        df = df.withColumn("fit", kernels.orient(F.when(F.col("enough"), F.col("clean")), [(v.id, v.landmark(), v.leader()) for v in vectors]))
        df = df.withColumn("backbone_vector", F.col("fit.vector_id")).withColumn("backbone_identity", F.col("fit.identity")).withColumn("working", F.col("fit.sequence"))
    else:
        df = df.withColumn("backbone_vector", F.lit(None).cast("string")).withColumn("backbone_identity", F.lit(None).cast("double")).withColumn("working", F.when(F.col("enough"), F.col("clean")))
    assigned = {x: project.assignments[c] for x, c in seq.CLASS_OF.items() if library.vector(project.assignments.get(c)) is not None}
    df = df.withColumn("use", F.coalesce(_case(F.col("locus"), assigned, "string"), F.col("backbone_vector")))
    # a few rows of project settings
    ends = F.col("vector_seq"), F.col("oh5_end"), F.col("oh3_start")
    dim = vectors_frame(spark, vectors).drop("ord").withColumn("leader_aa", seq.translate(F.left(ends[0], ends[1])))
    dim = F.broadcast(dim.withColumn("vector_aa", seq.translate_to_stop(seq.assemble(ends[0], F.lit(""), *ends[1:]))))
    df = df.join(dim, df["use"] == dim["vector_id"], "left")
    backs = F.broadcast(vectors_frame(spark, vectors).select(F.col("vector_id").alias("back_id"), F.col("display_name").alias("back_name"), F.col("vector_class").alias("back_class")))
    df = df.join(backs, df["backbone_vector"] == backs["back_id"], "left")
    back = F.col("back_class")
    class_ok = (chain == "unknown") | F.when(chain == "light", back.isin("kappa", "lambda")).otherwise(back == chain)
    df = df.withColumn("wrong", F.coalesce((F.col("backbone_identity") >= settings.backbone_identity_min) & ~class_ok, F.lit(False)))
    # a read in the wrong vector isn't looked at any more
    df = df.withColumn("working", F.when(~F.col("wrong"), F.col("working")))

    key = upper_col(F.col("ab_id"))
    effective = F.when((chain == "light") & F.col("locus").isin("IGK", "IGL"), _case(F.col("locus"), seq.CLASS_OF, "string")).otherwise(chain)
    if cores is not None:
        own = cores.select(F.col("ab_key").alias("core_key"), F.col("core_class"), F.col("core").alias("expected_core"))
        df = df.join(own, (key == F.col("core_key")) & (effective == F.col("core_class")), "left")
    else:
        df = df.withColumn("expected_core", F.lit(None).cast("string"))
    if truth is not None:
        own = panel(truth).select(F.col("ab_key").alias("truth_key"), "heavy", "light")
        df = df.join(own, key == F.col("truth_key"), "left").withColumn("truth", F.when(chain == "heavy", F.col("heavy")).otherwise(F.col("light")))
    else:
        df = df.withColumn("truth", F.lit(None).cast("string"))
    v, oh5, oh3 = ends
    has_core = F.col("expected_core").isNotNull()
    df = df.withColumn("expected", v.isNotNull() & (has_core | F.col("truth").isNotNull()))
    df = df.withColumn("go", F.col("enough") & ~F.col("wrong") & F.col("use").isNotNull() & F.col("expected"))
    by_core = seq.protein_to_stop(F.when(F.col("go") & has_core, seq.assemble(v, F.col("expected_core"), oh5, oh3)))
    by_truth = F.concat(F.col("leader_aa"), truth_protein(F.col("truth")), seq.translate_to_stop(F.substring(v, oh3 + 1, F.length(v))))
    df = df.withColumn("core_aa", by_core).withColumn("orf", seq.locate_orf_in(F.when(F.col("go"), F.col("working")), F.col("leader_aa")))
    df = df.withColumn("expected_aa", F.when(has_core, F.col("core_aa")).when(F.col("go"), by_truth))
    df = df.withColumn("observed_aa", seq.to_stop(F.col("orf"))).withColumn("through", F.col("observed_aa").contains(F.col("anchor")))
    df = df.withColumn("empty_aa", F.when(F.col("through"), F.col("vector_aa")))
    checks_empty = F.col("through") & (F.greatest(F.length("expected_aa") - F.length("empty_aa"), F.lit(0)) > 10)
    # matches are at most the shorter one's residues, columns at least the longer one's
    sizes = F.length("observed_aa"), F.length("empty_aa")
    checks_empty = checks_empty & (F.least(*sizes) / F.greatest(*sizes, F.lit(1)) > EMPTY_IDENTITY)
    df = df.withColumn("empty_al", kernels.align(F.when(checks_empty, F.col("observed_aa")), F.when(checks_empty, F.col("empty_aa")), protein))
    few = F.col("empty_al.gaps") < F.floor(F.length("observed_aa") / 10) + 2
    df = df.withColumn("empty", F.coalesce((kernels.identity(F.col("empty_al"), True) > EMPTY_IDENTITY) & few, F.lit(False)))
    clean_read = F.col("through") & ~F.col("empty")
    same = F.col("observed_aa") == F.col("expected_aa")
    if kernels.self_aligned(np.frombuffer(RESIDUES.encode(), np.uint8), protein) is None:
        same = F.lit(False)
    df = df.withColumn("same", F.col("go") & same & ~F.col("observed_aa").rlike(f"[^{RESIDUES}]"))
    of = lambda asked: kernels.align(F.when(asked, F.col("observed_aa")), F.when(asked, F.col("expected_aa")), protein)
    df = df.withColumn("al", of(clean_read & ~F.col("same")))
    # for the columns that show it alone
    df = df.withColumn("other_al", of(F.col("go") & ~F.col("same") & ~clean_read))
    shown = lambda of_same, name: F.when(F.col("go"), F.when(F.col("same"), of_same).otherwise(F.coalesce(F.col(f"al.{name}"), F.col(f"other_al.{name}"))))
    found = F.when(F.col("same"), F.array().cast(MUTATIONS)).otherwise(mutations(F.col("al.aligned_a"), F.col("al.aligned_b"), F.length("leader_aa")))
    df = df.withColumn("muts", F.when(clean_read, found))
    df = df.withColumn("mutated", F.coalesce(F.size("muts") > 0, F.lit(False)))
    df = df.withColumn("silent_core", F.when(clean_read & ~F.col("mutated") & has_core, seq.extract_insert_from(F.col("working"), v, oh5, F.length("expected_core"))))
    # equal ones have no change, where the diagonal is best
    asked = F.col("silent_core") != F.col("expected_core") if kernels.self_aligned(np.zeros(1, np.uint8), nucleotide) is not None else F.col("silent_core").isNotNull()
    df = df.withColumn("nt", kernels.align(F.when(asked, F.col("silent_core")), F.when(asked, F.col("expected_core")), nucleotide))
    if truth is not None:
        df = df.withColumn("obs_v", F.when(F.col("mutated"), F.substring(F.col("observed_aa"), F.length("leader_aa") + 1, F.length("observed_aa"))))
        # what the verdict doesn't look at any more is not kept
        df = df.drop("sequence", "clean", "fit", "working", "vector_seq", "core_key", "expected_core", "truth_key", "heavy", "light", "truth", "core_aa", "empty_aa", "vector_aa", "empty_al", "silent_core")
        df = _swaps(df, truth, protein)
    else:
        df = df.withColumn("swap", F.lit(None).cast("string"))

    changes = F.col("nt.mismatches") + F.col("nt.gaps")
    stop = seq.first_stop(F.col("orf"))
    first = F.get("muts", F.lit(0))
    rules = [
        (~F.col("enough"), "INSUFFICIENT_READ", F.lit("read too short to cover the insert/junction")),
        (F.col("wrong"), "WRONG_VECTOR", F.concat(F.lit("backbone matches "), F.col("back_name"), F.lit(" ("), F.format_string("%.1f", F.col("backbone_identity") * 100), F.lit("% id) but the name says "), chain)),
        (F.col("use").isNull(), "INSUFFICIENT_READ", F.lit("no reference vector available to verify against")),
        (~F.col("expected"), "INSUFFICIENT_READ", F.lit("no expected sequence (order or ground truth) for this antibody")),
        (~F.col("through"), "JUNCTION_FRAMESHIFT", F.concat(F.lit("ORF diverges and hits a premature stop (aa "), F.coalesce(stop.cast("string"), F.lit("?")), F.lit("); no read-through into the constant region ("), F.col("anchor"), F.lit(" absent)"))),
        (F.col("empty"), "EMPTY_VECTOR", F.lit("leader reads straight into the constant region with no variable domain (empty/religated vector)")),
        (F.col("swap").isNotNull(), "WRONG_INSERT_SWAP", F.concat(F.lit("observed insert does not match "), F.col("ab_id"), F.lit(" but matches another panel member ("), F.col("swap"), F.lit(")"))),
        (F.col("mutated"), "POINT_MUTATION", F.concat(F.size("muts").cast("string"), F.lit(" point mutation(s) in the variable region; first at aa "), first["position_aa"].cast("string"), F.lit(" ("), first["wt"], F.lit("→"), first["mut_aa"], F.lit(")"))),
        (F.coalesce(changes > 0, F.lit(False)), "SILENT_VARIANT", F.concat(F.lit("protein identical to expected; "), changes.cast("string"), F.lit(" synonymous nt change(s) in the insert (silent)"))),
        (F.lit(True), "PASS", F.lit("insert matches the expected antibody and reads in-frame through the constant region")),
    ]
    kind = reason = None
    for condition, name, text in rules:
        kind = F.when(condition, name) if kind is None else kind.when(condition, name)
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    keep = [c for c in ("record_idx",) if c in reads.columns]
    df = df.withColumn("kind", kind).withColumn("reason", reason)
    return df.select(
        *keep,
        "record_id",
        "ab_id",
        "chain_class",
        "kind",
        "reason",
        "backbone_vector",
        "backbone_identity",
        F.lit(mode_of(mode)).alias("backbone_observed"),
        F.when(F.col("kind") == "POINT_MUTATION", F.col("muts")).otherwise(F.array().cast(MUTATIONS)).alias("mutations"),
        F.when(F.col("kind") == "JUNCTION_FRAMESHIFT", stop).alias("premature_stop_aa"),
        F.when(F.col("go"), F.col("through")).alias("reads_through"),
        F.when(F.col("kind") == "WRONG_INSERT_SWAP", F.col("swap")).alias("suspected_identity"),
        shown(F.col("observed_aa"), "aligned_a").alias("aligned_observed"),
        shown(F.col("expected_aa"), "aligned_b").alias("aligned_expected"),
        F.when(F.col("go"), F.length("leader_aa")).alias("leader_aa_len"),
        shown(F.lit(0), "gaps").alias("n_gap_columns"),
    )


#: Panel proteins that stand in one row of the search for swapped samples, about.
SHARD = 64


def _swaps(df: DataFrame, truth: DataFrame, protein: kernels.Scoring) -> DataFrame:
    """Adds ``swap``: the panel member, other than the named one, that a mutated read fits best
    with at least 95 % identity; ties go to the first by id.

    Distinct mutated proteins are a stated query set against all distinct panel proteins of their chain: the
    identity leaves gaps out, so no bound on shared residues rules a pair out. The panel lies in shards,
    whose proteins are aligned with a query at once. A protein that stands in the panel as it is
    has the highest identity there is: only members before that one by id are aligned with it.
    """
    heavy = F.col("chain_class") == "heavy"
    # the reads are needed twice, for their proteins and for the answers: they are computed once
    df = staged(df)
    wanted = df.filter(F.col("obs_v").isNotNull()).select("obs_v", heavy.alias("is_heavy")).distinct()
    p = panel(truth)
    sides = p.select("ab_key", F.lit(True).alias("is_heavy"), F.col("heavy").alias("t")).union(p.select("ab_key", F.lit(False).alias("is_heavy"), F.col("light").alias("t"))).filter("t is not null")
    proteins = sides.select("ab_key", "is_heavy", truth_protein(F.col("t")).alias("panel_aa"))
    firsts = staged(proteins.groupBy("is_heavy", "panel_aa").agg(F.min("ab_key").alias("ab_key")))
    exact = firsts.filter(F.col("panel_aa").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")).select("is_heavy", F.col("panel_aa").alias("obs_v"), F.col("ab_key").alias("exact"))
    wanted = wanted.join(exact, ["is_heavy", "obs_v"], "left")
    n_shards = -(-firsts.count() // SHARD) or 1
    # a shard's queries are dealt to many tasks, each with a copy of the shard
    n_parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    shards = firsts.groupBy("is_heavy", F.pmod(F.xxhash64("panel_aa"), F.lit(n_shards)).alias("shard")).agg(F.collect_list("panel_aa").alias("aa"), F.collect_list("ab_key").alias("keys"))
    shards = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    queries = wanted.withColumn("part", F.pmod(F.xxhash64("obs_v"), F.lit(n_parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    pairs = queries.repartition(n_parts, "is_heavy", "shard", "part").join(shards.repartition(n_parts, "is_heavy", "shard", "part"), ["is_heavy", "shard", "part"])
    fits = pairs.select("obs_v", "is_heavy", kernels.closest(F.col("obs_v"), F.col("aa"), F.col("keys"), F.col("exact"), protein).alias("fit"))
    known = wanted.filter("exact is not null").select("obs_v", "is_heavy", F.struct(F.lit(-1.0).alias("loss"), F.col("exact").alias("key")).alias("fit"))
    # not a filter, which would be pushed down and align once more
    best = fits.union(known).groupBy("obs_v", "is_heavy").agg(F.min(F.when(F.col("fit.key").isNotNull(), F.col("fit"))).alias("b"))
    best = best.select(F.col("obs_v").alias("s_v"), F.col("is_heavy").alias("s_heavy"), F.col("b.key").alias("s_key"), (-F.col("b.loss")).alias("s_id"))
    out = df.join(best, (F.col("obs_v") == F.col("s_v")) & (heavy == F.col("s_heavy")), "left")
    return out.withColumn("swap", F.when((F.col("s_id") >= 0.95) & (F.col("s_key") != upper_col(F.col("ab_id"))), F.col("s_key")))
