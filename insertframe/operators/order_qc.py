"""Order QC: does each ordered fragment encode its protein and assemble in frame?

A DataFrame of records becomes a DataFrame of verdicts. Every signal is a column; the verdict is
one ordered CASE over them. Alignment runs only for records that drift from their panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insertframe.functions import kernels, seq
from insertframe.operators.library import Library, Project, last_wins
from insertframe.operators.naming import DEFAULT, parse_name, upper_col, with_names

PASSING = ("PASS", "NO_GROUND_TRUTH")


def panel(truth: DataFrame) -> DataFrame:
    """Rows (ab_key, heavy, light), the last of each antibody by ``idx``; ids ignore case."""
    rows = truth.withColumn("ab_key", upper_col(F.col("ab_id")))
    return last_wins(rows, ["ab_key"], "idx", ["heavy", "light"])


def truth_protein(t: Column) -> Column:
    return F.when(seq.detect_type(t) == "nt", seq.translate_to_stop(t)).otherwise(seq.clean(t))


def _protein_or_self(cleaned: Column) -> Column:
    """``truth_protein`` of cleaned columns."""
    bases = seq.mostly_bases(cleaned)
    return F.when(bases, seq.to_stop(seq.protein_of(F.when(bases, cleaned)))).otherwise(cleaned)


def _case(locus: Column, by_locus: dict[str, object], kind: str) -> Column:
    out = None
    for x, v in by_locus.items():
        out = F.when(locus == x, F.lit(v).cast(kind)) if out is None else out.when(locus == x, F.lit(v).cast(kind))
    return F.lit(None).cast(kind) if out is None else out


def first_difference(a: Column, b: Column) -> Column:
    """The 1-based residue of ``a`` at the first column that differs; gaps of ``a`` don't count."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        n = s["n"] + ((p["x"] != "-") & (p["x"] != "")).cast("int")
        return F.when(s["done"], s).otherwise(F.struct(n.alias("n"), (p["x"] != p["y"]).alias("done")))

    return F.aggregate(pairs, start, step, lambda s: F.when(s["done"], F.greatest(s["n"], F.lit(1))))


def _yn(found: Column) -> Column:
    return F.when(found, "found").otherwise("absent")


def run(records: DataFrame, library: Library, project: Project, truth: DataFrame | None = None, overrides: DataFrame | None = None, has_overhangs: bool = True) -> DataFrame:
    """Verdicts of records (record_id, sequence, ...): their columns and the verdict's.

    Columns: record_id, ab_id, chain_class, kind, advisories, reason, core_len,
    premature_stop_aa, reads_through; record_idx is kept where there is one.
    """
    settings, checks = library.alignment, library.checks
    overhangs = library.overhang_sets.get(project.overhang_set, {})
    most = settings.overhang_max_mismatch
    named = with_names(records, library.profiles.get(project.profile, DEFAULT), overrides)
    light = F.coalesce(seq.locus_from_overhangs(F.col("sequence"), overhangs, most), seq.locus_from_protein(seq.translate(F.col("sequence"))))
    chain = F.col("chain_class")
    locus = F.when(chain == "light", light).otherwise(_case(chain, seq.LOCUS_OF, "string"))
    vectors = {x: library.vector(project.assignments.get(c)) for x, c in seq.CLASS_OF.items()}
    vectors = {x: v for x, v in vectors.items() if v is not None}
    df = named.withColumn("locus", locus)
    L = F.col("locus")
    if has_overhangs:
        oh5, oh3 = (_case(L, {x: (overhangs.get(x, (None, None))[i] or "") for x in seq.LOCI}, "string") for i in (0, 1))
        df = df.withColumn("st", F.when(L.isNotNull(), seq.strip_overhangs(F.col("sequence"), oh5, oh3, most)))
        whole = F.col("oh5_present") & F.col("oh3_present")
        df = df.withColumns({f: F.col(f"st.{f}") for f in ("core", "oh5_mismatches", "oh3_mismatches", "oh5_present", "oh3_present")})
        df = df.withColumn("other", F.when(~whole, seq.locus_from_overhangs(F.col("sequence"), overhangs, most)))
    else:
        whole = F.lit(True)
        df = df.withColumn("core", seq.clean(F.col("sequence")))
    # all that is asked of the sequence is told before the panel is met, so that no sequence travels
    core, wanted = F.col("core"), F.when(whole, F.col("core"))
    built, anchor = None, _case(L, {x: v.constant_anchor_aa for x, v in vectors.items()}, "string")
    for x, v in vectors.items():
        assembled = seq.assemble(F.lit(v.clean), wanted, F.lit(v.oh5_end), F.lit(v.oh3_start))
        built = F.when(L == x, assembled) if built is None else built.when(L == x, assembled)
    has_vector = L.isin(list(vectors)) if vectors else F.lit(False)
    has_vector = F.coalesce(has_vector, F.lit(False))
    df = df.withColumns({"core_aa": seq.protein_of(wanted), "orf": F.lit(None).cast("string") if built is None else seq.protein_of(built)})
    told = {
        "core_length": F.length(core),
        "mine": seq.to_stop(F.col("core_aa")),
        "stop": F.when(has_vector, seq.first_stop(F.col("orf"))).otherwise(seq.first_stop(F.col("core_aa"))),
        "through": F.when(has_vector, seq.to_stop(F.col("orf")).contains(anchor)),
        "high_gc": kernels.gc_over(wanted, checks.gc_max_global, checks.gc_window, checks.gc_max_window) if checks.enabled else F.lit(False),
    }
    small = [c for c in ("record_idx", "record_id", "ab_id", "chain_class", "locus", "oh5_present", "oh3_present", "oh5_mismatches", "oh3_mismatches", "other") if c in df.columns]
    df = df.select(*small, *[c.alias(name) for name, c in told.items()])
    if truth is not None:
        p = panel(truth).select(F.col("ab_key").alias("__key"), seq.clean(F.col("heavy")).alias("heavy"), seq.clean(F.col("light")).alias("light"))
        p = p.select("__key", *[_protein_or_self(F.col(c)).alias(c) for c in ("heavy", "light")])
        df = df.join(p, upper_col(F.col("ab_id")) == F.col("__key"), "left")
        df = df.withColumn("truth_aa", F.when(chain == "heavy", F.col("heavy")).otherwise(F.col("light")))
    else:
        df = df.withColumn("truth_aa", F.lit(None).cast("string"))
    df = df.withColumn("drift", F.coalesce((F.col("mine") != F.col("truth_aa")) & whole, F.lit(False)))
    df = df.withColumn("al", kernels.align(F.when(F.col("drift"), F.col("mine")), F.when(F.col("drift"), F.col("truth_aa")), kernels.protein_scoring(settings.protein_gap_open, settings.protein_gap_extend)))
    n, high_gc = F.col("core_length"), F.col("high_gc")

    typo = F.lit("")
    if has_overhangs:
        m5, m3 = F.col("oh5_mismatches"), F.col("oh3_mismatches")
        typo = F.when((m5 > 0) | (m3 > 0), F.concat(F.lit("overhang typo tolerated (5′ "), m5.cast("string"), F.lit(" mm, 3′ "), m3.cast("string"), F.lit(" mm); "))).otherwise("")
    prefix = F.coalesce(typo, F.lit(""))
    shown = F.coalesce(F.col("stop").cast("string"), F.lit("?"))
    known = F.col("truth_aa").isNotNull()
    noted = F.concat(prefix, F.when(has_vector, "").otherwise("no vector assigned for this locus; productivity checked structurally only"))

    # (condition, kind, reason, columns that are set)
    rules: list[tuple[Column, str | Column, Column, set[str]]] = []
    if has_overhangs:
        wrong = F.coalesce(~whole & F.col("other").isNotNull() & (_case(F.col("other"), seq.CLASS_OF, "string") != chain) & (chain != "light"), F.lit(False))
        rules += [
            (L.isNull(), "OVERHANG_MISSING", F.lit("could not determine locus, so overhangs could not be located"), set()),
            (wrong, "OVERHANG_WRONG_LOCUS", F.concat(F.lit("name says "), chain, F.lit(" but the fragment carries "), F.col("other"), F.lit(" overhangs")), set()),
            (~whole, "OVERHANG_MISSING", F.concat(F.lit("expected "), L, F.lit(" overhangs not found at both ends (5′ "), _yn(F.col("oh5_present")), F.lit(", 3′ "), _yn(F.col("oh3_present")), F.lit(")")), set()),
        ]
    at = F.coalesce(first_difference(F.col("al.aligned_a"), F.col("al.aligned_b")).cast("string"), F.lit("?"))
    rules += [
        (F.col("drift"), "TRANSLATION_DRIFT", F.concat(prefix, F.lit("translated core differs from ground truth ("), F.col("al.mismatches").cast("string"), F.lit(" mismatch(es), "), F.col("al.gaps").cast("string"), F.lit(" gap(s); first at aa "), at, F.lit(")")), {"core_len"}),
        (has_vector & ~F.col("through"), "FRAMESHIFT_AT_JUNCTION", F.concat(prefix, F.lit("V-domain translates but the assembled ORF hits a premature stop at aa "), shown, F.lit(" and does not read through into the constant region ("), anchor, F.lit(" absent)")), {"core_len", "stop", "through"}),
        (~has_vector & (n % 3 != 0), "FRAMESHIFT_AT_JUNCTION", F.concat(prefix, F.lit("core length "), n.cast("string"), F.lit(" is not a multiple of 3 (frameshift at junction)")), {"core_len"}),
        (~has_vector & F.col("stop").isNotNull(), "FRAMESHIFT_AT_JUNCTION", F.concat(prefix, F.lit("premature stop at aa "), shown, F.lit(" within the translated core")), {"core_len", "stop"}),
        (known, "PASS", F.when(noted == "", "core translates identically to ground truth; assembled construct is productive (reads through into the constant region)").otherwise(F.concat(noted, F.lit("core matches ground truth; construct productive"))), {"core_len", "stop", "through"}),
        (F.lit(True), "NO_GROUND_TRUTH", F.when(noted == "", "no ground-truth panel entry for this antibody; assembled construct is productive (advisory pass)").otherwise(F.concat(noted, F.lit("construct productive; no ground-truth entry (advisory)"))), {"core_len", "stop", "through"}),
    ]
    exit_no = None
    for i, (condition, *_rest) in enumerate(rules):
        exit_no = F.when(condition, i) if exit_no is None else exit_no.when(condition, i)
    df = df.withColumn("exit_no", exit_no)
    e = F.col("exit_no")

    def pick(values: list[Column]) -> Column:
        out = None
        for i, v in enumerate(values):
            out = F.when(e == i, v) if out is None else out.when(e == i, v)
        return out

    def where_set(name: str, value: Column) -> Column:
        return F.when(e.isin([i for i, r in enumerate(rules) if name in r[3]]), value)

    none = F.array().cast("array<string>")
    advisories = F.when((e >= len(rules) - 2) & high_gc, F.array(F.lit("GC_WARNING"))).otherwise(none) if checks.enabled else none
    keep = [c for c in ("record_idx",) if c in records.columns]
    return df.select(
        *keep,
        "record_id",
        "ab_id",
        "chain_class",
        pick([F.lit(r[1]) for r in rules]).alias("kind"),
        advisories.alias("advisories"),
        pick([r[2] for r in rules]).alias("reason"),
        where_set("core_len", n).alias("core_len"),
        where_set("stop", F.col("stop")).alias("premature_stop_aa"),
        where_set("through", F.col("through")).alias("reads_through"),
    )


def order_cores(records: DataFrame, library: Library, project: Project, has_overhangs: bool = True) -> DataFrame:
    """Rows (ab_key, core_class, core): the insert of each ordered chain, the last record winning."""
    own, most = library.overhang_sets.get(project.overhang_set), library.alignment.overhang_max_mismatch
    if own is None:
        records, own = records.filter(F.lit(False)), {}
    sequence = F.col("sequence")

    # lambda variables and not columns: a filter on the outcome would copy columns into itself
    def of_name(p: Column) -> Column:
        chain = p["chain_class"]
        locus = F.when(chain == "light", seq.locus_from_overhangs(sequence, own, most)).otherwise(_case(chain, seq.LOCUS_OF, "string"))
        return seq.let(locus, lambda x: of_locus(p, x))

    def of_locus(p: Column, x: Column) -> Column:
        def found(core: Column) -> Column:
            return F.struct(upper_col(p["ab_id"]).alias("ab_key"), _case(x, seq.CLASS_OF, "string").alias("core_class"), core.alias("core"))

        if not has_overhangs:
            return F.when(x.isNotNull(), found(seq.clean(sequence)))
        ends = F.array(*[_case(x, {k: (own.get(k, (None, None))[i] or "") for k in seq.LOCI}, "string") for i in (0, 1)])
        strip = lambda e: seq.let(seq.strip_overhangs(sequence, e[0], e[1], most), lambda st: F.when(st["oh5_present"] & st["oh3_present"], found(st["core"])))
        return F.when(x.isNotNull(), seq.let(ends, strip))

    name = parse_name(F.col("record_id"), library.profiles.get(project.profile, DEFAULT))
    rows = records.select("record_idx", seq.let(name, of_name).alias("c")).filter("c is not null").select("record_idx", "c.*")
    return last_wins(rows, ["ab_key", "core_class"], "record_idx", ["core"])
