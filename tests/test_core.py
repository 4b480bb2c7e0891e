"""Operators of the construct-verification engine against plain models and planted constructs."""

import random
import struct
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from insertframe.functions import kernels, seq
from insertframe.operators import constructs, coverage, library, naming, order_qc, rollup, sequencing_qc
from insertframe.plans.queries import ANCHOR, CONSTANT, LANDMARKS, LEADER, OH, _planted
from insertframe.sources import abif, genbank, json5, plain, tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,protein",
    [("ATGGCC", "MA"), ("CTN", "L"), ("TAR", "X"), ("atg-gcc t", "MA"), ("AUG", "M"), ("TAATAGTGA", "***"), ("", ""), ("AC", "")],
)
def test_translate(spark, given, protein):
    assert value(spark, seq.translate(F.lit(given))) == protein == plain.translate(given)


def test_scalars(spark):
    assert value(spark, seq.clean(F.lit("aıß-C1g"))) == "ACG"
    assert value(spark, seq.revcomp(F.lit("AUGCN"))) == "NGCAT"
    assert value(spark, seq.detect_type(F.lit("ACGTACGTAW"))) == "nt"
    assert value(spark, seq.detect_type(F.lit(""))) == "aa"
    assert value(spark, seq.gc_fraction(F.lit(""))) == 0.0
    assert value(spark, seq.mismatches(F.lit("ACGT"), F.lit("AGG"))) == 1
    assert value(spark, seq.rotate(F.lit("ABCDE"), F.lit(7))) == "CDEAB"
    assert value(spark, seq.strip_overhangs(F.lit("AAAGGG"), F.lit("AAAG"), F.lit("GGGG"), 1))["core"] == ""


def test_revcomp_twice_and_windows(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 200))),) for _ in range(60)]
    got = spark.createDataFrame(rows, "s string").select("s", seq.revcomp(seq.revcomp(F.col("s"))).alias("r"), seq.max_windowed_gc(F.col("s"), 7).alias("w")).collect()
    for r in got:
        gc = [c in "GC" for c in r["s"]]
        n = len(gc)
        want = (sum(gc) / n if n else 0.0) if n <= 7 else max(sum(gc[i : i + 7]) for i in range(n - 6)) / 7
        assert r["r"] == r["s"] and abs(r["w"] - want) < 1e-12


NAMES = {
    "HVA-0195-r3-d02_heavy": ("HVA-0195-r3-d02", "heavy", "High"),
    "heavy": ("", "heavy", "High"),
    "mab1_heavy_": ("mab1", "heavy", "High"),
    "a-heavy-2": ("a_2", "heavy", "High"),
    "abcheavy": ("abc", "heavy", "High"),
    "": ("", "unknown", "None"),
    "mAb 7 H": ("mAb 7", "heavy", "Low"),
    "x:HC": ("x", "heavy", "High"),
    "foovk": ("foo", "kappa", "High"),
    "nothing": ("nothing", "unknown", "None"),
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "record_id string")
    for r in naming.with_names(df).collect():
        assert (r["ab_id"], r["chain_class"], r["confidence"]) == NAMES[r["record_id"]]
        assert r["needs_confirmation"] == (r["confidence"] != "High")


def plain_align(a, b, sub, o, e):
    """A cell-by-cell model of the alignment and of its path."""
    neg = -(10**9)
    n, m = len(a), len(b)
    M, X, Y, way = ({} for _ in range(4))
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                M[i, j], X[i, j], Y[i, j] = 0, neg, neg
            elif j == 0:
                X[i, j] = M[i, j] = o + (i - 1) * e
                Y[i, j], way[i, j] = neg, 1
            elif i == 0:
                Y[i, j] = M[i, j] = o + (j - 1) * e
                X[i, j], way[i, j] = neg, 2
            else:
                M[i, j] = max(M[i - 1, j - 1], X[i - 1, j - 1], Y[i - 1, j - 1]) + sub(a[i - 1], b[j - 1])
                X[i, j] = max(max(M[i - 1, j], Y[i - 1, j]) + o, X[i - 1, j] + e)
                Y[i, j] = max(max(M[i, j - 1], X[i, j - 1]) + o, Y[i, j - 1] + e)
                top = max(M[i, j], X[i, j], Y[i, j])
                way[i, j] = 0 if top == M[i, j] else 1 if top == X[i, j] else 2
    ra, rb, i, j = "", "", n, m
    while i or j:
        w = way[i, j]
        ra = (a[i - 1] if w != 2 else "-") + ra
        rb = (b[j - 1] if w != 1 else "-") + rb
        i, j = i - (w != 2), j - (w != 1)
    return max(M[n, m], X[n, m], Y[n, m]), ra, rb


def test_alignment_matches_the_plain_model():
    rng = random.Random(5)
    nt, aa = kernels.nucleotide_scoring(), kernels.protein_scoring()
    table = kernels.blosum62()
    for _ in range(300):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert kernels.global_affine(a, b, nt)[:3] == plain_align(a, b, lambda x, y: 2 if x == y else -3, -5, -1)
        a, b = ("".join(rng.choice("ARNDXFW*BJ") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert kernels.global_affine(a, b, aa)[:3] == plain_align(a, b, lambda x, y: int(table[ord(x), ord(y)]), -11, -1)
    assert kernels.global_affine("AGAT", "TTTCATATTATGCA", nt)[0] == -15
    assert (table[ord("X"), ord("F")], table[ord("F"), ord("X")], table[ord("J"), ord("A")], table[ord("w"), ord("W")]) == (-2, -1, 0, 11)


def test_circular_kernels():
    rng = random.Random(6)
    for _ in range(50):
        t = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
        m = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 20)))
        if len(m) <= len(t):
            hits = [sum((t + t)[i + k] == m[k] for k in range(len(m))) for i in range(len(t))]
            assert kernels.circular_search(t, m) == (max(hits) / len(m), hits.index(max(hits)))
    assert kernels.circular_search("", "A") == (0.0, None) and kernels.circular_search("AC", "GACG") == (1.0, None)
    own = LANDMARKS["v0"] + "ACGTTGCA" * 5
    turned = kernels.reverse_complement(own[13:] + own[:13])
    assert kernels.normalize(turned, LANDMARKS["v0"])[:2] == (own, True)


CORE = "CAG" * 100


def records(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "record_idx long, record_id string, sequence string")


def test_order_qc(spark):
    lib, project = _planted()
    h, k = OH["IGH"], OH["IGK"]
    rows = records(
        spark,
        ("a_heavy", h[0] + CORE + h[1]),
        ("b_heavy", h[0] + CORE[:-1] + h[1]),
        ("c_heavy", k[0] + CORE + k[1]),
        ("d_heavy", CORE),
        ("e_kappa", k[0] + CORE + k[1]),
        ("f_heavy", h[0] + CORE + h[1]),
        ("g", "ACGT"),
        ("h_heavy", "A" + h[0][1:] + CORE + h[1]),
        ("i_heavy", ""),
    )
    truth = spark.createDataFrame([("A", "Q" * 99, None, 0), ("a", "Q" * 100, None, 1), ("F", "Q" * 99 + "W", None, 0)], "ab_id string, heavy string, light string, idx int")
    got = {r["record_id"]: r for r in order_qc.run(rows, lib, project, truth).collect()}
    kinds = {k: v["kind"] for k, v in got.items()}
    assert kinds == {"a_heavy": "PASS", "b_heavy": "FRAMESHIFT_AT_JUNCTION", "c_heavy": "OVERHANG_WRONG_LOCUS", "d_heavy": "OVERHANG_MISSING", "e_kappa": "NO_GROUND_TRUTH", "f_heavy": "TRANSLATION_DRIFT", "g": "OVERHANG_MISSING", "h_heavy": "NO_GROUND_TRUTH", "i_heavy": "OVERHANG_MISSING"}
    assert got["f_heavy"]["reason"] == "translated core differs from ground truth (1 mismatch(es), 0 gap(s); first at aa 100)"
    assert got["c_heavy"]["reason"] == "name says heavy but the fragment carries IGK overhangs"
    assert got["e_kappa"]["reason"] == "no vector assigned for this locus; productivity checked structurally onlyconstruct productive; no ground-truth entry (advisory)"
    assert got["h_heavy"]["reason"].startswith("overhang typo tolerated (5′ 1 mm, 3′ 0 mm); ")
    assert got["a_heavy"]["reads_through"] is True and got["a_heavy"]["core_len"] == 300 and got["a_heavy"]["advisories"] == ["GC_WARNING"]
    assert got["e_kappa"]["reads_through"] is None
    rolled = {r["ab_id"]: r for r in rollup.rollup_order(order_qc.run(rows, lib, project, truth)).collect()}
    assert rolled["b"]["note"] == "flagged: FRAMESHIFT_AT_JUNCTION" and rolled["a"]["note"] == "1 chain(s) pass"
    page = rollup.html_report("x <y>", order_qc.run(rows, lib, project, truth))
    assert "x &lt;y&gt;" in page and "OVERHANG_WRONG_LOCUS" in page


def test_sequencing_qc(spark):
    lib, project = _planted()
    v = lib.vectors[0]
    rng = random.Random(9)
    inserts = ["".join("C" + rng.choice("ACGT") + "C" for _ in range(60)) for _ in range(2)]
    whole = lambda core: v.clean[: v.oh5_end] + core + v.clean[v.oh3_start :]
    one, two = inserts
    silent = one[:2] + "T" + one[3:]
    rows = records(
        spark,
        ("m1_heavy", whole(one)),
        ("M1-HC", kernels.reverse_complement(whole(one)[150:] + whole(one)[:150])),
        ("m1 heavychain", whole(one[:30] + "TGG" + one[33:])),
        ("m1_vh", whole(one[:-1])),
        ("m1_igh", whole("")),
        ("m1_hchain", whole(silent)),
        ("m1_h", "ACGT"),
        ("m2_heavy", whole(one)),
        ("m3_heavy", whole(one)),
        ("m1_lambda", whole(one)),
    )
    cores = spark.createDataFrame([("M1", "heavy", one), ("M2", "heavy", two)], "ab_key string, core_class string, core string")
    truth = spark.createDataFrame([("m1", plain.translate(one), None, 0), ("m2", plain.translate(two), None, 1)], "ab_id string, heavy string, light string, idx int")
    got = {r["record_id"]: r for r in sequencing_qc.run(rows, lib, project, cores, truth).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {
        "m1_heavy": "PASS", "M1-HC": "PASS", "m1 heavychain": "POINT_MUTATION", "m1_vh": "JUNCTION_FRAMESHIFT", "m1_igh": "EMPTY_VECTOR", "m1_hchain": "SILENT_VARIANT",
        "m1_h": "INSUFFICIENT_READ", "m2_heavy": "WRONG_INSERT_SWAP", "m3_heavy": "INSUFFICIENT_READ", "m1_lambda": "WRONG_VECTOR",
    }
    m = got["m1 heavychain"]["mutations"]
    assert [(x["position_aa"], x["mut_aa"]) for x in m] == [(11, "W")]
    assert got["m2_heavy"]["suspected_identity"] == "M1" and got["m2_heavy"]["mutations"] == []
    assert got["m1_lambda"]["reason"] == "backbone matches planted heavy (100.0% id) but the name says lambda"
    lines = [r["line"] for r in rollup.csv_rows(sequencing_qc.run(rows, lib, project, cores, truth), rollup.READ_COLUMNS).orderBy("record_idx").collect()]
    assert lines[0].startswith("m1_heavy,m1,heavy,PASS,Pass,v0,1.0000,full,true,,")


def test_results_do_not_depend_on_partitions(spark):
    lib, project = _planted()
    rows = records(spark, *[(f"a{i}_heavy", OH["IGH"][0] + CORE[: 240 + i] + OH["IGH"][1]) for i in range(40)])
    first = {r["record_id"]: tuple(r) for r in order_qc.run(rows.repartition(1), lib, project).collect()}
    assert first == {r["record_id"]: tuple(r) for r in order_qc.run(rows.repartition(7, "record_id"), lib, project).collect()}


def test_coverage(spark):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(90))
    reads = [(ref + ref)[a : a + n] for a, n in ((0, 30), (80, 40), (50, 200), (10, 17))] + [kernels.reverse_complement((ref + ref)[60:100])]
    refs = spark.createDataFrame([("r", ref), ("s", "ACGT")], "ref_id string, reference string")
    depth = {(r["ref_id"], r["pos"]): r["depth"] for r in coverage.depth(spark.createDataFrame([("r", x) for x in reads], "ref_id string, read string"), refs).collect()}
    want = [0] * 90
    for a, n in ((0, 30), (80, 40), (50, 90), (60, 40)):
        for i in range(a, a + n):
            want[i % 90] += 1
    assert [depth["r", i] for i in range(90)] == want and [depth["s", i] for i in range(4)] == [0] * 4


def test_coverage_makes_no_row_of_a_position(spark):
    """References of few and of many reads, as stretches: no more of them than steps; figures as those of positions."""
    rng = random.Random(7)
    refs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in (("few", 5_000), ("many", 3_000), ("short", 13), ("none", 400))}
    rows, want = [], {k: [0] * len(r) for k, r in refs.items()}
    for k, count in (("few", 20), ("many", 2 * coverage.FEW), ("short", 3)):
        n = len(refs[k])
        for _ in range(count):
            a, size = rng.randrange(n), rng.randrange(18, 90) if k != "short" else 26
            read = (refs[k] * 9)[a : a + size]
            rows.append((k, read if rng.random() < 0.5 else kernels.reverse_complement(read)))
            if k != "short":
                for i in range(a, a + size):
                    want[k][i % n] += 1
    reads = spark.createDataFrame(rows, "ref_id string, read string")
    references = spark.createDataFrame(list(refs.items()), "ref_id string, reference string")
    found = coverage.stretches(reads, references).cache()
    depths = coverage.depth(reads, references).cache()
    own = {(r["ref_id"], r["pos"]): r["depth"] for r in depths.collect()}
    assert len(own) == sum(map(len, refs.values()))
    for k in ("few", "many", "none"):
        assert [own[k, i] for i in range(len(refs[k]))] == want[k]
    assert found.filter("ref_id = 'few'").count() <= 4 * 20 + 1 and found.filter("ref_id = 'none'").count() == 1
    for of in (coverage.statistics, lambda x: coverage.chart(x, 20), lambda x: coverage.chart(x, 7)):
        assert sorted(map(tuple, of(found).collect())) == sorted(map(tuple, of(depths).collect()))


def test_traces_as_a_column(spark):
    """Equal to those made one at a time, and read in slices of a batch."""
    from insertframe.plans.io_queries import trace, trace_column

    texts = ["", "A", "ACGT", "ACGTN", *("ACGTT" * k for k in range(1, 700))]
    rows = spark.createDataFrame([(f"x/r{k}.ab1", t) for k, t in enumerate(texts)], "source_file string, t string").repartition(1)
    files = rows.withColumn("content", trace_column(F.col("t")))
    assert all(bytes(r["content"]) == trace(r["t"]) for r in files.collect())
    parsed = {r["record_id"]: r for r in abif.of_files(files.select("source_file", "content")).collect()}
    assert len(parsed) == len(texts) and all(parsed[f"r{k}"]["bases"] == t and len(parsed[f"r{k}"]["quality"]) == len(t) for k, t in enumerate(texts))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"source_file": ["a"] * 600, "content": [trace("ACGTT")] * 600})
    assert [b.num_rows for b in abif._parse_files(iter([batch]))] == [256, 256, 88]


def test_library_and_json5(spark):
    text = """// a comment
    {schema_version: 2, /* more */ vectors: [{id: "v", chain_class: 'heavy', sequence: "acgt // no comment",
      insertion_site: {oh5_end: 1, oh3_start: 2,}, features: {constant_region: {start: 2, end: 4}},},],
      overhang_sets: [{id: "s", oh_5: {IGH: "AC"}, oh_3: {}}], alignment: {protein_gap_open: -7, other: 1.5e2},
      optimization_checks: {gc_window: 10}}"""
    lib = library.Library.from_json5(text)
    assert lib.vectors[0].clean == "ACGTNOCOMMENT" and lib.vectors[0].landmark() == "CGTNOCOMMENT"
    assert lib.overhang_sets["s"] == {"IGH": ("AC", None)} and lib.alignment.protein_gap_open == -7
    assert lib.checks.enabled is False and library.Library.from_json5("{}").checks.enabled is True
    assert json5.parse("[1, 2.5, -3, 1e2, null, true, 'it\\'s',]") == [1, 2.5, -3, 100.0, None, True, "it's"]
    assert library.Library.from_json5(lib.to_json()).vectors[0].clean == lib.vectors[0].clean
    known = spark.createDataFrame([("a", "h1", 0)], "id string, sha256 string, idx int")
    new = spark.createDataFrame([("a", "h1", 0), ("b", "h1", 1), ("a", "h2", 2), ("b", "h1", 3)], "id string, sha256 string, idx int")
    appended, conflicts = library.merge(known, new)
    assert {tuple(r) for r in appended.collect()} == {("b", "h1", 1), ("a", "h2", 2), ("b", "h1", 3)}
    assert [tuple(r) for r in conflicts.collect()] == [("b", "h1", "a")] * 2
    # an id that a later entry of the hash has is still another one than the first's
    known = spark.createDataFrame([("a", "h", 0), ("b", "h", 1)], "id string, sha256 string, idx int")
    assert library.merge(known, spark.createDataFrame([("b", "h", 0)], known.schema))[1].count() == 1
    other = library.Library.from_json5(text.replace('id: "s"', 'id: "t"'))
    vectors = [*lib.vectors]
    assert lib.merge_from(other) == [] and lib.vectors == vectors and set(lib.overhang_sets) == {"s", "t"}
    renamed = library.Library([replace(vectors[0], id="w"), replace(vectors[0], id="u", sequence="TT")])
    assert len(lib.merge_from(renamed)) == 1 and [v.id for v in lib.vectors[len(vectors) :]] == ["w", "u"]


def test_project_files(spark, tmp_path):
    text = """{name: "n", overhang_set: "s", vector_assignments: {heavy: "v0"}, order: {file: "o.fasta"},
      name_overrides: {"x 1": {ab_id: "X", chain_class: "heavy"}}}"""
    p = library.Project.from_json5(text)
    assert p.profile == "default" and p.order == {"file": "o.fasta", "format": "", "has_overhangs": True} and p.sequencing is None and p.schema_version == 1
    library.save(spark, str(tmp_path / "p.json"), p)
    assert library.load(spark, str(tmp_path / "p.json"), library.Project) == p
    named = naming.with_names(spark.createDataFrame([("x 1",), ("y_kappa",)], "record_id string"), overrides=p.overrides_frame(spark))
    assert {(r["ab_id"], r["chain_class"]) for r in named.collect()} == {("X", "heavy"), ("y", "kappa")}
    with pytest.raises(ValueError):
        library.Project.from_json5("{name: 'n'}")


def test_constructs(spark):
    lib, project = _planted()
    v = lib.vectors[0]
    h = OH["IGH"]
    order = records(spark, ("Ab1_heavy", h[0] + CORE + h[1]), ("Ab1_heavy", "ACGT"), ("ab2_light", h[0] + CORE + h[1]), ("ab3_heavy", CORE))
    verdicts = order_qc.run(order, lib, project)
    built = constructs.build_construct(verdicts, order, lib, project)
    rows = {(r["record_id"], r["core"]) for r in built.collect()}
    # both verdicts of a repeated id show its first record; light chains go by their overhangs
    assert rows == {("Ab1_heavy", CORE), ("ab2_light", CORE)} and built.count() == 3
    spans = {(r["name"], r["start"], r["end"]) for r in constructs.features(built, lib).collect()}
    region = v.features["constant_region"]
    assert spans == {("insert", v.oh5_end, v.oh5_end + len(CORE)), ("constant region", region["start"] - 1 + len(CORE), region["end"] + len(CORE))}
    f = constructs.facts(built).first()
    assert f["gc"] == sum(c in "GC" for c in CORE) / len(CORE) and f["total_bp"] == len(v.clean) + len(CORE)
    whole = seq_whole(lib, CORE)
    # the last record of an antibody and class is its core: of Ab1's two, that with overhangs
    reads = records(spark, ("AB1_heavy", whole[10:100]), ("ab1_kappa", whole[50:90]), ("ab9_heavy", whole))
    depth = {r["pos"]: r["depth"] for r in constructs.coverage_for(verdicts, order, reads, lib, project).collect()}
    assert len(depth) == len(whole) and [depth[i] for i in (9, 10, 60, 95, 100)] == [0, 1, 2, 1, 0]
    assert constructs.coverage_for(verdicts, order, reads.filter("false"), lib, project).count() == 0


def test_severity_of_reads(spark):
    v = spark.createDataFrame([("a", "PASS"), ("a", "EMPTY_VECTOR"), ("b", "SILENT_VARIANT")], "ab_id string, kind string")
    assert {tuple(r) for r in sequencing_qc.worst(v).collect()} == {("a", "EMPTY_VECTOR", 6), ("b", "SILENT_VARIANT", 2)}


GB = '''LOCUS       tiny                      24 bp    DNA     circular SYN
FEATURES             Location/Qualifiers
     sig_peptide     1..6
                     /note="leader
                     goes on"
     CDS             complement(join(7..9,13..18))
                     /gene="IGHG1"
                     /gene="AmpR"
     misc            odd
                     /pseudo
ORIGIN
        1 atggaactgg ggctccgctg ggtt
//
LOCUS       second
'''


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GB)
    (tmp_path / "b.gb").write_text("LOCUS x\n//\n")
    rows = {r["source_file"][-4:]: r for r in genbank.read(spark, str(tmp_path)).collect()}
    assert rows["b.gb"]["error"] == "no ORIGIN sequence found"
    r = rows["a.gb"]
    assert (r["name"], r["length"], r["circular"], r["sequence"]) == ("tiny", 24, True, "ATGGAACTGGGGCTCCGCTGGGTT")
    assert [(f["kind"], f["start"], f["end"], f["complement"]) for f in r["features"]] == [("sig_peptide", 1, 6, False), ("CDS", 7, 18, True), ("misc", 0, 0, False)]
    assert r["features"][0]["qualifiers"] == {"note": "leader goes on"} and r["features"][1]["qualifiers"] == {"gene": "AmpR"}
    found = genbank.roles([f.asDict() for f in r["features"]])
    assert set(found) == {"signal_peptide", "resistance"}
    v = library.vector_from_genbank(genbank.parse(GB), "v", "V", "heavy", "IgG1", ("GAACTG", None), "s", "IGH", "me")
    assert (v.oh5_end, v.oh3_start, v.topology) == (9, 9, "circular")


def test_abif(spark, tmp_path):
    def entry(name, number, kind, size, offset):
        return struct.pack(">4sihhiii", name, number, kind, 1, size, size, offset) + b"\0" * 4

    data = b"ACGTN-ACGT"
    quality = bytes(range(10))
    start = 34 + len(data) + len(quality)
    inline = int.from_bytes(b"TTTT", "big")
    body = entry(b"PBAS", 1, 2, 4, inline) + entry(b"PBAS", 2, 2, len(data), 34) + entry(b"PCON", 2, 2, len(quality), 34 + len(data))
    root = struct.pack(">4sihhiii", b"tdir", 1, 1023, 28, 3, 84, start) + b"\0" * 4
    (tmp_path / "r1.ab1").write_bytes(b"ABIF\0\1" + root + data + quality + body)
    (tmp_path / "bad.ab1").write_bytes(b"nothing")
    rows = {r["record_id"]: r for r in abif.read(spark, str(tmp_path)).collect()}
    assert rows["r1"]["bases"] == "ACGTNACGT" and bytes(rows["r1"]["quality"]) == quality
    assert rows["bad"]["error"] == "not an ABIF/AB1 file (bad magic)"


def test_tables(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("skipped\n>x one\nACg\n t\n>\nAA\n>x\nCC\n")
    (tmp_path / "b.fasta").write_text(">y\r\nGG\r\n")
    got = [(r["record_id"], r["sequence"]) for r in tables.read_fasta(spark, str(tmp_path)).orderBy("record_idx").collect()]
    assert got == [("x", "ACGT"), ("", "AA"), ("x", "CC"), ("y", "GG")]
    (tmp_path / "t.csv").write_text("Seq ID,Note,SEQUENCE\na ,n,ac-gt\n,n,AA\nc\nb,n,\n")
    got = {(r["record_id"], r["sequence"]) for r in tables.read_id_sequence(spark, str(tmp_path / "t.csv")).collect()}
    assert ("a", "ACGT") in got and not any(r[0] in ("", "c") for r in got)
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>VH</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>1.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "p.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Antibody</t></si><si><t>qvq</t></si></sst>')
    got = {(r["ab_id"], r["heavy"], r["light"]) for r in tables.read_panel(spark, str(tmp_path / "p.xlsx")).collect()}
    assert got == {("7", "QVQ", None), ("1.5", None, None)}
    assert tables.find_column(["Name", "seq_id"], tables.ID_NAMES) == "seq_id" and tables.format_of("x.GBK") == "genbank" and tables.format_of("x") == "fasta"
    panel = tables.panel_from_fasta(records(spark, ("a_heavy", "AA"), ("a_zzz_light", "CC"), ("a_heavy", "GG")))
    assert {(r["ab_id"], r["heavy"], r["light"]) for r in panel.collect()} == {("a", "GG", None), ("a_zzz", None, "CC")}


def test_stream(spark, tmp_path):
    from insertframe.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(f">a_heavy\n{OH['IGH'][0] + CORE + OH['IGH'][1]}\n>b_heavy\nACGT\n")
    lib, project = _planted()
    q = watch.judge(watch.fasta_stream(spark, str(tmp_path / "in")), lambda df: order_qc.run(df, lib, project), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert {r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"NO_GROUND_TRUTH", "OVERHANG_MISSING"}


def test_stream_of_a_file_in_many_splits(spark, tmp_path):
    """Files arrive over two runs and are read by many tasks, numbered as the batch reader does."""
    from insertframe.streaming import watch

    (tmp_path / "in").mkdir()
    body = lambda k, n: "".join(f">r{k}.{i} x\r\nAC\nGT{'A' * (i % 7)}\n" for i in range(n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    tasks = []

    def gate(df):
        tasks.append(df.rdd.getNumPartitions())
        return df

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        for k, names in enumerate((["a"], ["b", "c"])):
            for n in names:
                (tmp_path / "in" / f"{n}.fa").write_bytes(("junk\n" if n == "c" else "").encode() + body(n, 150).encode())
            watch.judge(watch.fasta_stream(spark, str(tmp_path / "in")), gate, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
            own = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch={k}").select("record_id", "sequence", "record_idx").orderBy("record_idx").collect()]
            batch = tables.read_fasta(spark, str(tmp_path / "in" / ("a.fa" if k == 0 else "[bc].fa"))).select("record_id", "sequence", "record_idx")
            assert own == [tuple(r) for r in batch.orderBy("record_idx").collect()] and len(own) == 150 * (k + 1)
            assert [r[0] for r in own] == [f"r{n}.{i}" for n in names for i in range(150)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_page_in_parts(spark, tmp_path):
    """Part files, one after another, are the page; and the page is what it has always been."""
    rows = spark.createDataFrame([(k, f"r<{k}>", "A&B", "heavy", ["PASS", "NO_GROUND_TRUTH", "OVERHANG_MISSING"][k % 3], None) for k in range(40)], "record_idx long, record_id string, ab_id string, chain_class string, kind string, reason string").repartition(7)
    rollup.write_html(str(tmp_path / "p"), "t & t", order=rows, reads=rows, most=30)
    parts = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    page = rollup.html_report("t & t", order=rows, reads=rows, most=30)
    assert parts == page + "\n" and page.count("<tr><td>") == 60 and page.count("The first 30 of 40") == 2
    lines = page.split("\n")
    assert lines[0].startswith("<!doctype html>") and lines[1] == "<h2>Order QC</h2>" and lines[2] == "<p><b>NO_GROUND_TRUTH: 13</b> <b>OVERHANG_MISSING: 13</b> <b>PASS: 14</b></p>"
    assert lines[5] == "<tr><td>r&lt;0&gt;<td>A&amp;B<td>heavy<td style='color:#1b7f3b'>PASS<td></tr>" and lines[-1] == "</table>"


def test_anchor_is_in_the_constant_region():
    assert plain.translate(CONSTANT).startswith(ANCHOR) and plain.translate(LEADER)


def test_sql_functions(spark):
    from insertframe.functions import register, text

    register.register(spark)
    rows = ["ATGGCC", "CTNTAR", "auG taa", "", "QQ"]
    spark.createDataFrame([(r,) for r in rows], "x string").createOrReplaceTempView("sql_rows")
    got = spark.sql("SELECT x, seq_translate(x) AS t, seq_revcomp(x) AS r, seq_gc(x) AS g, seq_type(x) AS k, seq_clean(x) AS c, seq_sha256(x) AS h FROM sql_rows").collect()
    for r in got:
        assert r["t"] == plain.translate(r["x"]) and r["c"] == plain.clean(r["x"])
    assert {r["x"]: r["k"] for r in got}["QQ"] == "aa"
    a = spark.sql("SELECT align_protein('MAG', 'MAG') AS a, circular_identity('ACGT', 'TA') AS c").first()
    assert a["a"]["matches"] == 3 and a["c"] == 1.0
    assert value(spark, text.html_escape(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;" and value(spark, text.short(F.lit("abcdef"), 4)) == "abc…"
    assert value(spark, text.sanitize_id(F.lit("Aé-9"))) == "a__9" and value(spark, text.group_thousands(F.lit(1234567))) == "1,234,567"


def test_command_line(spark, tmp_path, capsys):
    from insertframe.__main__ import main

    lib, _ = _planted()
    (tmp_path / "lib.json5").write_text(lib.to_json())
    (tmp_path / "o.fasta").write_text(f">a_heavy\n{OH['IGH'][0] + CORE + OH['IGH'][1]}\n>b_heavy\nACGT\n")
    (tmp_path / "r.fasta").write_text(f">a_heavy\n{seq_whole(lib, CORE)}\n")
    (tmp_path / "v.gb").write_text(GB)
    main(["order-qc", "--library", str(tmp_path / "lib.json5"), "--order", str(tmp_path / "o.fasta"), "--csv", str(tmp_path / "csv"), "--html", str(tmp_path / "x.html")])
    main(["sequencing-qc", "--library", str(tmp_path / "lib.json5"), "--order", str(tmp_path / "o.fasta"), "--reads", str(tmp_path / "r.fasta")])
    main(["inspect-vector", str(tmp_path / "v.gb")])
    out = capsys.readouterr().out
    assert "Antibodies: 1 of 2 pass all chains" in out and "tiny: 24 bp, circular" in out and "PASS" in out
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0].startswith("record_id,ab_id") and len(lines) == 3


def seq_whole(lib, core):
    v = lib.vectors[0]
    return v.clean[: v.oh5_end] + core + v.clean[v.oh3_start :]


def test_order_meets_panel_without_sequences(spark):
    """What a record brings to its panel entry is its protein, not its fragment, core and parts."""
    rows = spark.createDataFrame([(0, "a_heavy", OH["IGH"][0] + "ATGTGA" + OH["IGH"][1])], "record_idx long, record_id string, sequence string")
    truth = spark.createDataFrame([("A", "atg-tga", None, 0)], "ab_id string, heavy string, light string, idx int")
    lib = library.Library(overhang_sets={"s": OH})
    run = order_qc.run(rows, lib, library.Project.ad_hoc(lib), truth)
    assert run.first()["kind"] == "FRAMESHIFT_AT_JUNCTION"  # its protein, M, is the panel's; a stop follows
    plan = run._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    output = plan.children().head().output()
    assert not {"sequence", "st", "core", "core_aa", "orf"} & {output.apply(i).name() for i in range(output.size())}


def test_protein_of_columns(spark):
    given = ["ATGGCC", "CTN", "TAR", "AUG", "TAATAGTGA", "", "AC", "GGXA", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    assert [r["p"] for r in rows.select("i", seq.protein_of(F.col("s")).alias("p")).orderBy("i").collect()] == ["MA", "L", "X", "M", "***", "", "", "G", None]
    over = rows.select("i", kernels.gc_over(F.col("s"), 0.5, 3, 0.9).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in over] == [True, False, False, False, False, False, False, False, None]
