"""Alignment kernels against a full matrix filled cell by cell, and the search for swapped samples pair by pair."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from insertframe.functions import kernels, seq
from insertframe.operators import sequencing_qc
from insertframe.plans import queries

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def plain(a, b, s):
    """Three states a cell; the way back follows the best one of each cell, the first of equal ones."""
    low = -(10**9)
    score = (lambda x, y: int(s.table[ord(x), ord(y)])) if s.match is None else (lambda x, y: s.match if x == y else s.mismatch)
    n, m = len(a), len(b)
    d, u, r = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    d[0][0] = 0
    for i in range(1, n + 1):
        u[i][0] = s.gap_open + (i - 1) * s.gap_extend
    for j in range(1, m + 1):
        r[0][j] = s.gap_open + (j - 1) * s.gap_extend
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = max(d[i - 1][j - 1], u[i - 1][j - 1], r[i - 1][j - 1]) + score(a[i - 1], b[j - 1])
            u[i][j] = max(max(d[i - 1][j], r[i - 1][j]) + s.gap_open, u[i - 1][j] + s.gap_extend)
            r[i][j] = max(max(d[i][j - 1], u[i][j - 1]) + s.gap_open, r[i][j - 1] + s.gap_extend)
    i, j, x, y = n, m, "", ""
    while i or j:
        best = max(d[i][j], u[i][j], r[i][j])
        way = "r" if i == 0 else "u" if j == 0 else "d" if d[i][j] == best else "u" if u[i][j] == best else "r"
        x, y = (a[i - 1] if way != "r" else "-") + x, (b[j - 1] if way != "u" else "-") + y
        i, j = i - (way != "r"), j - (way != "u")
    gaps = sum("-" in p for p in zip(x, y))
    same = sum(p == q for p, q in zip(x, y))
    return max(d[n][m], u[n][m], r[n][m]), x, y, same, len(x) - gaps - same, gaps


def pairs(n, seed):
    r = random.Random(seed)
    word = lambda letters, most: "".join(r.choices(letters, k=r.randrange(most)))
    for _ in range(n):
        letters = r.choice([AMINO, "AC", AMINO + "BZX*", "WX"])
        a = word(letters, 24)
        near = "".join(c for c in a if r.random() < 0.85) + word(letters, 3)
        yield a, r.choice([a, near, word(letters, 24)])


@pytest.mark.parametrize("every", [1, 4, 256])
def test_alignment(monkeypatch, every):
    """Rows kept now and then give the same path as a matrix that is kept whole."""
    monkeypatch.setattr(kernels, "EVERY", every)
    for scoring in (kernels.protein_scoring(), kernels.nucleotide_scoring(), kernels.nucleotide_scoring(1, 1, -1, -1)):
        for a, b in pairs(150, every):
            assert kernels.global_affine(a, b, scoring) == plain(a, b, scoring)


def test_work_goes_by_the_shorter_side(monkeypatch):
    """A long protein against a short one fills rows of the short one, whichever comes first."""
    r, rows = random.Random(3), []
    long, short = "".join(r.choices(AMINO, k=5000)), "".join(r.choices(AMINO, k=40))
    own = kernels._next_row
    monkeypatch.setattr(kernels, "_next_row", lambda *args: rows.append(1) or own(*args))
    for a, b in ((long, short), (short, long)):
        rows.clear()
        kernels.global_affine(a, b, kernels.protein_scoring())
        assert len(rows) <= 2 * len(short)


def test_marks_that_are_there_letter_by_letter(monkeypatch):
    """Are found as by the search over all offsets, which is not run for them."""
    r = random.Random(5)
    word = lambda n: "".join(r.choices("ACGT", k=n))
    marks = [word(n) for n in (30, 12, 30, 90)]
    search = lambda text, mark: max(kernels._hits(np.frombuffer((text + text[: len(mark) - 1]).encode(), np.uint8), np.frombuffer(mark.encode(), np.uint8))) / len(mark) if len(mark) <= len(text) else kernels.best_ungapped_identity(text, mark)
    for k in range(200):
        mark = r.choice(marks)
        text = r.choice([mark[5:] + word(40) + mark[:5], word(60), mark[3:40], mark + word(30) + r.choice(marks)])
        text = text if k % 2 else kernels.reverse_complement(text)
        all_ = [max(search(text, m), search(kernels.reverse_complement(text), m)) for m in marks]
        assert kernels.closest_mark(text, marks) == (int(np.argmax(all_)), max(all_))
    monkeypatch.setattr(kernels, "_hits", None)
    assert kernels.closest_mark(marks[0][5:] + word(40) + marks[0][:5], marks) == (0, 1.0)
    assert kernels.normalize(word(9) + marks[0] + word(3), marks[0])[1:] == (False, 9)


def test_protein_of_any_text(spark):
    """The translation in numpy is that of the expression, whatever stands in the text."""
    r = random.Random(4)
    texts = [None, "", "at", "É-a t\u0130g \U0001f600", *("".join(r.choices("ACGTUNacgtuxz *1é", k=r.randrange(60))) for _ in range(200))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(seq.protein_to_stop(F.col("t")).alias("a"), seq.translate_to_stop(F.col("t")).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in rows) and sum(x["a"] is None for x in rows) == 1


def test_place_is_the_first_of_a_circle():
    r = random.Random(8)
    for _ in range(3000):
        text, mark = ("".join(r.choices("AC", k=r.randrange(n))) for n in (14, 6))
        want = (text + text[: len(mark) - 1]).find(mark) if 0 < len(mark) <= len(text) else -1
        assert kernels.place(text, mark) == want, (text, mark)


def test_a_strand_letter_by_letter_needs_no_search(monkeypatch):
    """A reversed read that has the landmark is told without a comparison at every offset of the other strand."""
    r = random.Random(5)
    word = lambda n: "".join(r.choices("ACGT", k=n))
    mark, rest = word(30), word(200)
    want = kernels.normalize(kernels.reverse_complement(rest + mark), mark)
    monkeypatch.setattr(kernels, "_hits", None)
    assert kernels.normalize(kernels.reverse_complement(rest + mark), mark) == want == (mark + rest, True, 200)


def test_verdicts_align_no_more_than_they_look_at(spark, monkeypatch):
    """Whole and empty reads of long inserts get verdicts with no alignment of unlike lengths; the columns that show them still have it."""
    lib, project = queries._planted()
    v, r = lib.vectors[0], random.Random(6)
    cores = {f"M{k}": "".join("C" + r.choice("ACGT") + "C" for _ in range(70 * (k + 1))) for k in range(4)}
    insert = lambda k, c: ("", c, c[:-1], c[:30] + "TGG" + c[33:])[k]
    reads = spark.createDataFrame([(k, f"{m}_heavy", v.clean[: v.oh5_end] + insert(k, c) + v.clean[v.oh3_start :]) for k, (m, c) in enumerate(cores.items())], "record_idx long, record_id string, sequence string")
    own = spark.createDataFrame([(m, "heavy", c) for m, c in cores.items()], "ab_key string, core_class string, core string")
    kinds = ["EMPTY_VECTOR", "PASS", "JUNCTION_FRAMESHIFT", "POINT_MUTATION"]
    rows = sequencing_qc.run(reads, lib, project, own).orderBy("record_idx").collect()
    assert [x["kind"] for x in rows] == kinds
    for x in rows:
        a, b = (x[c].replace("-", "") for c in ("aligned_observed", "aligned_expected"))
        assert [x["aligned_observed"], x["aligned_expected"], x["n_gap_columns"]] == [kernels.global_affine(a, b, kernels.protein_scoring())[k] for k in (1, 2, 5)]
    assert rows[0]["n_gap_columns"] >= 70 and rows[1]["n_gap_columns"] == 0 and len(rows[3]["mutations"]) == 1
    align = kernels.global_affine

    def only_alike(a, b, scoring):
        if len(a) != len(b):
            raise AssertionError("unlike lengths are aligned")
        return align(a, b, scoring)

    monkeypatch.setattr(kernels, "global_affine", only_alike)
    assert [x["kind"] for x in sequencing_qc.run(reads, lib, project, own).select("record_idx", "kind").orderBy("record_idx").collect()] == kinds


def test_frames_and_windows_by_the_batch(spark):
    """The three frames and the windows of GC are kernels, equal to plain ones on odd sequences."""
    from insertframe.sources import plain

    r = random.Random(11)
    texts = [None, "", "A", "ac-gu", "NNNNNNNN", "TAATAATAATAA"] + ["".join(r.choices(r.choice(["ACGT", "ACGTUN", "ACGTRYxyz "]), k=r.randrange(200))) for _ in range(300)]
    leaders = [r.choice([None, "", plain.translate(t or "")[2:20], plain.translate((t or "")[1:])[4:9], "WWWW"]) for t in texts]
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, leaders)), "k int, t string, l string")
    rows = rows.select("k", seq.best_frame_protein(F.col("t")).alias("b"), seq.locate_orf(F.col("t"), F.col("l")).alias("o"), seq.max_windowed_gc(F.col("t"), 60).alias("g"), seq.translate(F.col("t")).alias("p"))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    for x, t, lead in zip(rows.orderBy("k").collect(), texts, leaders):
        if t is None:
            assert (x["b"], x["o"], x["g"], x["p"]) == (None,) * 4
            continue
        s = plain.clean(t)
        frames = [plain.translate(s[f:]) for f in range(3)]
        hits = sorted((p.find(lead[:8]), f) for f, p in enumerate(frames) if lead is not None and len(s) > f and lead[:8] in p)
        assert x["b"] == max((p.split("*")[0] for p in frames), key=len) and x["p"] == frames[0]
        assert x["o"] == (frames[hits[0][1]][hits[0][0] :] if hits else frames[0])
        gc = [sum(c in "GC" for c in s[i : i + 60]) / 60 for i in range(len(s) - 59)] if len(s) > 60 else [sum(c in "GC" for c in s) / max(len(s), 1)]
        assert x["g"] == max(gc)


def test_many_at_once():
    scoring = kernels.protein_scoring()
    r = random.Random(7)
    for a, b in pairs(300, 5):
        others = [b, a, *("".join(r.choices(AMINO + "X", k=r.randrange(24))) for _ in range(3))]
        lengths = np.array([len(x) for x in others])
        block = np.zeros((len(others), max(1, lengths.max())), np.uint8)
        for k, x in enumerate(others):
            block[k, : len(x)] = list(x.encode())
        got = kernels.identities(a, block, lengths, scoring)
        assert list(zip(*map(list, got))) == [kernels.global_affine(a, x, scoring)[3:5] for x in others]


def test_memory_of_a_long_alignment():
    r = random.Random(1)
    a, b = ("".join(r.choices(AMINO, k=6000)) for _ in range(2))
    kernels.global_affine(a[:300], b[:300], kernels.protein_scoring())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    kernels.global_affine(a, b, kernels.protein_scoring())
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 100


@pytest.mark.parametrize("shard", [1, 5, 64])
def test_swaps_pair_by_pair(spark, monkeypatch, shard):
    """The search's answers are those of every pair's own alignment."""
    monkeypatch.setattr(sequencing_qc, "SHARD", shard)
    r = random.Random(shard)
    base = ["".join(r.choices(AMINO, k=60)) for _ in range(12)]
    panel = {f"M{k}": p for k, p in enumerate(base + [base[0], base[1][:-5], base[2] + "AA", base[3][:30] + "W" + base[3][31:]])}
    lib, project = queries._planted()
    v, code = lib.vectors[0], {a: c for c, a in seq.CODONS.items()}
    orf = lambda p: "".join(code[x] for x in p)
    wrong = {f"M{k}": r.choice(base) for k in range(16)}
    reads = spark.createDataFrame([(k, f"{m}_heavy", v.clean[: v.oh5_end] + orf(p) + v.clean[v.oh3_start :]) for k, (m, p) in enumerate(wrong.items())], "record_idx long, record_id string, sequence string")
    truth = spark.createDataFrame([(m, p, None, 0) for m, p in panel.items()], "ab_id string, heavy string, light string, idx int")
    got = {x["ab_id"]: (x["kind"], x["suspected_identity"]) for x in sequencing_qc.run(reads, lib, project, None, truth).collect()}
    tail = seq_tail(v)
    for m, p in wrong.items():
        scores = {k: kernels.global_affine(p + tail, t, kernels.protein_scoring()) for k, t in panel.items()}
        best = min(panel, key=lambda k: (-scores[k][3] / max(scores[k][3] + scores[k][4], 1), k))
        fit = scores[best][3] / max(scores[best][3] + scores[best][4], 1)
        if got[m][0] == "WRONG_INSERT_SWAP":
            assert fit >= 0.95 and best != m and got[m][1] == best
        elif got[m][0] == "POINT_MUTATION":
            assert fit < 0.95 or best == m
        else:
            assert got[m][0] in ("PASS", "SILENT_VARIANT")


def seq_tail(v):
    from insertframe.sources.plain import translate_to_stop

    return translate_to_stop(v.clean[v.oh3_start :])


def test_one_computation_of_the_reads(spark):
    """With a panel, the plan that gives the verdicts has no alignment of reads left: they were kept."""
    lib, project = queries._planted()
    reads, cores = queries._reads(spark, "/root/testdata/sf0.001")
    truth = cores.select(F.col("ab_key").alias("ab_id"), seq.translate_to_stop(F.col("core")).alias("heavy"), F.lit(None).cast("string").alias("light"), F.lit(0).alias("idx"))
    plan = sequencing_qc.run(reads, lib, project, cores, truth)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the search alone
