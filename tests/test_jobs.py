"""The jobs: growing input, reruns, interrupted runs, odd rows, and their command lines."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import order_release, queries, registry_intake
from jobs.common import default_config

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.select(columns).collect())


def by_sql(sql, columns, documents=DATA / "documents.parquet"):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    return sorted(map(repr, con.sql(f"SELECT {', '.join(sorted(columns))} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert rows_of(df) == by_sql(queries.ORACLES[name], df.columns)


# ------------------------------------------------------------------------------ order release

@pytest.fixture(scope="module")
def config():
    return default_config("order_release")


def order_of(spark, at, rows):
    """A folder with the orders table and no panel."""
    spark.createDataFrame(rows, "record_idx long, record_id string, sequence string").write.mode("overwrite").parquet(f"{at}/orders")
    return str(at)


PLAIN = {"format": "parquet", "table": "orders", "columns": {"record_idx": "record_idx", "record_id": "record_id", "sequence": "sequence"}}


def fragment(config, locus, core):
    own = config["library"]["overhang_sets"][0]
    return own["oh_5"][locus] + core + own["oh_3"][locus]


def test_release_of_a_small_order(spark, tmp_path, config):
    config = {**config, "order": PLAIN, "panel": None}
    good, light = fragment(config, "IGH", "CACCTC"), fragment(config, "IGK", "CACCTC")
    rows = [(0, "A_heavy", good), (1, "A_kappa", light), (2, "B_heavy", good), (3, "B_kappa", light[20:]), (4, "C_heavy", good), (5, None, None), (6, "", "")]
    out = str(tmp_path / "out")
    counts = order_release.run(spark, config, order_of(spark, tmp_path / "t", rows), "x", out)
    assert counts == {"read": 7, "verdicts": 7, "antibodies": 4, "released": 1, "sent": 2}
    got = {r["record_idx"]: (r["ab_id"], r["kind"], r["released"], r["sent_length"]) for r in order_release.written(spark, out).collect()}
    assert got[0] == ("A", "NO_GROUND_TRUTH", True, len(good)) and got[3] == ("B", "OVERHANG_MISSING", False, None)
    # the light chain of B failed, and C has but one chain
    assert not got[2][2] and not got[4][2]
    sent = spark.read.option("header", True).csv(f"{out}/release").orderBy("record_idx").collect()
    assert [(r["record_id"], r["sequence"]) for r in sent] == [("A_heavy", good), ("A_kappa", light)]


def test_release_rerun_replaces_its_order_alone(spark, tmp_path, config):
    config = {**config, "order": PLAIN, "panel": None}
    good = fragment(config, "IGH", "CAC")
    out = str(tmp_path / "out")
    first = order_of(spark, tmp_path / "a", [(0, "A_heavy", good), (1, "A_kappa", "ACGT")])
    order_release.run(spark, config, first, "one", out)
    order_release.run(spark, config, order_of(spark, tmp_path / "b", [(0, "Z_heavy", good)]), "two", out)
    before = rows_of(order_release.written(spark, out))
    order_release.run(spark, config, first, "one", out)
    assert rows_of(order_release.written(spark, out)) == before
    # a corrected order: rows and severities that are gone leave nothing behind
    order_release.run(spark, config, order_of(spark, tmp_path / "a", [(0, "A_heavy", good)]), "one", out)
    got = order_release.written(spark, out).collect()
    assert sorted((r["order"], r["record_id"], r["severity"]) for r in got) == [("one", "A_heavy", "Advisory"), ("two", "Z_heavy", "Advisory")]


def test_release_of_a_hot_antibody_and_of_nothing(spark, tmp_path, config):
    config = {**config, "order": PLAIN, "panel": None}
    bad = [(i, "HOT_heavy", "ACGT") for i in range(3000)]
    counts = order_release.run(spark, config, order_of(spark, tmp_path / "t", bad), "hot", str(tmp_path / "out"))
    assert counts["antibodies"] == 1 and counts["sent"] == 0
    r = spark.read.parquet(str(tmp_path / "out/antibodies")).collect()[0]
    assert (r["n_chains"], r["n_failed"], r["first_failed"]) == (3000, 3000, "HOT_heavy: OVERHANG_MISSING")
    none = order_release.run(spark, config, order_of(spark, tmp_path / "e", []), "none", str(tmp_path / "out"))
    assert none == {"read": 0, "verdicts": 0, "antibodies": 0, "released": 0, "sent": 0}


# ---------------------------------------------------------------------------- registry intake

@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The documents in three files, by doc_id."""
    at = tmp_path_factory.mktemp("parts")
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    for k in range(3):
        own = docs.filter((F.col("doc_id") >= 70 * k) & (F.col("doc_id") < (70 * (k + 1) if k < 2 else 1 << 40)))
        own.coalesce(1).write.parquet(f"{at}/w{k}")
        shutil.copy(next(Path(f"{at}/w{k}").glob("part-*.parquet")), at / f"d{k}.parquet")
    return at


ENTRY = ("id", "idx", "ab_id", "chain_class", "sha256", "n", "kind", "gc", "max_gc", "protein_length", "existing_id", "n_entries", "shortest", "longest")


def took(spark, out):
    return rows_of(registry_intake.written(spark, out).select(*ENTRY))


def test_intake_takes_what_is_new(spark, parts, tmp_path):
    """Two runs over growing input equal one over all of it, as ids grow with the files."""
    config, src, out = default_config("registry_intake"), tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    run = lambda: registry_intake.run(spark, config, str(src), out, f"{out}/checkpoint")
    shutil.copy(parts / "d0.parquet", src)
    assert run()["read"] == 70
    first = took(spark, out)
    before = {f: f.stat().st_mtime_ns for f in Path(out, "registry").rglob("part-*")}
    assert run() == {"read": 0, "entered": 0, "conflicts": 0, "batches": 0} and took(spark, out) == first
    for k in (1, 2):
        shutil.copy(parts / f"d{k}.parquet", src)
    counts = run()
    assert counts["read"] == 130 and counts["batches"] == 1
    assert {f: f.stat().st_mtime_ns for f in before} == before  # what was written stays as it is
    assert took(spark, out) == by_sql(queries.ORACLES["job2_registry_intake"], ENTRY)


def test_intake_that_was_stopped(spark, parts, tmp_path, monkeypatch):
    """A run that dies after it wrote half of its batch is made good by the next one."""
    config, src, out = default_config("registry_intake"), tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    run = lambda: registry_intake.run(spark, config, str(src), out, f"{out}/checkpoint")
    shutil.copy(parts / "d0.parquet", src)
    run()
    for k in (1, 2):
        shutil.copy(parts / f"d{k}.parquet", src)
    merge = registry_intake.library.merge

    def dies(firsts, incoming):
        rows, conflicts = merge(firsts, incoming)
        return rows, conflicts.withColumn("id", F.raise_error(F.lit("stopped")).cast("string"))

    with monkeypatch.context() as m:
        m.setattr(registry_intake.library, "merge", dies)
        with pytest.raises(Exception, match="stopped"):
            run()
    assert Path(out, "registry/batch=1").exists() and not Path(out, "antibodies/batch=1").exists()
    assert run()["read"] == 130
    assert took(spark, out) == by_sql(queries.ORACLES["job2_registry_intake"], ENTRY)


def test_intake_keeps_what_it_tells(spark, parts, tmp_path, monkeypatch):
    """What is told of a batch's sequences is kept while the merge reads it, and let go after."""
    merge, seen = registry_intake.library.merge, []

    def held(firsts, incoming):
        seen.append((incoming, incoming.storageLevel.useDisk))
        return merge(firsts, incoming)

    monkeypatch.setattr(registry_intake.library, "merge", held)
    out = str(tmp_path / "out")
    registry_intake.run(spark, default_config("registry_intake"), str(parts), out, f"{out}/checkpoint")
    assert seen and all(kept and not df.storageLevel.useDisk for df, kept in seen)


def test_intake_of_odd_rows(spark, tmp_path):
    config = {"format": "json", "schema": "a string, b long, s string", "columns": {"id": "a", "idx": "b", "sequence": "s"}, "gc_window": 60}
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("".join(json.dumps(dict(zip("abs", r))) + "\n" for r in rows))
    run = lambda: registry_intake.run(spark, config, str(src), out, f"{out}/checkpoint")
    put("a.json", [("X_heavy", 1, "ac gt"), ("X_heavy", 2, "ACGT"), ("Y_light", 3, "ACGT"), (None, 4, None), ("", 5, ""), ("Z_hc", None, "GGGG")])
    assert run() == {"read": 6, "entered": 4, "conflicts": 1, "batches": 1}
    put("b.json", [("X_heavy", 0, "ACGT"), ("Q_heavy", 0, "GGGG"), ("Y_light", 9, "ACGT")] + [("H_lc", k, "ACGTACGT") for k in range(500)])
    # X has it; Q and Y have sequences of others; of 500 equal rows one enters
    assert run() == {"read": 503, "entered": 3, "conflicts": 2, "batches": 1}
    got = {(r["id"], r["sequence"]): r["existing_id"] for r in registry_intake.written(spark, out).collect()}
    assert got[("Y_light", "ACGT")] == "X_heavy" and got[("Q_heavy", "GGGG")] == "Z_hc" and got[("H_lc", "ACGTACGT")] is None and got[("", "")] is None


# ------------------------------------------------------------------------------ command lines

@pytest.mark.parametrize(
    "job, given, last",
    [
        ("order_release", ["--tables", str(DATA), "--order", "o1"], {"read": 200, "verdicts": 200, "antibodies": 100, "released": 60, "sent": 120}),
        ("registry_intake", ["--source", f"{DATA}/documents.parque[t]"], {"read": 200, "entered": 196, "conflicts": 7, "batches": 1}),
    ],
)
def test_command_line(tmp_path, job, given, last):
    own = ["--checkpoint", str(tmp_path / "c")] if job == "registry_intake" else ["--config", str(ROOT / "jobs/order_release.json")]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given, "--out", str(tmp_path / "out"), *own], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.splitlines()[-1]) == last
    assert "read 200" in done.stderr and "wrote" in done.stderr or "entered" in done.stderr
