"""Tables of many files: own headers, quoted line ends, many splits, files that can't be read."""

import csv
import io
import random

import pytest

from insertframe.plans.io_queries import workbook
from insertframe.sources import reads, tables


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def got(df):
    return [(r["record_id"], r["sequence"]) for r in df.orderBy("record_idx").collect()]


def test_each_csv_under_its_own_header(spark, tmp_path):
    at = put(tmp_path / "t", a__csv="id,note,seq\na1,x,ACGT\n", b__csv='"Seq"," Seq ID ","x,y"\nTTTT,b1,y\nGG,b2,z\n', c__csv="name,ID,Sequence\nc1,C9,AA\n")
    # of a file's headers the alias that comes first wins: id before name
    assert got(tables.read_id_sequence(spark, at, "csv")) == [("a1", "ACGT"), ("b1", "TTTT"), ("b2", "GG"), ("C9", "AA")]


def test_each_workbook_under_its_own_header(spark, tmp_path):
    at = put(tmp_path / "t", a__xlsx=workbook([["id", "seq"], ["a1", "ACGT"], ["a2"]]), b__xlsx=workbook([["Sequence", "n", "name"], ["TT", "", "b1"]]), c__xlsx=workbook([["id", "note"], ["c", "x"]]))
    assert got(reads.read_folder(spark, at)) == [("a1", "ACGT"), ("a2", ""), ("b1", "TT")]
    assert [(r["source_file"].rsplit("/", 1)[1], r["error"]) for r in reads.unreadable(spark, at).collect()] == [("c.xlsx", "no sequence column found")]


def test_short_and_long_rows(spark, tmp_path):
    """Empty cells are cells; rows that end before theirs are dropped, further cells not looked at."""
    at = put(tmp_path / "t", a__csv='id,x,seq\na,1\nb,1,\nc,1,AC,GT,"z"\n,1,AC\n" d ",",","AC""GT"\n\n   \ne,5" mark,GG\n')
    assert got(tables.read_id_sequence(spark, at, "csv")) == [("b", ""), ("c", "AC"), ("d", "ACGT"), ("e", "GG")]


def test_unreadable_of_every_format(spark, tmp_path):
    """A broken file of each format is named, and stops none of the others."""
    bad = {"a.csv": b"x,y\n1,2\n", "b.csv": b'id,seq\na,"AC\n', "c.csv": b"id,seq\n\xff,AC\n", "e.csv": b"\n\n", "f.fa": b"ACGT\n", "g.fa": b">x\xfe\nAC\n", "h.xlsx": b"no", "i.ab1": b"no", "j.gb": b"no"}
    at = put(tmp_path / "t", **{k.replace(".", "__"): v for k, v in bad.items()}, k__csv="id,seq\nk,AC\n", l__fa=">l\nGT\n")
    told = {r["source_file"].rsplit("/", 1)[1]: r["error"] for r in reads.unreadable(spark, at).collect()}
    assert told.keys() == bad.keys()
    assert told["a.csv"] == "no id column found" and told["b.csv"] == "a quoted cell is not closed" and told["c.csv"] == told["g.fa"] == "not UTF-8 text" and told["e.csv"] == "no header" and told["f.fa"] == "no record"
    assert sorted(got(reads.read_folder(spark, at))) == [("k", "AC"), ("l", "GT")]
    with pytest.raises(ValueError, match="no id column"):
        tables.read_id_sequence(spark, f"{at}/a.csv")
    assert reads.read_folder(spark, put(tmp_path / "u", a__csv="x,y\n1,2\n")).count() == 0


@pytest.mark.parametrize("split", ["128m", "700b"])
@pytest.mark.parametrize("spans", [False, True])
def test_random_csv_against_the_csv_module(spark, tmp_path, split, spans):
    """Many quoted cells, some over several lines, read whole and in splits of a few records."""
    r = random.Random(f"{split}{spans}")
    folder, expect = tmp_path / "t", []
    folder.mkdir()
    for f in range(4):
        order = r.sample(range(4), 4)
        names = [["id", "note", "SEQ", "more\nlines" if spans else "more"][k] for k in order]
        out = io.StringIO()
        w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
        w.writerow(names)
        for k in range(120):
            note = "".join(r.choice(['a', '"', ",", " ", "é", "\n" if spans else "b"]) for _ in range(r.randrange(25)))
            cells = [f"f{f}r{k}", note, "".join(r.choice("ACGT") for _ in range(r.randrange(12))), note[::-1]]
            w.writerow([cells[i] for i in order])
            expect.append((cells[0], cells[2]))
        (folder / f"{f}.csv").write_text(out.getvalue(), newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        df = tables.read_id_sequence(spark, str(folder), "csv")
        assert got(df) == expect
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_panels_of_several_files(spark, tmp_path):
    at = put(tmp_path / "t", a__csv="Clone ID,VH\nA,QV\nB,\n", b__csv="lc,heavy chain,mAb\nDI,EV,C\n")
    rows = tables.read_panel(spark, at, declared="csv").orderBy("idx").collect()
    assert [(r["ab_id"], r["heavy"], r["light"]) for r in rows] == [("A", "QV", None), ("B", None, None), ("C", "EV", "DI")]
    own = tables.read_panel(spark, f"{at}/b.csv", columns={"heavy": "lc"}).collect()[0]
    assert (own["heavy"], own["light"]) == ("DI", "DI")
    assert tables.read_headers(spark, f"{at}/b.csv") == ["lc", "heavy chain", "mAb"]


def test_roles_and_vectors_of_many_maps(spark, tmp_path):
    """The same as of one record at a time on the driver."""
    from insertframe.operators import library, maps
    from insertframe.sources import genbank
    from pyspark.sql import functions as F

    def record(k, rows, sequence, shape="circular"):
        return f"LOCUS m{k} 1 bp DNA {shape}\nFEATURES  Location\n" + "".join(f"     {kind}  {place}\n" + "".join(f'          /{q}="{v}"\n' for q, v in own) for kind, place, own in rows) + f"ORIGIN\n 1 {sequence}\n//\n"

    dna = "ATGGCTCAAACCGATTTCGGACTGCATAAGGAACCTGATCCGAACTACGTTTGGCATACCAAAGGCTAA"
    kinds = [("sig_peptide", "1..9", []), ("CDS", "20..40", [("gene", "IGHG1")]), ("CDS", "complement(5..8)", [("note", "AmpR promoter")]), ("promoter", "3..4", [("standard_name", ""), ("gene", "CMV")]), ("misc", "7", [("note", "pUC ori"), ("gene", "AmpR")]), ("x", "none", [("note", "constant")])]
    r = random.Random(2)
    texts = {f"m{k}": record(k, r.sample(kinds, r.randrange(len(kinds) + 1)), dna[r.randrange(9) :], r.choice(["circular", "linear"])) for k in range(40)}
    at = put(tmp_path / "t", **{f"{k}__gb": v for k, v in texts.items()}, bad__gb="x")
    records = genbank.read(spark, at)
    got = {}
    for x in genbank.feature_roles(records).withColumn("f", F.regexp_extract("source_file", r"(m\d+)\.gb", 1)).collect():
        got.setdefault(x["f"], {})[x["role"]] = {"start": x["start"], "end": x["end"], "name": x["name"]}
    parsed = {k: genbank.parse(v) for k, v in texts.items()}
    assert got == {k: found for k, v in parsed.items() if (found := genbank.roles(v["features"]))}
    for oh5, oh3 in ((None, None), ("TCGGACTG", "GATCC"), ("WW", ""), ("", "WWW")):
        asked = records.select("source_file", F.regexp_extract("source_file", r"([^/]*)\.gb", 1).alias("vector_id"), F.lit("heavy").alias("chain_class"), F.lit(oh5).alias("oh5"), F.lit(oh3).alias("oh3"))
        for x in maps.vectors_of_maps(records, asked).collect():
            v = library.vector_from_genbank(parsed[x["vector_id"]], x["vector_id"], "", "heavy", "", (oh5, oh3), "s", "IGH", "me")
            assert (x["sequence"], x["oh5_end"], x["oh3_start"], x["constant_anchor_aa"], x["topology"]) == (v.sequence, v.oh5_end, v.oh3_start, v.constant_anchor_aa, v.topology)
            assert {k: p.asDict() for k, p in x["features"].items()} == v.features


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_flat_files_of_many_maps(spark, tmp_path, split):
    """A file holds any number of records, each read by the task that it begins in; those that can't be read are told."""
    from insertframe.operators import maps
    from insertframe.sources import genbank
    from pyspark.sql import functions as F

    end = {"a": "\n", "b": "\r\n"}
    texts = {f: "".join(f"LOCUS       {f}{k} {k + 5} bp DNA circular SYN\nFEATURES  Location\n     sig_peptide  1..{k + 1}\n          /note=\"a//b\"\n" + ("" if k == 7 else f"ORIGIN\n 1 {'acgta' * (k + 1)}\n") + "//\n" for k in range(30)).replace("\n", end[f]) for f in end}
    at = put(tmp_path / "t", a__gb=texts["a"], b__gb=texts["b"].rstrip().rstrip("/"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        records = genbank.read_records(spark, at)
        found = {r["name"]: r for r in records.filter("error is null").collect()}
        assert found.keys() == {f"{f}{k}" for f in end for k in range(30) if k != 7}
        assert all(r["sequence"] == "ACGTA" * (int(n[1:]) + 1) and r["features"][0]["qualifiers"] == {"note": "a//b"} for n, r in found.items())
        assert records.filter("error is not null").count() == 2
        asked = records.withColumns({"vector_id": F.col("name"), "chain_class": F.lit("heavy"), "oh5": F.lit(""), "oh3": F.lit(None).cast("string")})
        vectors = maps.vectors_of_maps(asked)
        assert {(r["vector_id"], r["oh5_end"]) for r in vectors.collect()} == {(n, int(n[1:]) + 1) for n in found}
        assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_records_over_splits(spark, tmp_path):
    """Records that span any number of splits, beside files of one line a record; cells are parsed once."""
    rng = random.Random(5)
    odd = ["", "a,b", 'say "x"', "\n", "\n\n", 'x\n"y"\n', "," * 5, "l\n" * 40, '"', "z"]
    want = []
    for k in range(3):
        rows = [(f"f{k}r{i}", rng.choice(odd), rng.choice(["ACGT", "GG", "TTTTTT"])) for i in range(60)]
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["id", "note", "seq"])
            out.writerows(rows if k < 2 else [(i, "plain", s) for i, _, s in rows])
        want += [(i, s) for i, _, s in rows]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, batch in (("48", "3"), ("700", "7"), ("1m", "10000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = tables.read_id_sequence(spark, str(tmp_path), "csv")
            assert [(r["record_id"], r["sequence"]) for r in got.orderBy("record_idx").collect()] == want
            assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") <= 3  # one each: records of a line, whole in a split, put together
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
