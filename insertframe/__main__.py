"""Command line: order-qc, sequencing-qc and inspect-vector, for python -m or spark-submit."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insertframe.operators import order_qc, rollup, sequencing_qc
from insertframe.operators.library import Library, Project, load
from insertframe.sources import genbank, reads, tables


def _panel(spark: SparkSession, path: str | None) -> DataFrame | None:
    if not path:
        return None
    if tables.format_of(path) == "fasta":
        return tables.panel_from_fasta(tables.read_fasta(spark, path))
    return tables.read_panel(spark, path)


def _write(verdicts: DataFrame, columns: tuple[str, ...], args, **page) -> None:
    if args.csv:
        rollup.write_csv(verdicts, columns, args.csv)
        print(f"wrote {args.csv}")
    if args.html:
        Path(args.html).write_text(rollup.html_report(args.name, **page), encoding="utf-8")
        print(f"wrote {args.html}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="insertframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("order-qc", "sequencing-qc"):
        c = sub.add_parser(name)
        c.add_argument("--library", required=True)
        c.add_argument("--project", help="JSON5 of a project; else the library's first vectors, set and profile")
        c.add_argument("--order", required=name == "order-qc")
        c.add_argument("--ground-truth")
        c.add_argument("--heavy-vector")
        c.add_argument("--overhang-set")
        c.add_argument("--no-overhangs", action="store_true")
        c.add_argument("--csv")
        c.add_argument("--html")
        c.add_argument("--name", default="ad hoc")
        if name == "sequencing-qc":
            c.add_argument("--reads", required=True)
            c.add_argument("--partial-sanger", action="store_true")
    sub.add_parser("inspect-vector").add_argument("path")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("insertframe").getOrCreate()
    if args.command == "inspect-vector":
        for r in genbank.read(spark, args.path).collect():  # one row per file named
            if r["error"]:
                raise SystemExit(f"{r['source_file']}: {r['error']}")
            print(f"{r['name']}: {r['length']} bp, {'circular' if r['circular'] else 'linear'}")
            for role, f in sorted(genbank.roles([x.asDict() for x in r["features"]]).items()):
                print(f"  {role:16} {f['start']}..{f['end']}  {f['name'] or ''}")
        return
    library = load(spark, args.library, Library)
    project = load(spark, args.project, Project) if args.project else Project.ad_hoc(library, args.heavy_vector, args.overhang_set)
    overrides = project.overrides_frame(spark) if project.overrides else None
    if project.overhang_set not in library.overhang_sets:
        raise SystemExit(f"overhang set '{project.overhang_set}' not found")
    truth = _panel(spark, args.ground_truth)
    order = tables.read_id_sequence(spark, args.order) if args.order else None
    if args.command == "order-qc":
        verdicts = order_qc.run(order, library, project, truth, overrides, not args.no_overhangs).persist()
        verdicts.select("record_id", "ab_id", "chain_class", "kind", "reason").show(100, truncate=60)
        rolled = rollup.rollup_order(verdicts).agg(F.count_if("passed").alias("p"), F.count("*").alias("n")).first()
        print(f"Antibodies: {rolled['p']} of {rolled['n']} pass all chains")
        _write(verdicts, rollup.ORDER_COLUMNS, args, order=verdicts)
    else:
        cores = order_qc.order_cores(order, library, project, not args.no_overhangs) if order is not None else None
        mode = "partial_sanger" if args.partial_sanger else "full"
        verdicts = sequencing_qc.run(reads.read(spark, args.reads), library, project, cores, truth, mode, overrides).persist()
        verdicts.select("record_id", "ab_id", "chain_class", "kind", "backbone_vector", "reason").show(100, truncate=60)
        _write(verdicts, rollup.READ_COLUMNS, args, reads=verdicts)


if __name__ == "__main__":
    main()
