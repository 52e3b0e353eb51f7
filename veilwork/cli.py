"""python -m veilwork.cli redact|verify|scan: folders of DOCX files; scan and verify read PDF files too. Exit 0: done; 1: something failed or leaks; 2: usage."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.engine import Engine
from veilwork.operators import audit
from veilwork.plans import plan as plans
from veilwork.sources import files, sinks


def usage_error(source: str, output: str | None) -> str | None:
    if not os.path.isdir(source):
        return f"{source} is no folder"
    if output is not None:
        a, b = os.path.realpath(source), os.path.realpath(output)
        if a == b:
            return "input and output are the same folder"
        if os.path.commonpath([a, b]) == a:
            return "the output lies in the input"
    return None


def _plan(spark: SparkSession, path: str | None):
    if path is None:
        return spark.createDataFrame([], plans.PLAN)
    with open(path, encoding="utf-8") as f:
        return plans.parse_plans(spark.createDataFrame([(f.read(),)], "raw string"))


def _print_all(rows: DataFrame) -> None:
    """Every row as a JSON line; the driver holds one partition at a time."""
    for r in rows.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilwork")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("redact", "verify", "scan"):
        p = verbs.add_parser(verb)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("--plan")
        if verb != "scan":
            p.add_argument("-o", "--output", required=True)
        if verb == "redact":
            p.add_argument("--fail-on-unmapped", action="store_true")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("-q", "--quiet", action="store_true")
        elif verb == "verify":
            p.add_argument("--json")
        else:
            p.add_argument("--all", action="store_true")
    try:
        a = parser.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if problem := usage_error(a.input, getattr(a, "output", None)):
        print(problem, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    engine, plan = Engine(spark), _plan(spark, a.plan)
    if a.verb == "verify":
        outputs = files.documents_in(spark, a.output)
        found = engine.verify(outputs, plan)
        if a.json:
            sinks.write_audit(found, a.json)
        leaks = 0
        for r in audit.top_findings(found).orderBy("doc_id", "nth").toLocalIterator():
            print(f"{r.doc_id}: {r.kind}: {r.value}")
            leaks += 1
        for r in engine.lost(files.documents_in(spark, a.input), outputs, plan).select("output_name", "shown").orderBy("output_name", "shown").toLocalIterator():
            print(f"{r.output_name}: lost: {r.shown}")
        for r in engine.notes(outputs).orderBy("doc_id", "note").toLocalIterator():
            print(f"{r.doc_id}: note: {r.note}")
        return int(leaks > 0)
    sources = files.documents_in(spark, a.input)
    if a.verb == "scan":
        asked = sources if a.all else plans.unmapped(sources, plan)
        _print_all(engine.scan(asked, engine.reading(asked)).orderBy("filename"))
        return 0
    missing = plans.unmapped(sources, plan).select("filename").orderBy("filename")
    if a.dry_run:
        _print_all(plans.with_plan(sources.select("filename"), plan).orderBy("filename"))
        return 0
    sinks.write_files(engine.redact_docx(sources, plan), a.output)
    totals = engine.manifest(sources, engine.redact(engine.paragraphs(sources), plan), plan).agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("unmapped").alias("unmapped"), F.sum("redactions").alias("redactions")).first()
    if not a.quiet:
        print(json.dumps(totals.asDict()))
        _print_all(missing)
    return int(bool(totals.failed) or a.fail_on_unmapped and bool(totals.unmapped))


if __name__ == "__main__":
    sys.exit(main())
