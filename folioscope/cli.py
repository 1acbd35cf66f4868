"""Command line: python -m folioscope.cli COMMAND ...  Exit status 0, or 2 for findings and failures."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ledger, linking, report, retrieval
from folioscope.plans import extract
from folioscope.sources import documents, files, sinks


def _write(parts: dict, out: str) -> None:
    for name, df in parts.items():
        sinks.write_json(df, f"{out.rstrip('/')}/{name}")


def read_manuscript(spark, a) -> int:
    parts = extract.manuscripts(files.scan(spark, a.input, ("docx",), content=True))
    _write(parts, a.output)
    return 2 if parts["issues"].limit(1).count() else 0


def read_sources(spark, a) -> int:
    found = files.scan(spark, a.input, ("pdf",), recursive=False, content=True)
    if a.pages and found.limit(2).count() != 1:
        raise ValueError("--pages requires a single PDF")
    if a.ocr != "none" and a.recognise is None:
        raise ValueError(f"no OCR plug-in for {a.ocr}")
    parts = extract.sources(found, a.extract, a.pages, a.alternate or documents.plain_text, a.recognise, a.cache_dir, a.ocr, a.ocr_language)
    _write(parts, a.output)
    weak = parts["pages"].where("NOT quality_ok").limit(1).count()
    return 2 if weak or parts["issues"].limit(1).count() else 0


def search(spark, a) -> int:
    asked = spark.createDataFrame([(1, q) for q in a.query], "query_id int, query string")
    segments = spark.read.json(a.segments)
    hits = retrieval.search(segments, asked, a.limit).join(segments, ["source_id", "pdf_page", "segment_id"])
    _write({"hits": hits.orderBy("rank")}, a.output)
    return 0


def discover(spark, a) -> int:
    part = lambda name: spark.read.json(f"{a.manuscript.rstrip('/')}/{name}")
    library = files.scan(spark, a.references).select("relative_path", "title", "format")
    notes = part("notes")
    found = linking.discover(part("citations"), part("blocks"), notes if "note_id" in notes.columns else None, library)
    _write(found, a.output)
    return 0


def _verdict(spark, a) -> tuple:
    ledgers, found, checked = extract.checked_ledgers(spark, a.ledger, a.source_root, a.image_root, a.manuscript, a.manuscript_root)
    found = found.persist()
    counts = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    said = {"valid": not counts.get("error"), "ready_for_report": not counts.get("error") and not counts.get("blocker"), **{k + "s": counts.get(k, 0) for k in ("error", "blocker", "warning")}, "files_checked": checked.agg(F.sum("files_checked")).first()[0] or 0}
    return ledgers, found, said


def validate(spark, a) -> int:
    ledgers, found, said = _verdict(spark, a)
    print(json.dumps(said))
    if a.output:
        _write({"findings": found, "counts_by_role": ledger.counts_by_role(ledgers)}, a.output)
    return 0 if said["ready_for_report"] else 2


def _checked(spark, a, said: dict, found) -> None:
    print(json.dumps(said))
    if a.qa_output:
        rows = [r.asDict() for r in found.collect()]  # of one report
        with open(a.qa_output, "w", encoding="utf-8") as out:
            json.dump({**said, "findings": rows}, out, ensure_ascii=False, indent=2)


def _docx(path: str, raw: bytes) -> int:
    with open(path, "wb") as out:
        out.write(raw)
    return 0


def export_payload(spark, a) -> int:
    """A report from data without a schema version."""
    if not (a.corpus and a.manuscript and a.source_root):
        raise ValueError("data without a schema version needs --corpus, --manuscript and --source-root")
    data, found = extract.checked_payload(spark, a.ledger, a.corpus, a.manuscript, a.source_root, a.image_root)
    found = found.persist()
    errors = found.count()
    _checked(spark, a, {"errors": errors, "ready_for_report": not errors}, found)
    if errors:
        return 2
    head = data.select("title", "manuscript.title").toDF("title", "manuscript").first()
    labels = report.source_labels(data.select("report_id", F.posexplode("claims").alias("claim_pos", "c")).select("report_id", "claim_pos", F.col("c.source_ids").alias("source_ids")), "report_id")
    return _docx(a.output, sinks.report_docx(head.title or a.title, head.manuscript or a.ledger, [r.asDict() for r in extract.payload_rows(data).collect()], [r.asDict() for r in labels.collect()]))


def export_report(spark, a) -> int:
    version = documents.read_json(spark, a.ledger).select(F.get_json_object("json", "$.claims").alias("c"), F.get_json_object("json", "$.schema_version").alias("v")).first()
    if version and version.c and version.v is None:
        return export_payload(spark, a)
    ledgers, found, said = _verdict(spark, a)
    _checked(spark, a, said, found)
    if not said["ready_for_report"]:
        return 2
    rows = report.report_rows(ledgers)
    claims = ledgers.select("ledger_id", F.posexplode("claims").alias("claim_pos", "c")).select("ledger_id", "claim_pos", F.col("c.attributed_source_ids").alias("source_ids"))
    # one report, by the driver
    return _docx(a.output, sinks.report_docx(a.title, a.ledger, [r.asDict() for r in rows.collect()], [r.asDict() for r in report.source_labels(claims).collect()]))


def main(args: list[str] | None = None, extract=None, alternate=None, recognise=None) -> int:
    """Run a command; extract, alternate and recognise are plug-ins of read-sources (see plans.extract.sources)."""
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(fn, name: str, *plain: str, **options) -> None:
        p = sub.add_parser(name)
        for x in plain:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **v)
        p.set_defaults(run=fn)

    must, may = {"required": True}, {"default": None}
    command(read_manuscript, "read-manuscript", "input", output=must)
    command(read_sources, "read-sources", "input", output=must, pages={"type": lambda s: [int(x) for x in s.split(",")], "default": None}, cache_dir=may, ocr={"default": "none"}, ocr_language={"default": "zh-Hans-CN"})
    command(search, "search", "segments", query={"nargs": "+", "required": True}, limit={"type": int, "default": retrieval.TOP}, output=must)
    command(discover, "discover", "manuscript", references=must, output=must)
    command(validate, "validate", "ledger", source_root=may, image_root=may, manuscript=may, manuscript_root=may, output=may)
    command(export_report, "export-report", "ledger", source_root=may, image_root=may, manuscript=may, manuscript_root=may, corpus=may, qa_output=may, output=must, title={"default": "引用表述来源核准报告"})
    a = top.parse_args(args, argparse.Namespace(extract=extract, alternate=alternate, recognise=recognise))
    try:
        return a.run(SparkSession.builder.getOrCreate(), a)
    except ValueError as error:
        print(json.dumps({"valid": False, "errors": [str(error)]}))
        return 2


if __name__ == "__main__":
    sys.exit(main())
