import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ledger, report, schema_check
from folioscope.plans import catalog, views

SHA = lambda *t: hashlib.sha256("\n".join(t).encode()).hexdigest()


def document() -> dict:
    """A ledger without findings: a quotation over two pages."""
    segs = [("a1", "abstract", "Abstract", "Short."), ("b1", "body", "Main", "Rates rose in May."), ("b2", "body", "Main", "They fell in June.")]
    make = lambda i: dict(zip(("id", "region", "section", "text"), segs[i], strict=True), extraction="text_layer", review_status="verified")
    sha = SHA(*[s[3] for s in segs])
    source = {"id": "S1", "title": "Rates", "kind": "academic_article", "sha256": sha, "coverage": "full", "origin": {"kind": "synthetic", "locator": "s.pdf", "snapshot_path": None}, "dates": {k: None for k in ("issued", "published", "effective", "accessed")}, "pages": [{"pdf_page": 1, "print_page": "3", "segments": [make(0), make(1)]}, {"pdf_page": 2, "print_page": "4", "segments": [make(2)]}]}
    evidence = {"id": "E1", "source_id": "S1", "source_sha256": sha, "quote": "Rates rose in May. They fell in June.", "section": "Main", "pdf_pages": [1, 2], "print_pages": ["3", "4"], "spans": [{"segment_id": "b1", "start": 0, "end": 18}, {"segment_id": "b2", "start": 0, "end": 18}], "completeness_review": "verified", "context_review": "verified"}
    assessment = {"subclaim_id": "x", "evidence_ids": ["E1"], "support": "supported", "reason": "r", "boundaries": {k: True for k in ("object_match", "time_match", "geography_match", "causal_strength_match")}}
    claim = {"id": "C1", "target": {"text": "Rates moved.", "pdf_page": 1, "print_page": None, "section": "Intro"}, "citation_role": "explicit", "attributed_source_ids": ["S1"], "subclaims": [{"id": "x", "text": "moved"}], "status": "direct", "reason": "r", "recommendation": "keep", "evidence": [evidence], "assessments": [assessment], "search": {"status": "complete", "source_ids": ["S1"], "regions": ["body"], "queries": ["rates"], "note": "n"}, "quotation_mode": "paraphrase", "verbatim_text": None, "review_status": "reviewed", "policy_checks": None}
    return {"schema_version": "0.2", "sources": [source], "claims": [claim]}


def changed(change) -> dict:
    made = document()
    change(made, made["claims"][0], made["claims"][0]["evidence"][0], made["sources"][0])
    return made


def table(spark, docs: list[dict]):
    return spark.read.schema(ledger.LEDGER).json(spark.sparkContext.parallelize([json.dumps(d | {"ledger_id": str(i)}) for i, d in enumerate(docs)]))


CASES = {
    "clean": (lambda d, c, e, s: None, set()),
    "white space is free": (lambda d, c, e, s: e.update(quote="Rates  rose\nin May.They fell in June."), set()),
    "punctuation is not": (lambda d, c, e, s: e.update(quote="Rates rose in May; They fell in June."), {"QUOTE_MISMATCH"}),
    "stitched": (lambda d, c, e, s: (e["spans"][0].update(end=5), e.update(quote="Rates They fell in June.")), {"NONCONTIGUOUS_QUOTE"}),
    "page order": (lambda d, c, e, s: s["pages"][1].update(pdf_page=1), {"PAGE_ORDER", "PDF_PAGE_MISMATCH"}),
    "two levels": (lambda d, c, e, s: c.update(status="partial"), {"VERDICT_CONFLICT"}),
    "gone": (lambda d, c, e, s: c.update(status="not_found"), {"NOT_FOUND_UNJUSTIFIED"}),
    "word": (lambda d, c, e, s: e.update(docx_location={"block_id": "P1", "location": {"kind": "paragraph", "paragraph_index": 1}}), {"WORD_SOURCE_PAGE_INFERRED", "WORD_SOURCE_UNVERIFIED"}),
    "orphan": (lambda d, c, e, s: c["assessments"][0].update(evidence_ids=[]), {"ORPHAN_EVIDENCE", "SUPPORT_WITHOUT_EVIDENCE"}),
    "again": (lambda d, c, e, s: c["evidence"].append(dict(e)), {"DUPLICATE_ID"}),
    "printed": (lambda d, c, e, s: e.update(print_pages=["3", None]), {"PRINT_PAGE_MISMATCH"}),
}


def test_mutations(spark):
    docs = table(spark, [changed(f) for f, _ in CASES.values()])
    rows = ledger.findings(ledger.relations(docs)).collect()
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert {r.code for r in rows if r.ledger_id == str(i)} == want, name
    done = {r.ledger_id: (r.valid, r.ready_for_report) for r in ledger.summary(docs, spark.createDataFrame(rows, "ledger_id string, severity string, code string, scope_id string")).collect()}
    assert done["0"] == (True, True) and done["2"] == (False, False)


def test_files_and_manuscripts(spark):
    def local(d, c, e, s):
        s["origin"].update(kind="local")
        c["target"].update(pdf_page=None, docx_location={"manuscript_sha256": "m" * 64, "block_id": "P1", "location": {"kind": "paragraph", "paragraph_index": 1}})

    docs = table(spark, [changed(local), changed(lambda d, c, e, s: (local(d, c, e, s), s["origin"].update(locator="../s.pdf"))), changed(lambda d, c, e, s: (local(d, c, e, s), s["origin"].update(locator="gone.pdf")))])
    files = spark.createDataFrame([("s.pdf", "0" * 64)], "path string, sha256 string")
    paper = spark.createDataFrame([(str(i), "docx", "m" * 64, "paper.docx") for i in range(3)], "ledger_id string, format string, sha256 string, locator string")
    place = "struct<kind:string,paragraph_index:bigint,table_index:bigint,row_index:bigint,cell_index:bigint,note_id:string>"
    blocks = spark.createDataFrame([(str(i), "P1", "Rates  moved." if i else "Else.", "Intro", ("paragraph", 1, None, None, None, None), "verified") for i in range(3)], f"ledger_id string, id string, text string, section string, location {place}, review_status string")
    kept = spark.createDataFrame([("paper.docx", "n" * 64)], "path string, sha256 string")
    rows = ledger.findings(ledger.relations(docs, files, paper, blocks, kept)).collect()
    codes = lambda i: sorted(r.code for r in rows if r.ledger_id == str(i))
    assert codes(0) == ["MANUSCRIPT_DIGEST_MISMATCH", "MANUSCRIPT_TEXT_MISMATCH", "SOURCE_DIGEST_MISMATCH"]
    assert codes(1) == ["MANUSCRIPT_DIGEST_MISMATCH", "SOURCE_PATH_OUTSIDE_ROOT"]
    assert codes(2) == ["MANUSCRIPT_DIGEST_MISMATCH", "SOURCE_FILE_MISSING"]


def test_schema(spark):
    bad = document()
    bad["extra"] = 1
    bad["claims"][0]["evidence"][0]["pdf_pages"] = [1, 1, True, 1.0]
    bad["claims"][0]["id"] = "no spaces"
    del bad["sources"][0]["title"]
    docs = spark.createDataFrame([("ok", json.dumps(document())), ("bad", json.dumps(bad)), ("broken", "{"), ("none", None)], "ledger_id string, json string")
    got = {(r.ledger_id, r.path, r.fault) for r in schema_check.schema_findings(docs).collect()}
    e = "$.claims[0].evidence[0].pdf_pages"
    assert got == {
        ("bad", "$.extra", "unknown field"), ("bad", e, "an item twice"), ("bad", e + "[2]", "wrong type, wanted integer"), ("bad", e + "[3]", "wrong type, wanted integer"), ("bad", "$.claims[0].id", "not of the form wanted"), ("bad", "$.sources[0].title", "missing"), ("broken", "$", "unparseable"), ("none", "$", "unparseable"),
    }


def test_schema_keywords(spark):
    """Each keyword of a schema of its own, null among the types, and nothing below a value of the wrong type."""
    s = schema_check
    node = s.obj({"name": s.text("^[a-z]+$", least=2), "kind": s.one_of("x", "y"), "n": s.whole(1, null=True), "on": s.flag(), "list": s.arr(s.whole(0), 1, True)}, {"sub": s.obj({"t": s.text(None, null=True)}, null=True)})
    good = {"name": "ab", "kind": "x", "n": 1, "on": True, "list": [1, 2]}
    cases = {
        "good": (good, set()), "null": (good | {"n": None, "sub": None}, set()), "sub": (good | {"sub": {"t": None}}, set()), "enum": (good | {"kind": "z"}, {("$.kind", "not one of the values allowed")}),
        "short": (good | {"name": "a"}, {("$.name", "too short")}), "both": (good | {"name": "A"}, {("$.name", "too short"), ("$.name", "not of the form wanted")}), "least": (good | {"n": 0}, {("$.n", "less than the minimum")}),
        "float": (good | {"n": 1.0}, {("$.n", "wrong type, wanted integer or null")}), "bool": (good | {"n": True}, {("$.n", "wrong type, wanted integer or null")}), "flag": (good | {"on": 1}, {("$.on", "wrong type, wanted boolean")}), "few": (good | {"list": []}, {("$.list", "not enough items")}),
        "twice": (good | {"list": [3, 3, -1]}, {("$.list", "an item twice"), ("$.list[2]", "less than the minimum")}), "list": (good | {"list": {"a": 1}}, {("$.list", "wrong type, wanted array")}), "deep": (good | {"sub": {"t": 1, "u": 2}}, {("$.sub.t", "wrong type, wanted string or null"), ("$.sub.u", "unknown field")}),
        "none": ({}, {("$." + k, "missing") for k in good}), "top": ([1], {("$", "wrong type, wanted object")}), "big": (good | {"n": 10**30}, set()),
    }
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "ledger_id string, json string")
    rows = s.schema_findings(docs, schema=node).collect()
    for name, (_, want) in cases.items():
        assert {(r.path, r.fault) for r in rows if r.ledger_id == name} == want, name


def test_report(spark):
    docs = table(spark, [document()])
    row = report.report_rows(docs).first()
    assert (row.heading, row.status, row.pdf_page, row.print_page) == ("Rates moved.", "直接支撑", 1, "3—4")
    claims = docs.select("ledger_id", F.posexplode("claims").alias("claim_pos", "c")).select("ledger_id", "claim_pos", F.col("c.attributed_source_ids").alias("source_ids"))
    labels = report.source_labels(claims).collect()
    assert [(x.source_id, x.label) for x in labels] == [("S1", "R01")]
    from folioscope.sources.sinks import report_docx

    raw = report_docx("T", "M", [r.asDict() for r in report.report_rows(docs).collect()], [x.asDict() for x in labels])
    from folioscope.sources.documents import docx_paragraphs

    assert any("They fell in June." in p["text"] for p in docx_paragraphs("r", raw))


def test_payload(spark):
    place = "struct<kind:string,paragraph_index:bigint>"
    claims = spark.createDataFrame([("r", 0, "C", "B", "text", "直接支撑", "x", "y", True), ("r", 1, "C", "B", "other", "maybe", "", "y", None), ("r", 2, "D", "B", "text", "未找到", "x", "y", None)], "report_id string, claim_pos int, claim_id string, block_id string, target_text string, status string, reason string, recommendation string, search_complete boolean")
    evidence = spark.createDataFrame([("r", 0, "C", 0, "S", "effi- cient", "body", "执行者复核", None, None, [("g", 0, 11)], None), ("r", 0, "C", 1, "Z", "q", "body", "执行者复核", None, None, [], None), ("r", 0, "C", 2, "S", "efficient", "other", "执行者复核", None, None, [("g", 0, 99)], None), ("r", 0, "C", 3, "S", "q", "body", "执行者复核", None, None, [], None)], f"report_id string, claim_pos int, claim_id string, e_pos int, source_id string, quote string, region string, context_review string, block_id string, location {place}, spans array<struct<segment_id:string,start:int,end:int>>, verification_image string")
    sources = spark.createDataFrame([("r", "S")], "report_id string, source_id string")
    blocks = spark.createDataFrame([("B", "a text")], "block_id string, text string")
    segs = spark.createDataFrame([("S", "g", "effi-\ncient rest")], "source_id string, segment_id string, text string")
    got = sorted(r.code for r in report.payload_findings(claims, evidence, sources, blocks, segs).collect())
    assert got == sorted(["duplicate claim", "target mismatch", "invalid verdict", "missing review", "unfinished negative search", "unknown evidence source", "unreviewed body or context", "evidence span unavailable", "evidence span mismatch", "unbound quotation"])


@pytest.mark.parametrize("code", [c for c in views.MUTATIONS if c][::9])
def test_rules_have_queries(code):
    assert "rule_" + code.lower() in catalog.QUERIES
    assert len(ledger.RULES) == 59


def test_every_rule_fires(spark, tmp_path):
    """Ledgers of all changes, with roots: the findings expected; every rule is among these or those without roots."""
    rows = [(i, f"Line {i} of some length.\nMore of it.", "en", "s", 9) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    r = ledger.relations(views.ledgers(spark, str(tmp_path)), **views.roots(spark, str(tmp_path)), persist=True)
    got = sorted(map(tuple, ledger.findings(r).collect()))
    with_roots, without = (views.expected(catalog.SCOPES, x) for x in (True, False))
    assert got == sorted((str(k), s, c, x) for k, s, c, x in with_roots)
    ledger.release(r)
    assert {c for _, _, c, _ in with_roots + without} == set(ledger.RULES)


def test_last_sources_and_numbers_of_segments_without_a_window(spark):
    seg = lambda i: {"id": i, "region": "body", "text": i}
    page = lambda *ids: {"pdf_page": 1, "segments": [seg(i) for i in ids]}
    sources = [{"id": "S", "pages": [page("old")]}, {"id": None, "pages": [page("x")]}, {"id": "S", "pages": [page("a", "b"), {"pdf_page": 2}, page("c")]}, {"id": "T", "pages": None}]
    r = ledger.relations(spark.createDataFrame([{"ledger_id": "1", "sources": sources, "claims": []}], ledger.LEDGER))
    assert sorted(r.sources.select("s_pos").collect()) == [(1,), (2,), (3,)] and r.all_sources.count() == 4
    got = r.all_segments.where("source_id = 'S'").orderBy("at").select("at", "p_pos", "g_pos", "segment_id").collect()
    assert list(map(tuple, got)) == [(1, 0, 0, "a"), (2, 0, 1, "b"), (3, 2, 0, "c")]
    assert "Window" not in r.all_segments._jdf.queryExecution().executedPlan().toString()
