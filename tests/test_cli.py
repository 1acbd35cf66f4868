import json

from folioscope import cli
from folioscope.plans import extract
from tests.test_ledger import document
from tests.test_structure import sample


def rows(path):
    return [json.loads(x) for f in path.glob("*.json") for x in f.read_text().splitlines()]


def test_manuscript_to_groups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "lib").mkdir()
    (tmp_path / "in/a.docx").write_bytes(sample())
    (tmp_path / "lib/On claims.pdf").write_bytes(b"x")
    assert cli.main(["read-manuscript", str(tmp_path / "in"), "--output", str(tmp_path / "m")]) == 0
    assert {r["block_id"] for r in rows(tmp_path / "m/blocks")} >= {"P000001", "P000006"}
    assert cli.main(["discover", str(tmp_path / "m"), "--references", str(tmp_path / "lib"), "--output", str(tmp_path / "d")]) == 0
    assert {r["relative_path"] for r in rows(tmp_path / "d/matches")} == {"On claims.pdf"}
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    assert cli.main(["read-manuscript", str(tmp_path / "in"), "--output", str(tmp_path / "m2")]) == 2


def test_validate_and_export(spark, tmp_path):
    good, bad = document(), document()
    bad["claims"][0]["evidence"][0]["quote"] = "Rates fell."
    (tmp_path / "l").mkdir()
    (tmp_path / "l/good.json").write_text(json.dumps(good))
    (tmp_path / "l/bad.json").write_text(json.dumps(bad))
    (tmp_path / "l/odd.json").write_text("{")
    assert cli.main(["validate", str(tmp_path / "l"), "--output", str(tmp_path / "out")]) == 2
    assert {(r["ledger_id"].rsplit("/", 1)[1], r["code"]) for r in rows(tmp_path / "out/findings")} == {("bad.json", "QUOTE_MISMATCH"), ("odd.json", "SCHEMA")}
    assert cli.main(["export-report", str(tmp_path / "l/good.json"), "--output", str(tmp_path / "r.docx")]) == 0 and (tmp_path / "r.docx").stat().st_size > 500


def test_glyphs_to_segments_and_search(spark, tmp_path):
    def extract_glyphs(content):
        for page, body in enumerate(content.decode().split("\f"), 1):
            for n, line in enumerate(body.split("\n")):
                yield from ((page, 1000 * n + i, c, 100.0 + 15 * n, 30.0 + 6 * i, 35.0 + 6 * i, 10.0, 600.0, 800.0) for i, c in enumerate(line))

    found = spark.createDataFrame([("a.pdf", bytearray(b"1.Start\nTaxes-rose-in-spring-of-that-year-and-then-fell-again\fThey-stayed-low-for-the-next-ten-years-of-peace")), ("b.pdf", bytearray(b"\xff"))], "relative_path string, content binary")
    got = extract.sources(found, extract_glyphs)
    assert [(r.segment_id, r.region) for r in got["segments"].orderBy("pdf_page", "seg_pos").collect()] == [("p1.s1", "body"), ("p2.s1", "body")]
    assert got["coverage"].first().coverage == "full" and got["issues"].count() == 1
    got["segments"].write.json(str(tmp_path / "segs"))
    assert cli.main(["search", str(tmp_path / "segs"), "--query", "taxes", "rose", "--output", str(tmp_path / "hits")]) == 0
    assert [r["segment_id"] for r in rows(tmp_path / "hits/hits")] == ["p1.s1"]


def test_validate_against_manuscript_and_roots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(sample())
    assert cli.main(["read-manuscript", str(tmp_path / "in"), "--output", str(tmp_path / "m")]) == 0
    head, block = rows(tmp_path / "m/manuscript")[0], next(r for r in rows(tmp_path / "m/blocks") if r["kind"] == "paragraph" and r["region"] == "body")
    assert rows(tmp_path / "m/diagnostics")[0].keys() >= {"revisions", "nested_tables", "drawings"}
    made = document()
    place = {"kind": "paragraph", "paragraph_index": block["paragraph_index"]}
    made["claims"][0]["target"].update(text=block["text"], pdf_page=None, section=block["section"], docx_location={"manuscript_sha256": head["sha256"], "block_id": block["block_id"], "location": place})

    def codes(name, *more):
        status = cli.main(["validate", str(tmp_path / name), "--output", str(tmp_path / "out"), *more])
        return status, {r["code"] for r in rows(tmp_path / "out/findings")}

    paper = ["--manuscript", str(tmp_path / "m"), "--manuscript-root", str(tmp_path / "in")]
    made["claims"][0]["target"].update(text="nowhere to be found", section="Elsewhere")
    (tmp_path / "l2.json").write_text(json.dumps(made))
    assert codes("l2.json", *paper) == (2, {"MANUSCRIPT_BLOCK_REVIEW_PENDING", "MANUSCRIPT_TEXT_MISMATCH", "MANUSCRIPT_LOCATION_MISMATCH"})


def test_payload_report(spark, tmp_path):
    import hashlib

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.docx").write_bytes(sample())
    (tmp_path / "src/s.pdf").write_bytes(b"source")
    assert cli.main(["read-manuscript", str(tmp_path / "src"), "--output", str(tmp_path / "m")]) == 0
    head, block = rows(tmp_path / "m/manuscript")[0], rows(tmp_path / "m/blocks")[0]
    evidence = {"source_id": "S", "quote": "efficient", "section": "x", "pdf_page": 1, "region": "body", "context_review": "执行者复核", "spans": [{"segment_id": "g", "start": 0, "end": 11}]}
    claim = {"id": "C", "block_id": block["block_id"], "section": "x", "target_text": block["text"], "status": "直接支撑", "reason": "r", "recommendation": "r", "source_ids": ["S"], "evidence": [evidence]}
    data = {"title": "T", "manuscript": {"title": "M", "locator": "a.docx", "sha256": head["sha256"]}, "sources": [{"id": "S", "title": "S", "sha256": hashlib.sha256(b"source").hexdigest(), "origin": {"locator": "s.pdf"}}], "claims": [claim]}
    (tmp_path / "corpus.json").write_text(json.dumps({"sources": [{"id": "S", "pages": [{"pdf_page": 1, "segments": [{"id": "g", "text": "effi-\ncient rest"}]}]}]}))

    def run(name, changed):
        (tmp_path / name).write_text(json.dumps(changed))
        status = cli.main(["export-report", str(tmp_path / name), "--corpus", str(tmp_path / "corpus.json"), "--manuscript", str(tmp_path / "m"), "--source-root", str(tmp_path / "src"), "--qa-output", str(tmp_path / "qa.json"), "--output", str(tmp_path / (name + ".docx"))])
        return status, sorted(f["code"] for f in json.loads((tmp_path / "qa.json").read_text())["findings"])

    assert run("p.json", data) == (0, []) and (tmp_path / "p.json.docx").stat().st_size > 500
    bad = data | {"manuscript": data["manuscript"] | {"sha256": "0" * 64}, "sources": [data["sources"][0] | {"origin": {"locator": "../s.pdf"}}]}
    assert run("q.json", bad) == (2, ["manuscript changed", "manuscript digest mismatch", "source unavailable or unsafe path"])


def test_sources_fallback_ocr_and_cache(spark, tmp_path):
    from folioscope.sources import files

    def glyphs(content):
        for page, body in enumerate(content.decode().split("\f"), 1):
            yield from ((page, i, c, 100.0, 30.0 + 6 * i, 35.0 + 6 * i, 10.0, 600.0, 800.0) for i, c in enumerate(body))

    good = "Taxes-rose-in-spring-of-that-year-and-then-fell-again"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(f"(cid:7){good}\fshort\f{good}".encode())
    plug = {"extract": glyphs, "alternate": lambda raw: ((n, good + " alt") for n in (1, 2, 3)), "recognise": lambda raw: [(2, good + " scan")]}
    scan = lambda: files.scan(spark, str(tmp_path / "in"), ("pdf",), content=True)
    got = {r.pdf_page: (r.text[-4:], r.extraction, r.alternate_text_layer_used, r.cache_hit) for r in extract.sources(scan(), glyphs, None, plug["alternate"], plug["recognise"], str(tmp_path / "cache"))["pages"].collect()}
    assert got == {1: (" alt", "text_layer", True, False), 2: ("scan", "ocr", False, False), 3: ("gain", "text_layer", False, False)}
    (tmp_path / "in/a.pdf").rename(tmp_path / "in/b.pdf")
    again = extract.sources(scan(), lambda raw: 1 / 0, None, plug["alternate"], plug["recognise"], str(tmp_path / "cache"))
    assert {(r.source_id, r.cache_hit) for r in again["pages"].collect()} == {("b.pdf", True)} and again["issues"].count() == 0
    assert {(r.pdf_page, r.extraction) for r in again["segments"].collect()} == {(1, "text_layer"), (2, "ocr"), (3, "text_layer")}
    read = lambda *more: cli.main(["read-sources", str(tmp_path / "in"), "--output", str(tmp_path / "o"), *more], **plug)
    assert read("--pages", "1,9") == 2 and rows(tmp_path / "o/issues") == [{"source_id": "b.pdf", "issue": "no page 9"}]
    assert cli.main(["read-sources", str(tmp_path / "in"), "--output", str(tmp_path / "o"), "--ocr", "windows"]) == 2
