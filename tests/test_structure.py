import io
import zipfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import layout, linking, manuscript, retrieval, segments
from folioscope.sources import documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def sample() -> bytes:
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    style = '<w:pPr><w:pStyle w:val="H"/></w:pPr>'
    body = p("Part one", style) + '<w:p><w:r><w:t>Claim (Roe, 2011)</w:t><w:footnoteReference w:id="2"/><w:t> end</w:t></w:r></w:p>' + "<w:p/>" + "<w:p><w:del><w:r><w:t>gone [9]</w:t></w:r></w:del><w:ins><w:r><w:t>new [7]</w:t></w:r></w:ins></w:p>"
    body += f"<w:tbl><w:tr><w:tc>{p('cell [8]')}</w:tc></w:tr></w:tbl>" + p("References") + p("Roe, 2011, On claims [1]")
    note = lambda i, t, x="": f'<w:footnote w:id="{i}"{x}>{p(t)}</w:footnote>'
    return package(
        document=f"<w:document {W}><w:body>{body}</w:body></w:document>",
        styles=f'<w:styles {W}><w:style w:styleId="H"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="K"><w:name w:val="heading 3"/></w:style></w:styles>',
        footnotes=f"<w:footnotes {W}>{note(-1, 'sep')}{note(2, '参见Roe：《On claims》, 2011')}</w:footnotes>",
    )


def test_docx_to_groups(spark):
    files = spark.createDataFrame([("a.docx", bytearray(sample())), ("b.docx", bytearray(b"no zip"))], "relative_path string, content binary")
    rows = documents.read_docx(files).cache()
    assert [r.doc_id for r in rows.where("issue IS NOT NULL").collect()] == ["b.docx"]
    good = rows.where("issue IS NULL")
    main = good.where("kind IN ('paragraph', 'table_cell')")
    blocks = manuscript.structure(main).cache()
    by = {r.block_id: r for r in blocks.collect()}
    assert set(by) == {"P000001", "P000002", "P000004", "T1.R1.C1.P1", "P000005", "P000006"}
    assert by["P000002"].section == "Part one" and by["P000002"].note_refs[0].offset == len("Claim (Roe, 2011)")
    assert by["P000004"].text == "new [7]" and by["P000006"].region == "bibliography" and by["T1.R1.C1.P1"].region == "table_cell"
    notes = good.where("kind = 'footnote'").select("doc_id", F.col("kind").alias("note_kind"), "note_id", "note_type", F.col("paragraph_index").alias("par"), "block_id", "text")
    linked = manuscript.link_notes(notes, blocks).collect()
    assert [(r.note_id, r.section) for r in linked] == [("2", "Part one")]
    cites = manuscript.citations(blocks).cache()
    assert sorted(r.marker for r in cites.collect()) == ["(Roe, 2011)", "2", "[7]", "[8]"]
    lib = spark.createDataFrame([("lib/On claims.pdf", "On claims"), ("lib/x.pdf", "Other")], "relative_path string, title string")
    found = linking.discover(cites, blocks, notes.where("note_id >= 0"), lib)
    titles = {(r.kind, r.title) for r in found["references"].collect()}
    assert titles == {("author_year", "On claims [1]"), ("footnote_reference", "On claims")}
    assert {r.relative_path for r in found["matches"].collect()} == {"lib/On claims.pdf"}
    assert documents.docx_diagnostics(sample()) == {"revisions": 2, "nested_tables": 0, "drawings": 0}


def restate_sections(levels):
    held, out = {}, []
    for i, level in enumerate(levels):
        if level:
            held = {k: v for k, v in held.items() if k < level} | {level: f"h{i}"}
        out.append(" / ".join(held[k] for k in sorted(held)) or manuscript.NO_SECTION)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([None, None, 0, 1, 2, 3, 10]), max_size=14))
def test_heading_stack(spark, levels):
    rows = [(1, i, x, f"h{i}") for i, x in enumerate(levels)]
    got = manuscript.heading_sections(spark.createDataFrame(rows, "doc_id int, pos int, level int, text string")).orderBy("pos").collect()
    assert [r.section for r in got] == restate_sections(levels)


def test_state_runs_over_pages(spark):
    pages = spark.createDataFrame([("s", 1, "摘要：甲\n乙\n关键词：丙\n丁"), ("s", 2, "戊\n1. Start\nbody text\n参考文献"), ("s", 3, "entry")], "source_id string, pdf_page int, text string")
    got = segments.segment_pages(pages).orderBy("pdf_page", "seg_pos").collect()
    assert [(r.segment_id, r.region, r.text) for r in got] == [
        ("p1.s1", "abstract", "摘要：甲\n乙"), ("p1.s2", "other", "关键词：丙"), ("p1.s3", "unknown", "丁"), ("p2.s1", "unknown", "戊"), ("p2.s2", "body", "1. Start\nbody text"), ("p2.s3", "bibliography", "参考文献"), ("p3.s1", "bibliography", "entry"),
    ]


SEG = "source_id string, pdf_page int, seg_pos int, segment_id string, section string, region string, review_status string, text string"


def seg(page, n, text, section="a", region="body", review="verified"):
    return ("s", page, n, f"p{page}.s{n}", section, region, review, text)


def quotes(spark, rows, quote, strict=False):
    found = retrieval.locate_quotes(spark.createDataFrame(rows, SEG), spark.createDataFrame([(1, quote)], "quote_id int, quote string"), strict)
    return [[(x.segment_id, x.start, x.end) for x in r.spans] for r in found.orderBy("at").collect()]


def test_quotes_cross_pages_but_no_gaps(spark):
    rows = [seg(1, 1, "one two "), seg(2, 1, " three four")]
    assert quotes(spark, rows, "two three") == [[("p1.s1", 4, 8), ("p2.s1", 0, 6)]]
    assert quotes(spark, [seg(1, 1, "one two"), seg(1, 2, "x", region="other"), seg(1, 3, "three")], "two three") == []
    assert quotes(spark, [seg(1, 1, "one two"), seg(3, 1, "three")], "two three") == []
    assert quotes(spark, [seg(1, 1, "one two"), seg(1, 2, "three", section="b")], "two three") == []
    assert quotes(spark, [seg(1, 1, "one two", review="unverified"), seg(1, 2, "three")], "two three", True) == []
    assert quotes(spark, [seg(1, 1, "aaaa")], "aa") == [[("p1.s1", 0, 2)], [("p1.s1", 1, 3)], [("p1.s1", 2, 4)]]
    assert quotes(spark, rows, " \n ") == []
    assert quotes(spark, [seg(1, 1, "税率不变。")], "税率，不变") == []


def test_search_ties_and_caps(spark):
    rows = [seg(1, 2, "tax tax tax tax tax"), seg(1, 10, "tax tax tax"), seg(2, 1, "tax law"), seg(3, 1, "none"), seg(4, 1, "tax", region="other")]
    asked = spark.createDataFrame([(1, "tax"), (1, "Tax law")], "query_id int, query string")
    got = retrieval.search(spark.createDataFrame(rows, SEG), asked).orderBy("rank").collect()
    # weights: tax 2, law 1; equal scores go by segment id as text
    assert [(r.segment_id, r.score) for r in got] == [("p1.s10", 6.0), ("p1.s2", 6.0), ("p2.s1", round(3 / 2**0.3, 4))]


def test_two_columns_and_notes(spark):
    cells = []
    for line in range(20):
        for col, x0 in enumerate((30, 320)):
            cells += [("s", 1, len(cells) + i, c, 300.0 + line * 14, x0 + 9.0 * i, x0 + 9.0 * i + 8, 10.0) for i, c in enumerate(f"{'LR'[col]}{line:02d}abcdefgh")]
    cells += [("s", 1, 9000 + i, c, 740.0, 30.0 + 9 * i, 38.0 + 9 * i, 7.0) for i, c in enumerate("a small note at the foot")]
    cells += [("s", 1, 9900, "7", 780.0, 300.0, 308.0, 10.0), ("s", 1, 9901, "H", 20.0, 300.0, 308.0, 10.0)]
    glyphs = spark.createDataFrame(cells, "source_id string, pdf_page int, glyph_pos int, ch string, top double, x0 double, x1 double, size double")
    dims = spark.createDataFrame([("s", 1, 600.0, 800.0)], "source_id string, pdf_page int, width double, height double")
    found = layout.gutters(glyphs, dims).first()
    assert found.layout == "two_column_candidate" and 120 < found.gutter < 320
    roles = {r.line: (r.role, r.print_page) for r in layout.page_flow(glyphs, dims).collect()}
    assert roles["7"] == ("number", "7") and roles["H"][0] == "head" and roles["asmallnoteatthefoot"][0] == "note"
    text = layout.layout_text(glyphs, dims).first().text.split("\n")
    assert text.index("L19abcdefgh") < text.index("R00abcdefgh")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab\U0001f600", max_size=9), min_size=1, max_size=6), st.lists(st.text("ab\U0001f600", max_size=4), max_size=5))
def test_containing(spark, texts, needles):
    from folioscope.operators import containment

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = containment.containing(rows, ["k"], "text", spark.createDataFrame([(n,) for n in needles], "n string"), "n", gram=2)
    assert sorted(map(tuple, found.collect())) == sorted((i, n) for i, t in enumerate(texts) for n in set(needles) if n and n in t)


def test_places_of_odd_quotes(spark):
    """Letters of regular expressions in a quotation, beyond the basic plane, and spaces around its places."""
    rows = [seg(1, 1, " a \\E(b) \U0001f600 a\\E(b)")]
    assert quotes(spark, rows, "\\E(b)") == [[("p1.s1", 3, 8)], [("p1.s1", 12, 17)]]
    assert quotes(spark, rows, "\U0001f600a") == [[("p1.s1", 9, 12)]]


def test_search_of_few_queries_shuffles_only_its_best(spark):
    rows = [("s", 1, i, f"p1.s{i}", "a", "body", "verified", t) for i, t in enumerate(["alpha beta beta beta beta", "beta gamma", "delta", "alpha alpha omega beta"], 1)]
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma none")], "query_id int, query string")
    found = retrieval.search(spark.createDataFrame(rows, SEG), asked)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    eligible = spark.createDataFrame(rows, SEG).select("source_id", "pdf_page", "segment_id", F.split("text", " ").alias("__all"))
    keys = ["source_id", "pdf_page", "segment_id"]
    by_term = retrieval._scored_by_term(eligible, keys, retrieval.query_terms(asked))
    weights = [tuple(r) for r in retrieval.query_terms(asked).collect()]
    in_rows = retrieval._scored_in_rows(eligible, keys, weights, asked.schema["query_id"].dataType)
    assert sorted(map(tuple, in_rows.select(*by_term.columns).collect())) == sorted(map(tuple, by_term.collect()))
    assert [(r.query_id, r.rank, r.segment_id) for r in found.orderBy("query_id", "rank").collect()][-1] == (2, 1, "p1.s2")


def test_groups_need_no_files(spark):
    blocks = spark.createDataFrame([("d", 1, "P1", "body", "sec", "Claim (Roe, 2011)")], "doc_id string, pos int, block_id string, region string, section string, text string")
    found = linking.discover(manuscript.citations(blocks), blocks, None, None)
    assert [(r.group_id, r.refs[0].authors) for r in found["groups"].collect()] == [("G001", "Roe")]
    assert list(found) == ["groups", "references", "occurrences", "bibliography", "matches", "unmatched"]


def test_few_strings_are_held_whole(spark):
    from folioscope.operators.containment import containing, few, held

    texts = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "")], "id int, text string")
    needles = spark.createDataFrame([("two",), ("two",), ("one two",), ("x",), ("",), (None,)], "needle string")
    strings = few(needles, "needle")
    assert sorted(strings) == ["one two", "two", "x"]
    got = texts.select("id", F.explode(held("text", strings)).alias("needle"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, containing(texts, ["id"], "text", needles, "needle").collect())) == [(1, "one two"), (1, "two"), (2, "two")]
    assert few(spark.range(300).selectExpr("cast(id as string) AS needle"), "needle") is None and few(needles.where("false"), "needle") == []
