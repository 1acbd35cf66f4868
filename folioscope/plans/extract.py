"""Whole paths: files to manuscripts, files to segments, JSON ledgers to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import layout, ledger, manuscript, report, schema_check, segments
from folioscope.sources import documents, files


def manuscripts(found: DataFrame) -> dict[str, DataFrame]:
    """manuscript, blocks, citations, notes, dangling, diagnostics and issues of DOCX files (relative_path, sha256, content)."""
    rows = documents.read_docx(found)
    good = rows.where("issue IS NULL")
    blocks = manuscript.structure(good.where("kind IN ('paragraph', 'table_cell')"))
    paragraphs = good.where("kind IN ('footnote', 'endnote')").select("doc_id", F.col("kind").alias("note_kind"), "note_id", "note_type", F.col("paragraph_index").alias("par"), "block_id", "text")
    notes = manuscript.link_notes(paragraphs, blocks)
    head = found.select(F.col("relative_path").alias("doc_id"), F.lit("docx").alias("format"), "sha256", F.col("relative_path").alias("locator"), "title")
    return {"manuscript": head, "diagnostics": documents.read_diagnostics(found), "blocks": blocks, "citations": manuscript.citations(blocks), "notes": notes, "dangling": manuscript.dangling_notes(blocks, notes), "issues": rows.where("issue IS NOT NULL").select("doc_id", "issue")}


def sources(found: DataFrame, extract=None, wanted: list[int] | None = None, alternate=None, recognise=None, cache_dir: str | None = None, ocr: str = "none", language: str = "zh-Hans-CN") -> dict[str, DataFrame]:
    """pages, segments, coverage and issues of PDF files (relative_path, sha256, content).

    extract yields glyphs, alternate another reading of the text layer for pages
    whose own is damaged, recognise OCR's for pages that neither makes readable.
    With cache_dir, contents that were read before with the same options are not
    read again, under whatever names they have now.
    """
    if cache_dir:
        spark, path = found.sparkSession, f"{cache_dir.rstrip('/')}/pages"
        keyed = files.with_cache_key(found, ocr, wanted, language)
        try:
            old = spark.read.parquet(path)
            new = files.new_work(keyed, old)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old, new = None, keyed
        before = [] if old is None else [r[0] for r in old.join(keyed.select("cache_key"), "cache_key", "left_semi").select("cache_key").distinct().collect()]  # files of this run
        pages, issues = _pages(new, extract, wanted, alternate, recognise)
        pages.join(new.select(F.col("relative_path").alias("source_id"), "cache_key"), "source_id").write.mode("append").parquet(path)
        kept = spark.read.parquet(path).drop("source_id").join(keyed.select("cache_key", F.col("relative_path").alias("source_id")), "cache_key")
        pages = kept.withColumn("cache_hit", F.col("cache_key").isin(before)).drop("cache_key")
    else:
        pages, issues = _pages(found, extract, wanted, alternate, recognise)
        pages = pages.withColumn("cache_hit", F.lit(False))
    totals = pages.groupBy("source_id").agg(F.max("total_pages").alias("total_pages"))
    if wanted:
        asked = found.select(F.col("relative_path").alias("source_id"), F.explode(F.array(*map(F.lit, wanted))).alias("pdf_page"))
        outside = segments.invalid_pages(asked.join(totals, "source_id", "left_semi"), pages).select("source_id", F.concat(F.lit("no page "), "pdf_page").alias("issue"))
        issues = issues.unionByName(outside)
    cut = segments.segment_pages(pages).drop("extraction").join(pages.select("source_id", "pdf_page", "extraction"), ["source_id", "pdf_page"])
    return {"pages": pages, "segments": cut, "coverage": segments.coverage(pages.drop("total_pages"), totals), "issues": issues}


def _pages(found: DataFrame, extract, wanted, alternate, recognise) -> tuple[DataFrame, DataFrame]:
    every = documents.read_glyphs(found, extract)
    glyphs = every.where("issue IS NULL").drop("issue")
    dims = glyphs.groupBy("source_id", "pdf_page").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    totals = dims.groupBy("source_id").agg(F.max("pdf_page").alias("total_pages"))
    dims = segments.selected_pages(dims, wanted) if wanted else dims
    glyphs = glyphs.drop("width", "height").join(dims.select("source_id", "pdf_page"), ["source_id", "pdf_page"], "left_semi")
    rows = layout.page_flow(glyphs, dims)
    aside = rows.where("role <> 'main'").select("source_id", "pdf_page", "y")
    main = glyphs.withColumn("y", (F.rint(F.col("top") / layout.ROW) * layout.ROW).cast("int")).join(aside, ["source_id", "pdf_page", "y"], "left_anti").drop("y")
    texts = dims.join(layout.layout_text(main, dims), ["source_id", "pdf_page"], "left").join(layout.flow_text(rows).select("source_id", "pdf_page", "ancillary_text", "print_page"), ["source_id", "pdf_page"], "left")
    texts = texts.join(totals, "source_id").withColumn("text_primary", F.coalesce("text", F.lit(""))).drop("text", "width", "height")
    issues = every.where("issue IS NOT NULL").select("source_id", "issue")
    for plug, name in ((alternate, "text_alt"), (recognise, "text_ocr")):
        if plug is None:
            texts = texts.withColumn(name, F.lit(None).cast("string"))
            continue
        read = documents.read_texts(found, plug)
        texts = texts.join(read.where("issue IS NULL").select("source_id", "pdf_page", F.col("text").alias(name)), ["source_id", "pdf_page"], "left")
        issues = issues.unionByName(read.where("issue IS NOT NULL").select("source_id", "issue"))
    # read once for all that is made of them
    return segments.extraction_fallback(texts).drop("text_primary", "text_alt", "text_ocr").persist(), issues


def _location(df: DataFrame):
    """Column: where a block stands; JSON leaves out fields that are null everywhere."""
    there = lambda c, k: (F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c)
    return F.struct(there("kind", "string"), *[there(c, "bigint") for c in ("paragraph_index", "table_index", "row_index", "cell_index")], there("note_id", "string")).cast(ledger.LOCATION)


def _papers(ledgers: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manuscript of each ledger and its blocks, from the folder that read-manuscript wrote: the only one there is, or the one that its claims' digest names."""
    spark = ledgers.sparkSession
    heads = spark.read.schema("doc_id string, format string, sha256 string, locator string").json(f"{folder.rstrip('/')}/manuscript")
    if len(only := heads.limit(2).collect()) == 1:
        own = ledgers.select("ledger_id", *[F.lit(only[0][c]).alias(c) for c in heads.columns])
    else:
        named = F.filter("claims", lambda c: c["target"]["docx_location"].isNotNull())[0]["target"]["docx_location"]["manuscript_sha256"]
        own = ledgers.select("ledger_id", named.alias("sha256")).join(heads, "sha256")
    blocks = spark.read.json(f"{folder.rstrip('/')}/blocks")
    review = F.col("review_status") if "review_status" in blocks.columns else F.lit("unverified")
    rows = blocks.select("doc_id", F.col("block_id").alias("id"), "text", "section", _location(blocks).alias("location"), review.alias("review_status"))
    return own.select("ledger_id", "format", "sha256", "locator"), own.select("ledger_id", "doc_id").join(rows, "doc_id").drop("doc_id")


def _listing(spark, root: str, kinds: tuple[str, ...]) -> DataFrame:
    return files.scan(spark, root, kinds).select(F.col("relative_path").alias("path"), "sha256")


def _word_blocks(spark, root: str) -> DataFrame:
    blocks = manuscripts(files.scan(spark, root, ("docx",), content=True))["blocks"]
    return blocks.select(F.col("doc_id").alias("path"), "block_id", "text", _location(blocks).alias("location"), "section", "region")


def checked_ledgers(spark: SparkSession, path: str, source_root: str | None = None, image_root: str | None = None, manuscript: str | None = None, manuscript_root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledgers of JSON files, all their findings, and how many of each one's files were compared; a ledger with structural faults has only those, as errors of code SCHEMA.

    manuscript is a folder that read-manuscript wrote; the roots are folders of files.
    """
    raw = documents.read_json(spark, path)
    faults = schema_check.schema_findings(raw).select("ledger_id", F.lit("error").alias("severity"), F.lit("SCHEMA").alias("code"), F.concat_ws(": ", "path", "fault").alias("scope_id"))
    # the check's plan is large: what reads its few rows starts from them and not from the plan
    faults = spark.createDataFrame(faults.rdd, "ledger_id string, severity string, code string, scope_id string").persist()
    sound = raw.join(faults.select("ledger_id").distinct(), "ledger_id", "left_anti")
    shape = ledger.LEDGER.split(", ", 1)[1]
    typed = sound.select("ledger_id", F.from_json("json", shape).alias("j"))
    # every rule reads these
    ledgers = typed.select("ledger_id", "j.sources", "j.claims").persist()
    under: dict[str, DataFrame] = {}
    if manuscript:
        under["manuscript"], under["blocks"] = _papers(ledgers, manuscript)
    if manuscript_root:
        under["manuscript_files"] = _listing(spark, manuscript_root, ("docx",))
    if source_root:
        under["files"], under["word_blocks"] = _listing(spark, source_root, ("pdf", "docx")), _word_blocks(spark, source_root)
    if image_root:
        under["images"] = _listing(spark, image_root, ("png", "jpg", "jpeg"))
    r = ledger.relations(ledgers, **under)
    return ledgers, ledger.findings(r).unionByName(faults), ledger.files_checked(r)


PAYLOAD = f"title string, manuscript struct<title:string,locator:string,sha256:string>, sources array<struct<id:string,title:string,sha256:string,origin:struct<locator:string>>>, claims array<struct<id:string,heading:string,block_id:string,section:string,target_text:string,status:string,reason:string,recommendation:string,search_complete:boolean,source_ids:array<string>,evidence:array<struct<source_id:string,quote:string,section:string,pdf_page:bigint,print_page:string,region:string,context_review:string,spans:array<struct<segment_id:string,start:bigint,end:bigint>>,verification_image:string,docx_location:struct<block_id:string,location:{ledger.LOCATION}>>>>>"
CORPUS = "sources array<struct<id:string,pages:array<struct<pdf_page:bigint,segments:array<struct<id:string,text:string>>>>>>"


def checked_payload(spark: SparkSession, path: str, corpus: str, manuscript: str, source_root: str, image_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Payloads without a schema version (report_id and the columns of PAYLOAD), and their faults (report_id, code, scope_id)."""
    data = documents.read_json(spark, path, PAYLOAD).withColumn("report_id", F.lit(path))
    claim = data.select("report_id", F.posexplode("claims").alias("claim_pos", "c"))
    claims = claim.select("report_id", "claim_pos", F.col("c.id").alias("claim_id"), *[F.col(f"c.{k}").alias(k) for k in ("block_id", "target_text", "status", "reason", "recommendation", "search_complete")])
    held = claim.select("report_id", "claim_pos", F.col("c.id").alias("claim_id"), F.posexplode("c.evidence").alias("e_pos", "e"))
    evidence = held.select("report_id", "claim_pos", "claim_id", "e_pos", *[F.col(f"e.{k}").alias(k) for k in ("source_id", "quote", "region", "context_review", "spans", "verification_image")], F.col("e.docx_location.block_id").alias("block_id"), F.col("e.docx_location.location").alias("location"))
    listed = data.select("report_id", F.explode("sources").alias("s")).select("report_id", F.col("s.id").alias("source_id"), F.col("s.sha256").alias("sha256"), F.col("s.origin.locator").alias("locator"))
    parts = documents.read_json(spark, corpus, CORPUS).select(F.explode("sources").alias("s")).select(F.col("s.id").alias("source_id"), F.explode(F.flatten("s.pages.segments")).alias("g")).select("source_id", F.col("g.id").alias("segment_id"), F.col("g.text").alias("text"))
    blocks = spark.read.json(f"{manuscript.rstrip('/')}/blocks").select("block_id", "text")
    heads = spark.read.schema("sha256 string").json(f"{manuscript.rstrip('/')}/manuscript")
    there = _listing(spark, source_root, ("pdf", "docx"))
    words = listed.select("source_id", F.col("locator").alias("path")).join(_word_blocks(spark, source_root), "path").select("source_id", "block_id", "text", "location")
    images = _listing(spark, image_root, ("png", "jpg", "jpeg")).select("path") if image_root else None
    main = data.select("report_id", F.lit("manuscript").alias("source_id"), F.col("manuscript.sha256").alias("sha256"), F.col("manuscript.locator").alias("locator"))
    found = report.payload_findings(claims, evidence, listed.select("report_id", "source_id"), blocks, parts, images, words)
    found = found.unionByName(report.payload_file_findings(listed, there, "source")).unionByName(report.payload_file_findings(main, there, "manuscript"))
    return data, found.unionByName(main.join(heads, "sha256", "left_anti").select("report_id", F.lit("manuscript digest mismatch").alias("code"), F.col("source_id").alias("scope_id")))


def payload_rows(data: DataFrame) -> DataFrame:
    """report_rows of payloads."""
    c = data.select("report_id", F.posexplode("claims").alias("claim_pos", "c"))
    e = c.select("report_id", "claim_pos", "c", F.posexplode_outer("c.evidence").alias("evidence_pos", "e"))
    return e.select("report_id", "claim_pos", F.col("c.id").alias("claim_id"), F.coalesce("c.heading", F.substring("c.target_text", 1, 45)).alias("heading"), F.col("c.status").alias("status"), "evidence_pos", F.col("e.source_id").alias("source_id"), F.col("e.quote").alias("quote"), F.col("e.pdf_page").alias("pdf_page"))
