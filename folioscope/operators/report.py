"""Report relations: rows, source labels, counts, checks of payloads, export gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

HEADING = 42


def report_rows(ledgers: DataFrame) -> DataFrame:
    """A row for each piece of evidence of each claim, and one for claims without any."""
    c = ledgers.select("ledger_id", F.posexplode("claims").alias("claim_pos", "c"))
    e = c.select("ledger_id", "claim_pos", "c", F.posexplode_outer("c.evidence").alias("evidence_pos", "e"))
    place = F.coalesce(F.col("c.target.docx_location.block_id"), F.concat(F.lit("主稿PDF第"), F.col("c.target.pdf_page").cast("string"), F.lit("页")))
    printed = F.nullif(F.array_join(F.filter("e.print_pages", lambda p: p.isNotNull() & (p != "")), "—"), F.lit(""))
    paged = F.col("e.docx_location").isNull()
    return e.select("ledger_id", "claim_pos", F.col("c.id").alias("claim_id"), F.coalesce("c.heading", F.substring("c.target.text", 1, HEADING)).alias("heading"), F.col("c.target.section").alias("section"), place.alias("block_id"), T.mapped(F.col("c.status"), T.STATUS_LABELS).alias("status"), F.col("c.citation_role").alias("citation_role"), "evidence_pos", F.col("e.source_id").alias("source_id"), F.col("e.quote").alias("quote"), F.when(paged, F.try_element_at("e.pdf_pages", F.lit(1))).alias("pdf_page"), F.when(paged, printed).alias("print_page"))


def source_labels(claims: DataFrame, report: str = "ledger_id", pos: str = "claim_pos", sources: str = "source_ids") -> DataFrame:
    """R01, R02, ... by the order in which claims first use a source."""
    used = claims.select(report, pos, F.posexplode(sources).alias("n", "source_id")).groupBy(report, "source_id").agg(F.min(F.struct(pos, "n")).alias("first"))
    return used.withColumn("label", F.format_string("R%02d", F.row_number().over(Window.partitionBy(report).orderBy("first")))).select(report, "source_id", "label")


def verdict_counts(claims: DataFrame, report: str = "ledger_id", status: str = "status") -> DataFrame:
    """Claims of each verdict, zero where a report has none."""
    kinds = claims.sparkSession.createDataFrame([(v,) for v in T.STATUS_LABELS.values()], "status string")
    every = claims.select(report).distinct().join(F.broadcast(kinds))  # five verdicts
    counts = claims.groupBy(report, F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return every.join(counts, [report, "status"], "left").na.fill(0, ["n"])


def unique_quotes(evidence: DataFrame, report: str = "ledger_id") -> DataFrame:
    return evidence.groupBy(report).agg(F.countDistinct(F.struct("source_id", "quote")).alias("unique_quotes"))


def payload_findings(claims: DataFrame, evidence: DataFrame, sources: DataFrame, blocks: DataFrame, segments: DataFrame, images: DataFrame | None = None, word_blocks: DataFrame | None = None) -> DataFrame:
    """Faults of an unversioned payload: report_id, code, scope_id.

    claims: report_id, claim_pos, claim_id, block_id, target_text, status, reason, recommendation, search_complete;
    evidence: report_id, claim_pos, claim_id, e_pos, source_id, quote, region, context_review, block_id, location, spans, verification_image;
    sources: report_id, source_id; blocks: block_id, text; segments: source_id, segment_id, text; images: path; word_blocks: source_id, block_id, text, location.
    """
    R = "report_id"
    labels = list(T.STATUS_LABELS.values())
    out = []

    def put(df: DataFrame, code: str, scope: str = "claim_id") -> None:
        out.append(df.select(R, F.lit(code).alias("code"), F.col(scope).alias("scope_id")))

    again = lambda df, key, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(R, key).orderBy(order))).where("__n > 1")
    put(again(sources, "source_id", "source_id"), "duplicate source", "source_id")
    put(again(claims, "claim_id", "claim_pos"), "duplicate claim")
    held = claims.join(blocks.select("block_id", F.col("text").alias("__text")), "block_id", "left")
    put(held.where(~F.contains(F.coalesce("__text", F.lit("")), F.col("target_text"))), "target mismatch")
    put(claims.where(~F.col("status").isin(labels)), "invalid verdict")
    put(claims.where("coalesce(reason, '') = '' OR coalesce(recommendation, '') = ''"), "missing review")
    put(claims.where((F.col("status") == T.STATUS_LABELS["not_found"]) & ~F.coalesce("search_complete", F.lit(False))), "unfinished negative search")
    put(claims.where(F.col("status").isin(labels[:3])).join(evidence.select(R, "claim_pos").distinct(), [R, "claim_pos"], "left_anti"), "missing evidence")
    put(evidence.join(sources, [R, "source_id"], "left_anti"), "unknown evidence source")
    known = evidence.join(sources.distinct(), [R, "source_id"], "left_semi")
    put(known.where("NOT (region <=> 'body') OR NOT (context_review <=> '执行者复核')"), "unreviewed body or context")
    word = known.where("location IS NOT NULL")
    if word_blocks is not None:
        there = word_blocks.select("source_id", "block_id", F.col("text").alias("w_text"), F.col("location").alias("w_location"))
        put(word.join(there, ["source_id", "block_id"], "left").where("NOT (w_text <=> quote) OR NOT (w_location <=> location)"), "word source mismatch")
    else:
        put(word, "word source mismatch")
    bound = known.where("location IS NULL AND size(spans) > 0")
    pieces = bound.select(R, "claim_pos", "claim_id", "e_pos", "source_id", "quote", F.posexplode("spans").alias("n", "x")).withColumn("segment_id", F.col("x.segment_id")).join(segments.select("source_id", "segment_id", F.col("text").alias("s_text")), ["source_id", "segment_id"], "left")
    pieces = pieces.withColumn("fits", F.coalesce(F.expr("s_text IS NOT NULL AND x.start >= 0 AND x.start < x.end AND x.end <= length(s_text)"), F.lit(False))).withColumn("piece", F.expr("substring(s_text, cast(x.start as int) + 1, cast(x.end - x.start as int))"))
    whole = pieces.groupBy(R, "claim_pos", "claim_id", "e_pos", "quote").agg(F.bool_and("fits").alias("fits"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda p: p["piece"]), "").alias("raw"))
    put(whole.where("NOT fits"), "evidence span unavailable")
    put(whole.where("fits").where((F.col("quote") != T.report_quote(F.col("raw"), True)) & (F.col("quote") != T.report_quote(F.col("raw"), False))), "evidence span mismatch")
    loose = known.where("location IS NULL AND coalesce(size(spans), 0) <= 0")
    if images is None:
        put(loose, "unbound quotation")
    else:
        put(loose.where("coalesce(verification_image, '') = ''"), "unbound quotation")
        shown = loose.where("verification_image <> ''").select(R, "claim_id", F.explode(F.split("verification_image", ";")).alias("path"))
        put(shown.where(T.path_escapes(F.col("path"))), "unsafe image path")
        put(shown.where(~T.path_escapes(F.col("path"))).join(images, "path", "left_anti"), "image missing")
    made = out[0]
    for one in out[1:]:
        made = made.unionByName(one)
    return made


def payload_file_findings(listed: DataFrame, files: DataFrame, what: str) -> DataFrame:
    """Faults of a payload's files (report_id, source_id, sha256, locator) against those under a root (path, sha256): gone, outside of it, or changed."""
    path = F.coalesce("locator", F.lit(""))
    safe = listed.where(~T.path_escapes(path) & (path != ""))
    met = safe.join(files.select(F.col("path").alias("locator"), F.col("sha256").alias("own")), "locator", "left")
    said = lambda df, code: df.select("report_id", F.lit(f"{what} {code}").alias("code"), F.col("source_id").alias("scope_id"))
    lost = listed.where(T.path_escapes(path) | (path == "")).select("report_id", "source_id").unionByName(met.where("own IS NULL").select("report_id", "source_id"))
    return said(lost, "unavailable or unsafe path").unionByName(said(met.where("own <> sha256"), "changed"))


def exportable(ledgers: DataFrame, found: DataFrame) -> DataFrame:
    """Ledgers that neither an error nor a blocker holds back."""
    return ledgers.join(found.where(F.col("severity").isin("error", "blocker")).select("ledger_id").distinct(), "ledger_id", "left_anti")
