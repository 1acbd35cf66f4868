"""Pages of text to segments: line classes, carried state, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Region and section names, and patterns of structural lines.
NO_SECTION, ABSTRACT, BIBLIOGRAPHY, KEYWORDS = "未定位章节", "摘要", "参考文献", "关键词"
ABSTRACT_LINE = r"(?iU)^(?:【|\[)?(?:摘要|内容提要|Abstract)(?:】|\])?(?:[:：\s\x1c-\x1f\x85\p{Z}]|(?=[㐀-鿿])|\z)"
BIBLIOGRAPHY_LINE = r"(?iU)^(参考文献|References|Bibliography)[:：]?\z"
HEADING_LINE = r"(?iU)^(?:[一二三四五六七八九十]+[、．.]|[（(][一二三四五六七八九十]+[）)]|\d+(?:\.\d+)*[.、\s\x1c-\x1f\x85\p{Z}]|(?:Introduction|Conclusion|Discussion|Results|Methods)\b)"
KEYWORDS_LINE = r"(?iU)^(?:【|\[)?(?:关键词|关键字|Keywords)(?:】|\])?[:：\s]?"
HEADING_LENGTH = 85


def line_class(line: Column) -> Column:
    """struct(region, section) that a structural line opens; null for other lines."""
    compact = T.squeeze(line)
    made = lambda region, section: F.struct(F.lit(region).alias("region"), section.alias("section"))
    return (
        F.when(line.rlike(ABSTRACT_LINE), made("abstract", F.lit(ABSTRACT)))
        .when(compact.rlike(BIBLIOGRAPHY_LINE), made("bibliography", F.lit(BIBLIOGRAPHY)))
        .when(line.rlike(HEADING_LINE) & (F.length(compact) < HEADING_LENGTH), made("body", line))
        .when(line.rlike(KEYWORDS_LINE), made("other", F.lit(KEYWORDS)))
    )


def classified_lines(pages: DataFrame, source: str = "source_id", page: str = "pdf_page", text: str = "text") -> DataFrame:
    """Lines of pages with region and section; the state runs on over the pages of a source."""
    lines = pages.select(source, page, F.posexplode(T.lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "raw"))
    lines = lines.withColumn("line", T.strip(F.col("raw"))).where("line <> ''").withColumn("token", line_class(F.col("line"))).drop("raw")
    return carried(lines, source, page)


def carried(lines: DataFrame, source: str = "source_id", page: str = "pdf_page") -> DataFrame:
    """lines (source, page, line_no, line, token) with the region and section of the last token, null where a line opens nothing."""
    last = F.last("token", ignorenulls=True).over(Window.partitionBy(source).orderBy(page, "line_no").rowsBetween(Window.unboundedPreceding, 0))
    lost = F.struct(F.lit("unknown").alias("region"), F.lit(NO_SECTION).alias("section"))
    after_keywords = F.col("token").isNull() & (F.col("last.region") == "other") & (F.col("last.section") == KEYWORDS)
    state = F.when(F.col("last").isNull() | after_keywords, lost).otherwise(F.col("last"))
    return lines.withColumn("last", last).withColumn("state", state).select(source, page, "line_no", "line", "state.region", "state.section")


def segment_pages(pages: DataFrame, source: str = "source_id", page: str = "pdf_page", text: str = "text", extraction: str = "text_layer") -> DataFrame:
    """Segments of pages: runs of lines of one state within a page."""
    return segment_lines(classified_lines(pages, source, page, text), source, page, extraction)


def segment_lines(lines: DataFrame, source: str = "source_id", page: str = "pdf_page", extraction: str = "text_layer") -> DataFrame:
    """Segments of lines that have their region and section."""
    w = Window.partitionBy(source, page).orderBy("line_no")
    changed = (F.lag("region").over(w).isNull() | (F.lag("region").over(w) != F.col("region")) | (F.lag("section").over(w) != F.col("section"))).cast("int")
    runs = lines.withColumn("__new", changed).withColumn("seg_pos", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    made = runs.groupBy(source, page, "seg_pos").agg(F.first("region").alias("region"), F.first("section").alias("section"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return made.select(source, page, "seg_pos", F.concat(F.lit("p"), F.col(page), F.lit(".s"), "seg_pos").alias("segment_id"), "region", "section", F.array_join("x.line", "\n").alias("text"), F.lit(extraction).alias("extraction"), F.lit("unverified").alias("review_status"))


def extraction_fallback(pages: DataFrame, primary: str = "text_primary", alternate: str = "text_alt", ocr: str = "text_ocr") -> DataFrame:
    """pages with the text to use: a bad text layer gives way to a good alternate one, then to OCR where there is some."""
    first, second = T.quality(F.col(primary)), T.quality(F.col(alternate))
    out = pages.withColumns({"__1": first, "__2": second})
    swap = ~F.col("__1.ok") & F.col("__1.reason").isin("replacement_or_cid_characters", "null_characters", "duplicated_glyph_runs") & F.coalesce(F.col("__2.ok"), F.lit(False))
    out = out.withColumn("__t", F.when(swap, F.col(alternate)).otherwise(F.col(primary))).withColumn("__swap", swap)
    scan = ~T.quality(F.col("__t"))["ok"] & F.col(ocr).isNotNull()
    out = out.withColumn("text", F.when(scan, F.col(ocr)).otherwise(F.col("__t"))).withColumn("extraction", F.when(scan, "ocr").otherwise("text_layer")).withColumn("alternate_text_layer_used", F.col("__swap"))
    found = T.quality(F.col("text"))
    return out.withColumn("quality_ok", found["ok"]).withColumn("quality_reason", F.when(F.col("__swap") & (F.col("extraction") == "text_layer"), "alternate_text_layer_candidate").otherwise(found["reason"])).drop("__1", "__2", "__t", "__swap")


def coverage(pages: DataFrame, totals: DataFrame | None = None, source: str = "source_id") -> DataFrame:
    """Coverage of each source from its pages' quality_ok; totals (source, total_pages) tells of pages that were not chosen."""
    out = pages.groupBy(source).agg(F.count("*").alias("n_pages"), F.sum(F.col("quality_ok").cast("long")).alias("n_ok"))
    out = out.join(totals, source, "left") if totals is not None else out.withColumn("total_pages", F.col("n_pages"))
    return out.withColumn("coverage", F.when((F.col("n_ok") == F.col("n_pages")) & (F.col("n_pages") == F.coalesce("total_pages", "n_pages")), "full").when(F.col("n_ok") > 0, "partial").otherwise("unreadable"))


def exit_status(pages: DataFrame) -> DataFrame:
    """weak: pages of poor text; status: 2 if there is any, else 0."""
    weak = F.coalesce(F.sum((~F.col("quality_ok")).cast("long")), F.lit(0).cast("long"))
    return pages.agg(weak.alias("weak"), F.when(weak > 0, 2).otherwise(0).alias("status"))


def selected_pages(pages: DataFrame, wanted: list[int], page: str = "pdf_page") -> DataFrame:
    return pages.where(F.col(page).isin(wanted))


def invalid_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages asked for that a source has not."""
    return wanted.join(pages.select("source_id", "pdf_page"), ["source_id", "pdf_page"], "left_anti")
