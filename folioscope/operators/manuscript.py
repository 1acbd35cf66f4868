"""Structure of manuscripts: headings, bibliography, citations, notes.

Paragraphs come as rows (doc_id, pos, block_id, kind, style_level, text, note_refs
array<struct<kind,id,offset>>), pos numbering all of a document in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Fixed values.
NO_SECTION = "未定位章节"
UNTITLED = "未设标题的参考文献清单（候选）"
NO_ANCHOR = "未关联正文位置"
MAX_LEVEL = 10


def _order(doc: str, pos: str):
    return Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)


def heading_sections(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", text: str = "text", main: Column | None = None, trim: Callable[[Column], Column] = T.strip) -> DataFrame:
    """blocks with section.  A heading of a level holds until one of its level or a lower one: so level k counts if it came after all lower ones.

    trim makes a heading's name of its text; headings that have no name leave none."""
    main = F.lit(True) if main is None else main
    w = _order(doc, pos)
    seen = {k: F.last(F.when(main & (F.col(level) == k), F.struct(F.col(pos).alias("p"), trim(F.col(text)).alias("t"))), ignorenulls=True).over(w) for k in range(1, MAX_LEVEL + 1)}
    out = blocks.withColumns({f"__h{k}": c for k, c in seen.items()})
    parts = []
    for k in range(1, MAX_LEVEL + 1):
        lower = [F.coalesce(F.col(f"__h{j}.p"), F.lit(-1)) for j in range(1, k)]
        top = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(-1)
        parts.append(F.when(F.col(f"__h{k}.p") > top, F.col(f"__h{k}.t")))
    names = F.array_join(F.array_compact(F.array(*parts)), " / ")
    return out.withColumn("section", F.when(names != "", names).otherwise(NO_SECTION)).drop(*[f"__h{k}" for k in seen])


def bibliography_region(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", text: str = "text", kind: str = "kind") -> DataFrame:
    """blocks with region: bibliography from its title to the next heading, else body; blocks off the main flow have their kind."""
    main = F.col(kind) == "paragraph"
    title = T.strip(F.col(text)).rlike(r"(?iU)^(?:参考文献|References|Bibliography)\z")
    mark = F.when(main & title, "bibliography").when(main & F.col(level).isNotNull() & (F.col(level) != 0), "body")
    state = F.coalesce(F.last(mark, ignorenulls=True).over(_order(doc, pos)), F.lit("body"))
    return blocks.withColumn("region", F.when(main, state).otherwise(F.col(kind)))


def untitled_bibliography(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text", kind: str = "kind") -> DataFrame:
    """blocks with region and section changed from the first of three entries in a row on."""
    w = Window.partitionBy(doc).orderBy(pos)
    main = blocks.where(F.col(kind) == "paragraph").select(doc, pos, T.bibliography_like(F.col(text)).alias("e"))
    run = main.withColumn("run", F.col("e") & F.coalesce(F.lead("e", 1).over(w), F.lit(False)) & F.coalesce(F.lead("e", 2).over(w), F.lit(False)))
    first = run.where("run").groupBy(doc).agg(F.min(pos).alias("__from"))
    late = F.coalesce(F.col(pos) >= F.col("__from"), F.lit(False))
    return blocks.join(first, doc, "left").withColumn("region", F.when(late, "bibliography").otherwise(F.col("region"))).withColumn("section", F.when(late, UNTITLED).otherwise(F.col("section"))).withColumn("untitled", late).drop("__from")


def structure(paragraphs: DataFrame, blank: bool = False, trim: Callable[[Column], Column] = T.strip) -> DataFrame:
    """Blocks of manuscripts: blank paragraphs gone unless blank, with section, region and review_status."""
    kept = (paragraphs if blank else paragraphs.where(T.strip(F.col("text")) != "")).withColumnRenamed("style_level", "level")
    sections = heading_sections(kept, main=F.col("kind") == "paragraph", trim=trim)
    return untitled_bibliography(bibliography_region(sections)).withColumn("review_status", F.lit("unverified"))


def citations(blocks: DataFrame) -> DataFrame:
    """Citation candidates of blocks: regex markers outside bibliographies, and note references."""
    base = ["doc_id", "pos", "block_id"]
    inline = blocks.where(F.col("region") != "bibliography").select(*base, F.posexplode(T.citation_markers(F.col("text"))).alias("n", "m"))
    inline = inline.select(*base, F.lit(0).alias("pass"), "n", F.col("m.kind").alias("kind"), F.col("m.marker").alias("marker"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lit(None).cast("string").alias("note_id"))
    if "note_refs" not in blocks.columns:
        return inline.withColumn("candidate_only", F.lit(True))
    untitled = F.col("untitled") if "untitled" in blocks.columns else F.lit(False)
    refs = blocks.where(~untitled).select(*base, F.posexplode("note_refs").alias("n", "r"))
    refs = refs.select(*base, F.lit(1).alias("pass"), "n", F.concat("r.kind", F.lit("_reference")).alias("kind"), F.col("r.id").alias("marker"), F.col("r.offset").alias("start"), F.col("r.offset").alias("end"), F.col("r.id").alias("note_id"))
    return inline.unionByName(refs).withColumn("candidate_only", F.lit(True))


def link_notes(note_paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """note_paragraphs (doc_id, note_kind, note_id, par, block_id, text, note_type) with the section of the note's first anchor."""
    refs = blocks.select("doc_id", "pos", "section", F.explode("note_refs").alias("r")).select("doc_id", F.col("r.kind").alias("note_kind"), F.col("r.id").alias("note_id"), F.struct("pos", F.col("r.offset").alias("offset"), "section").alias("a"))
    anchors = refs.groupBy("doc_id", "note_kind", "note_id").agg(F.min("a").alias("first"), F.count("*").alias("n_anchors"))
    real = note_paragraphs.where(~F.coalesce(F.col("note_type"), F.lit("")).isin("separator", "continuationSeparator") & (F.col("note_id").cast("int") >= 0))
    out = real.join(anchors, ["doc_id", "note_kind", "note_id"], "left")
    return out.withColumn("section", F.coalesce("first.section", F.lit(NO_ANCHOR))).withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0).cast("long"))).drop("first")


def dangling_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Note references without a note, one row each."""
    refs = blocks.select("doc_id", "block_id", F.explode("note_refs").alias("r")).select("doc_id", "block_id", F.col("r.kind").alias("note_kind"), F.col("r.id").alias("note_id"), F.col("r.offset").alias("offset"))
    return refs.join(notes.select("doc_id", "note_kind", "note_id").distinct(), ["doc_id", "note_kind", "note_id"], "left_anti")
