"""Ranked search over segments by an inverted index, and exact quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.containment import containing, few, held

# Fixed values of the score.
TF_CAP, LENGTH_POWER, DIGITS, TOP = 3, 0.3, 4, 8
MAX_TERMS = 10_000  # of queries, that a segment's own are held against before they leave its row
MAX_ROW_TERMS = 200  # of queries and terms together, up to which a segment is scored within its row


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """query_id, term, weight; a query's texts count together, repeats too."""
    return queries.select("query_id", F.explode(T.terms(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def search(segments: DataFrame, queries: DataFrame, limit: int = TOP) -> DataFrame:
    """The best segments of region body or unknown for each query (query_id, query).

    segments: source_id, pdf_page, segment_id, region and text.  Only terms of
    the queries leave a segment's row and are counted, and the number of a segment's terms is taken from
    its own row, so the shuffle carries matches and not the index.
    """
    keys = ["source_id", "pdf_page", "segment_id"]
    asked = query_terms(queries)
    eligible = segments.where(F.col("region").isin("body", "unknown")).select(*keys, T.terms(F.col("text")).alias("__all"))
    weights = asked.limit(MAX_ROW_TERMS + 1).collect()
    if weights and len(weights) <= MAX_ROW_TERMS:
        scored = _scored_in_rows(eligible, keys, [tuple(r) for r in weights], asked.schema["query_id"].dataType)
    else:
        scored = _scored_by_term(eligible, keys, asked)
    score = F.bround(F.col("s") / F.greatest(F.lit(1.0), F.pow(F.col("n").cast("double"), F.lit(LENGTH_POWER))), DIGITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id", "pdf_page", F.col("segment_id").cast("string"))
    return scored.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", *keys, "score", "matched_terms", F.lit(True).alias("candidate_only"))


def _scored_in_rows(eligible: DataFrame, keys: list[str], weights: list[tuple], id_type) -> DataFrame:
    """query_id, keys, s, n, matched_terms of few queries: nothing is shuffled, so a task's memory goes by its split and not by the table."""
    terms = sorted({t for _, t, _ in weights})
    rows = eligible.select(*keys, F.size(F.array_distinct("__all")).alias("n"), F.filter("__all", lambda x: x.isin(terms)).alias("__hits")).where(F.size("__hits") > 0)
    rows = rows.select(*keys, "n", *[(F.size("__hits") - F.size(F.array_remove("__hits", t))).alias(f"__t{i}") for i, t in enumerate(terms)])
    per_query: dict = {}
    for query, term, weight in weights:
        per_query.setdefault(query, []).append((term, weight))

    def scored(query, own):
        counts = [(F.col(f"__t{terms.index(t)}"), t, w) for t, w in sorted(own)]
        s = sum((F.lit(w).cast("long") * F.least(c, F.lit(TF_CAP)) for c, _, w in counts), F.lit(0).cast("long"))
        return F.struct(F.lit(query).cast(id_type).alias("query_id"), s.alias("s"), F.concat_ws(" ", *[F.when(c > 0, F.lit(t)) for c, t, _ in counts]).alias("matched_terms"))

    each = rows.select(*keys, "n", F.explode(F.array(*[scored(q, own) for q, own in per_query.items()])).alias("q"))
    return each.where("q.s > 0").select("q.query_id", *keys, "q.s", "n", "q.matched_terms")


def _scored_by_term(eligible: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """The same of many queries, by a join of terms."""
    known = [r[0] for r in asked.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    each = eligible.select(*keys, F.size(F.array_distinct("__all")).alias("n_terms"), F.explode(F.filter("__all", lambda x: x.isin(known)) if len(known) <= MAX_TERMS else F.col("__all")).alias("term"))
    hits = each.join(asked, "term").groupBy("query_id", *keys, "term").agg(F.count("*").alias("tf"), F.first("weight").alias("weight"), F.first("n_terms").alias("n_terms"))
    return hits.groupBy("query_id", *keys).agg(F.sum(F.col("weight") * F.least("tf", F.lit(TF_CAP))).alias("s"), F.first("n_terms").alias("n"), F.array_join(F.sort_array(F.collect_set("term")), " ").alias("matched_terms"))


def contiguous_groups(segments: DataFrame, strict: bool = False) -> DataFrame:
    """Body segments with the number of their run: same section, page the same or the next, nothing between."""
    w = Window.partitionBy("source_id").orderBy("pdf_page", "seg_pos")
    fit = (F.col("region") == "body") & ((F.col("review_status") == "verified") if strict else F.lit(True))
    out = segments.withColumn("__fit", F.coalesce(fit, F.lit(False)))
    step = F.col("pdf_page") - F.lag("pdf_page").over(w)
    joined = F.lag("__fit").over(w) & F.lag("section").over(w).eqNullSafe(F.col("section")) & step.isin(0, 1)
    out = out.withColumn("__new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where("__fit").drop("__fit", "__new")


def locate_quotes(segments: DataFrame, quotes: DataFrame, strict: bool = False, gram: int = 12) -> DataFrame:
    """All places of each quote (quote_id, quote) in body text, white space aside, over segment and page bounds.

    Quotes meet runs of segments by their first gram letters (containing).
    source_sha256 and print_pages are null where segments has no sha256 and no
    print_page.
    """
    runs = contiguous_groups(segments, strict)
    w = Window.partitionBy("source_id", "grp").orderBy("pdf_page", "seg_pos")
    runs = runs.withColumn("norm", T.squeeze(F.col("text"))).withColumn("n", F.length("norm"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    joined = runs.groupBy("source_id", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("before", "pdf_page", "seg_pos", "norm"))), lambda x: x["norm"]), "").alias("whole"))
    wanted = quotes.select("quote_id", "quote", T.squeeze(F.col("quote")).alias("target")).where("target <> ''").withColumn("m", F.length("target"))
    strings = few(wanted, "target")
    if strings is not None:
        # few quotations are looked for within a run's row: its text is joined with nothing
        pairs = joined.withColumn("target", F.explode(held("whole", strings))).join(F.broadcast(wanted), "target")
    else:
        pairs = containing(joined, ["source_id", "grp"], "whole", wanted, "target", gram).join(joined, ["source_id", "grp"]).join(wanted, "target")
    # places that may overlap: as many as the text has, each looked for behind the one before
    literal = F.concat(F.lit("(?s)(?=\\Q"), F.replace(F.col("target"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    many = F.sequence(F.lit(1), F.regexp_count("whole", literal))
    starts = F.aggregate(many, F.array().cast("array<int>"), lambda found, _: F.concat(found, F.array(F.call_function("locate", F.col("target"), F.col("whole"), F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) + 1))))
    hits = pairs.select("source_id", "grp", "quote_id", "quote", "m", F.explode(starts).alias("at")).withColumn("at", F.col("at") - 1)
    parts = runs.select("source_id", "grp", "pdf_page", "seg_pos", "segment_id", "section", "review_status", "text", "before", "n", *[(F.col(c) if c in runs.columns else F.lit(None).cast("string")).alias(c) for c in ("print_page", "sha256")])
    spans = hits.join(parts, ["source_id", "grp"]).where((F.col("before") < F.col("at") + F.col("m")) & (F.col("before") + F.col("n") > F.col("at")) & (F.col("n") > 0))
    solid = F.array_compact(F.transform(F.split("text", ""), lambda c, i: F.when((c != "") & ~c.rlike(T.WS), i + 1)))
    opens, closes = F.col("at") >= F.col("before"), F.col("at") + F.col("m") <= F.col("before") + F.col("n")
    spans = spans.withColumn("__s", solid)
    start = F.when(opens, F.element_at("__s", (F.col("at") - F.col("before") + 1).cast("int")) - 1).otherwise(0)
    end = F.when(closes, F.element_at("__s", (F.col("at") + F.col("m") - F.col("before")).cast("int"))).otherwise(F.length("text"))
    one = F.struct("pdf_page", "seg_pos", "segment_id", start.cast("int").alias("start"), end.cast("int").alias("end"), "section", F.col("review_status").alias("review"), "print_page", "sha256")
    found = spans.groupBy("source_id", "quote_id", "quote", "grp", "at").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return found.select(
        "source_id", F.col("s")[0]["sha256"].alias("source_sha256"), "quote_id", "quote", F.col("s")[0]["section"].alias("section"), F.array_distinct("s.pdf_page").alias("pdf_pages"), F.array_distinct("s.print_page").alias("print_pages"),
        F.transform("s", lambda x: F.struct(x["segment_id"].alias("segment_id"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
        F.forall("s", lambda x: x["review"] == "verified").alias("segments_reviewed"), F.lit("pending").alias("completeness_review"), F.lit("pending").alias("context_review"), F.col("at"),
    )
