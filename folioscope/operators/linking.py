"""Citations to sources: references in markers and notes, bibliographies, files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.containment import containing

# Patterns of references in notes, and scores of file matches.
BOOK = r"([^；;\n]{1,100}?)[:：][\s\x1c-\x1f\x85\p{Z}]*《([^》]+)》([^；;\n]*)"
LEAD_IN = "参见|讨论，|应用，"
EDGE = " ,，"
TITLE_SCORE, YEAR_SCORE, AUTHOR_SCORE = 1.0, 0.8, 0.6


def _year(c: Column, pattern: str = T.YEAR) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def note_references(text: Column) -> Column:
    """References in a note: array(struct(authors, year, title)); books in 《》 first, then quoted titles."""
    groups = [F.regexp_extract_all(text, F.lit(BOOK), F.lit(i)) for i in (1, 2, 3)]
    books = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "atr", strict=True)]),
        lambda x: F.struct(T.strip(F.element_at(F.split(x["a"], LEAD_IN), -1)).alias("authors"), _year(x["r"]).alias("year"), x["t"].alias("title")),
    )
    marks = T.matches_with_offsets(text, '"[^"]+"')
    titles = F.transform(
        marks,
        lambda m: F.struct(
            T.strip_of(F.element_at(F.split(F.substr(text, F.lit(1), m["start"]), "[；;]"), -1), EDGE).alias("authors"),
            _year(F.element_at(F.split(F.substr(text, m["end"] + 1), "[；;]"), 1)).alias("year"),
            F.substr(m["marker"], F.lit(2), F.length(m["marker"]) - 2).alias("title"),
        ),
    )
    return F.concat(books, titles)


def author_year(marker: Column) -> Column:
    """References in an author-year marker: array(struct(authors, year, title)); authors carry on where left out."""
    parts = F.split(T.strip_of(marker, "（）()"), "[;；]")
    dated = F.filter(parts, lambda p: p.rlike(T.YEAR_LETTER))
    pairs = F.transform(dated, lambda p: F.struct(T.strip_of(F.regexp_extract(p, rf"(?s)^(.*?){T.YEAR_LETTER.removeprefix('(?U)')}", 1), EDGE + "、").alias("a"), F.regexp_extract(p, T.YEAR_LETTER, 0).alias("y")))
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<struct<authors:string,year:string,title:string>>)").alias("out"))

    def step(acc, p):
        who = F.when(p["a"] != "", p["a"]).otherwise(acc["last"])
        return F.struct(who.alias("last"), F.concat(acc["out"], F.array(F.struct(who.alias("authors"), p["y"].alias("year"), F.lit(None).cast("string").alias("title")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def bibliography(blocks: DataFrame) -> DataFrame:
    """Entries of bibliography blocks that name a year: doc_id, pos, block_id, authors, year, title."""
    year = T.YEAR_LETTER.removeprefix("(?U)")
    dated = blocks.where((F.col("region") == "bibliography") & F.col("text").rlike(T.YEAR_LETTER))
    title = F.coalesce(F.nullif(F.regexp_extract("text", "《([^》]+)》|\"([^\"]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract("text", "《([^》]+)》|\"([^\"]+)\"", 2), F.lit("")))
    head, tail = F.regexp_extract("text", rf"(?Us)^(.*?){year}", 1), F.regexp_extract("text", rf"(?Us)^.*?{year}(.*)\z", 1)
    return dated.select("doc_id", "pos", "block_id", T.strip_of(head, EDGE).alias("authors"), F.regexp_extract("text", T.YEAR_LETTER, 0).alias("year"), F.coalesce(title, T.strip_of(tail, EDGE)).alias("title"))


def with_bibliography_titles(references: DataFrame, entries: DataFrame) -> DataFrame:
    """references (doc_id, ref_id, authors, year, title) with the title of the first entry of that year whose authors contain theirs."""
    who = T.letters_digits(F.replace(F.col("authors"), F.lit("等"), F.lit("")))
    left = references.withColumn("__who", who)
    right = entries.select("doc_id", "year", F.col("pos").alias("__pos"), F.col("title").alias("__title"), T.letters_digits(F.col("authors")).alias("__bib"))
    found = left.join(right, ["doc_id", "year"]).where(F.contains("__bib", F.col("__who"))).groupBy("doc_id", "ref_id").agg(F.min_by("__title", "__pos").alias("__first"))
    return left.join(found, ["doc_id", "ref_id"], "left").withColumn("title", F.coalesce("__first", "title")).drop("__first", "__who")


def file_matches(references: DataFrame, files: DataFrame) -> DataFrame:
    """Every file that may be a reference's source: ref columns, relative_path, match_score, rank.

    Distinct titles and first authors meet distinct names of files by their
    beginnings (containing); references and files join these by equality.
    """
    first = T.strip(F.replace(F.element_at(F.split("authors", r"(?U)[、，,]|\band\b|\bet al\b"), 1), F.lit("等"), F.lit("")))
    asked = references.withColumn("__t", T.letters_digits(F.coalesce("title", F.lit("")))).withColumn("__a", T.letters_digits(first))
    named = files.select("relative_path", F.col("title").alias("__raw"), T.letters_digits(F.col("title")).alias("__n"))
    names, titles, authors = named.select("__n").distinct(), asked.select("__t").where("__t <> ''").distinct(), asked.select("__a").distinct()
    held = containing(names, ["__n"], "__n", titles, "__t")
    holding = containing(titles, ["__t"], "__t", names, "__n").select("__n", "__t")
    # a name without letters lies in every title
    void = titles.withColumn("__n", F.lit("")).join(names.where("__n = ''"), "__n").select("__n", "__t")
    by_title = held.union(holding).union(void).distinct().join(named, "__n")
    by_author = containing(names, ["__n"], "__n", authors, "__a").join(named, "__n")
    columns = references.columns
    found = asked.join(by_title.select("__t", "relative_path", "__raw"), "__t").select(*columns, "relative_path", "__raw", F.lit(True).alias("__titled"))
    found = found.unionByName(asked.join(by_author.select("__a", "relative_path", "__raw"), "__a").select(*columns, "relative_path", "__raw", F.lit(False).alias("__titled")))
    out = found.groupBy(*columns, "relative_path").agg(F.max("__titled").alias("__titled"), F.first("__raw").alias("__raw"))
    score = F.when(F.col("__titled"), TITLE_SCORE).when(F.coalesce(F.contains("__raw", F.col("year")), F.lit(False)) & F.col("year").isNotNull(), YEAR_SCORE).otherwise(AUTHOR_SCORE)
    out = out.withColumn("match_score", score).withColumn("candidate_only", F.lit(True))
    best = Window.partitionBy("doc_id", "ref_id").orderBy(F.desc("match_score"), "relative_path")
    return out.withColumn("rank", F.row_number().over(best)).drop("__titled", "__raw")


def unmatched(references: DataFrame, matches: DataFrame) -> DataFrame:
    return references.join(matches.select("doc_id", "ref_id").distinct(), ["doc_id", "ref_id"], "left_anti")


class Discovered(Mapping):
    """Relations made when they are first asked for, as file matches run jobs before they have a plan."""

    def __init__(self, **makers):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name](self)
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def discover(citations: DataFrame, blocks: DataFrame, notes: DataFrame | None, files: DataFrame) -> Discovered:
    """groups of references for every citation candidate, references with their bibliography titles, occurrences, bibliography, file matches and what is unmatched."""
    w = Window.partitionBy("doc_id").orderBy("pos", "pass", "n")
    marks = citations.join(blocks.select("doc_id", "block_id", "section", F.col("text").alias("target_context")), ["doc_id", "block_id"])
    marks = marks.withColumn("number", F.row_number().over(w)).withColumn("group_id", F.format_string("G%03d", "number"))
    if notes is not None:
        texts = notes.groupBy("doc_id", "note_kind", "note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("par", "text"))), lambda x: x["text"]), "\n").alias("note_text"))
        marks = marks.withColumn("note_kind", F.regexp_replace("kind", "_reference$", "")).join(texts, ["doc_id", "note_kind", "note_id"], "left").drop("note_kind")
    else:
        marks = marks.withColumn("note_text", F.lit(None).cast("string"))
    is_note = F.col("kind").isin("footnote_reference", "endnote_reference")
    none = F.expr("cast(array() as array<struct<authors:string,year:string,title:string>>)")
    marks = marks.withColumn("reference_text", F.when(is_note, F.coalesce("note_text", F.lit(""))).otherwise(F.col("marker")))
    marks = marks.withColumn("refs", F.when(is_note, note_references(F.col("reference_text"))).when(F.col("kind") == "author_year", author_year(F.col("marker"))).otherwise(none)).drop("note_text")
    groups = marks.withColumn("status", F.lit("candidate_group_not_semantic_verdict"))
    refs = groups.select("doc_id", "group_id", "kind", F.posexplode("refs").alias("ref_pos", "r")).select("doc_id", "group_id", "kind", F.concat("group_id", F.lit("."), "ref_pos").alias("ref_id"), "r.authors", "r.year", "r.title")
    entries = bibliography(blocks)
    return Discovered(
        groups=lambda found: groups,
        references=lambda found: with_bibliography_titles(refs.where("kind = 'author_year'"), entries).unionByName(refs.where("kind <> 'author_year'")),
        occurrences=lambda found: found["references"].groupBy("doc_id").agg(F.count("*").alias("reference_occurrences")),
        bibliography=lambda found: entries,
        matches=lambda found: file_matches(found["references"], files),
        unmatched=lambda found: unmatched(found["references"], found["matches"]),
    )
