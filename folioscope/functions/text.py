"""Text rules as Column expressions.

Java's regular expressions differ from the reference behaviour in their classes
and line ends, so patterns spell the white-space class out, take Unicode classes
with (?U), and keep $ and ^ to line feeds with (?d).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
YEAR = r"(?U)(?:19|20)\d{2}"
YEAR_LETTER = r"(?U)(?:19|20)\d{2}[a-z]?"
AUTHOR_YEAR = r"(?U)[（(][^()（）\n]{0,70}?\b(?:19|20)\d{2}[a-z]?[^()（）\n]{0,20}[）)]"
NUMBERED = r"(?U)[\[［]\d+(?:[\s\x1c-\x1f\x85\p{Z}]*[-–—,，、][\s\x1c-\x1f\x85\p{Z}]*\d+)*[\]］]"


def squeeze(c: Column) -> Column:
    """Text without white space; everything else survives."""
    return F.regexp_replace(c, WS, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def strip_of(c: Column, chars: str) -> Column:
    """Without leading and trailing characters of a set that is written as in a regex class."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+\z", "")


def letters_digits(c: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_ENDS)


def terms(c: Column) -> Column:
    """Words of a-z and 0-9, and overlapping pairs within runs of Han characters, with repeats."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(r"([㐀-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1)), pairs)


def quality(c: Column, minimum: int = 40) -> Column:
    """struct(ok, reason) of a page's text; the first rule that applies decides."""
    clean = squeeze(c)
    n = F.length(clean)
    readable = F.length(F.regexp_replace(clean, r"[^\p{L}\p{N}]", ""))
    reason = (
        F.when(n < minimum, "too_little_text")
        .when(F.contains(clean, F.lit("�")) | F.contains(clean, F.lit("(cid:")) | clean.rlike(r"(?U)/C\d+"), "replacement_or_cid_characters")
        .when(F.contains(clean, F.lit("\u0000")), "null_characters")
        .when(F.regexp_count(clean, F.lit(r"([A-Za-z])\1{3,}")) >= 3, "duplicated_glyph_runs")
        .when(readable / n < 0.45, "low_readable_character_ratio")
        .otherwise("text_layer_candidate")
    )
    return F.struct((reason == "text_layer_candidate").alias("ok"), reason.alias("reason"))


def matches_with_offsets(c: Column, pattern: str) -> Column:
    """array(struct(marker, start, end)) of all matches of a pattern whose match depends on nothing around it."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(1).alias("cursor"), F.expr("cast(array() as array<struct<marker:string,start:int,end:int>>)").alias("out"))

    def step(acc, m):
        at = F.call_function("locate", m, c, acc["cursor"])
        one = F.struct(m.alias("marker"), (at - 1).alias("start"), (at - 1 + F.length(m)).alias("end"))
        return F.struct((at + F.length(m)).alias("cursor"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def citation_markers(c: Column) -> Column:
    """Citation candidates of a text in order of their start: array(struct(start, pass, kind, marker, end))."""

    def found(number: int, kind: str, pattern: str) -> Column:
        return F.transform(matches_with_offsets(c, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("pass"), F.lit(kind).alias("kind"), m["marker"].alias("marker"), m["end"].alias("end")))

    return F.array_sort(F.concat(found(0, "author_year", AUTHOR_YEAR), found(1, "numbered", NUMBERED)))


def bibliography_like(c: Column) -> Column:
    """Whether a paragraph looks like an entry of a bibliography."""
    chinese = c.rlike(r"(?Ud)^[㐀-鿿、，\s\x1c-\x1f\x85\p{Z}]{2,45}[，,]\s*(?:19|20)\d{2}[a-z]?\s*[，,]") & F.contains(c, F.lit("《"))
    english = c.rlike(r"(?Ud)^[A-Za-z][A-Za-z .,&'’\-]{2,110},\s*(?:19|20)\d{2}[a-z]?\s*,")
    return chinese | english


def clean_title(c: Column) -> Column:
    out = F.regexp_replace(c, rf"(?iUd){WS}*\(z-library[^\n]*?\)", "")
    out = F.regexp_replace(out, r"(?d)^【[^\n]*?】", "")
    return strip(F.translate(out, "_", " "))


def report_quote(c: Column, english: bool) -> Column:
    """A quotation as the report's comparison has it."""
    if english:
        joined = F.regexp_replace(c, rf"([A-Za-z])-{WS}*\n{WS}*([A-Za-z])", "$1$2")
        return F.replace(F.replace(strip(F.regexp_replace(joined, f"{WS}+", " ")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.translate(squeeze(c), "\u0082\u0000", "，")


def path_escapes(c: Column) -> Column:
    """Whether a relative path is absolute on any platform or climbs over its root."""
    parts = F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return c.rlike(r"^(?:[A-Za-z]:|\\\\|/)") | (depth["low"] < 0)


# Verdict labels of reports, and policy levels by kind of source.
STATUS_LABELS = {"direct": "直接支撑", "partial": "部分支撑", "insufficient": "相关但不足", "not_found": "未找到", "unable": "无法核准"}
POLICY_LEVELS = {"policy_document": "formal", "official_interpretation": "interpretation", "secondary_summary": "secondary", "academic_article": "secondary", "other": "secondary"}


def mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out
