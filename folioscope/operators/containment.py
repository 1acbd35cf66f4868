"""Which texts hold which strings, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 12
MAX_HEADS = 10_000  # beginnings that are looked for within a text's own row
MAX_WHOLE, MAX_WHOLE_LETTERS = 256, 1 << 18  # strings, and letters of them, up to which they are looked for whole


def few(needles: DataFrame, needle: str) -> list[str] | None:
    """The distinct, non-empty needles if they are few enough to be looked for whole, one by one; else None."""
    if needles.where(F.col(needle) != "").select(needle).distinct().limit(MAX_WHOLE + 1).agg(F.count("*").alias("n"), F.sum(F.length(needle)).alias("m")).where(f"n <= {MAX_WHOLE} AND coalesce(m, 0) <= {MAX_WHOLE_LETTERS}").isEmpty():
        return None
    return [r[0] for r in needles.where(F.col(needle) != "").select(needle).distinct().collect()]


def held(text: str, needles: list[str]):
    """array of those of few needles that a text holds."""
    return F.filter(F.array(*map(F.lit, needles)).cast("array<string>"), lambda x: F.contains(F.col(text), x))


def containing(texts: DataFrame, keys: list[str], text: str, needles: DataFrame, needle: str, gram: int = GRAM) -> DataFrame:
    """keys and needle for each text that holds one of the distinct, non-empty needles.

    A needle is met by its first letters, as many as gram: a text's runs of so
    many letters are cut by one pass of a regular expression, those that begin
    no needle are left out before anything is exploded (while beginnings are
    few; joined with them else), and only then is containment tested.
    """
    wanted = needles.select(F.col(needle).alias("__needle")).where("__needle <> ''").distinct().withColumn("__g", F.least(F.length("__needle"), F.lit(gram)))
    heads = wanted.select("__g", F.expr("substr(__needle, 1, __g)").alias("__h"), "__needle")
    lengths = sorted(r[0] for r in heads.select("__g").distinct().collect())  # gram values at most
    known = [r[0] for r in heads.select("__h").distinct().limit(MAX_HEADS + 1).collect()]
    by = {g: [h for h in known if len(h) == g] for g in lengths}
    few = len(known) <= MAX_HEADS

    def runs(g: int):
        found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)))
        held = F.filter(found, lambda h: h.isin(by[g])) if few else found
        return F.transform(held, lambda h: F.struct(F.lit(g).alias("g"), h.alias("h")))

    empty = F.array().cast("array<struct<g:int,h:string>>")
    met = texts.select(*keys, F.explode(F.flatten(F.array(empty, *map(runs, lengths)))).alias("__k"))
    pairs = met.join(heads, (F.col("__k.g") == F.col("__g")) & (F.col("__k.h") == F.col("__h"))).select(*keys, "__needle").distinct()
    return pairs.join(texts.select(*keys, F.col(text).alias("__text")), keys).where(F.contains("__text", F.col("__needle"))).select(*keys, F.col("__needle").alias(needle))
