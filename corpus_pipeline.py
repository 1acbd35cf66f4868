"""From documents to a weighted mixture, in five stages.

Every stage takes all that its predecessor kept, with the columns of documents,
and returns the same columns; the last adds n_tokens, weight, block and n_copies,
the number of copies that the mixture takes of the row (mix_n_tokens and so on,
where documents has such a column), and mixing.realise() makes the copies in
order.  Stages are written as Parquet in the shared folder and read again; what
only earlier stages read is removed.

Rejected or removed: texts of no language (und; null or letterless ones only,
where no language could be learned); all but one document of each
near-duplicate group, and all but one of rows of equal id (the one of the
longest text, then the greatest); passages of 50 bytes
and more that an earlier document has, and documents of which nothing else is
left; documents with passages of two benchmark items and more; the passages of
one item.  Everything else stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.blocks import dropped_since, known, stored
from folioscope.llm.decontaminate import decontaminate, without_spans
from folioscope.llm.langid import fitted, identify
from folioscope.llm.mixing import mix_sources
from folioscope.llm.neardup import near_duplicates
from folioscope.llm.suffixdedup import repeated_passages


def _packed(docs: DataFrame, *more: str) -> DataFrame:
    """The whole row as one column, so that no name of its clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"), *[F.col(c).alias(f"__{c}") for c in more])


def _retexted(found: DataFrame, columns: list[str], text) -> DataFrame:
    """The packed rows with another text, and its length."""
    put = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[put[c].alias(c) if c in put else F.col(f"__row.`{c}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = fitted(docs)
    if not filters.names:  # no labels to learn from: every text would be und
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(_packed(docs), filters, keep=("__row",), text="__text")
    return found.where(F.col("lang_pred") != "und").select("__row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_duplicates(docs)
    kept = judged.where("kept").select(F.col("doc_id").alias("__id")).distinct()
    stay = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # of rows of equal id one, always the same: most are alone, and only the others are put in order
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = stay.select(F.struct(F.octet_length("text").alias("size"), F.struct(*columns).alias("row")).alias("best"), F.col("doc_id").alias("__id"))
    null = packed.where("__id IS NULL").select("best")
    one = packed.where("__id IS NOT NULL").groupBy("__id").agg(F.max("best").alias("best")).select("best")
    return one.unionByName(null).select(*[F.col(f"best.row.`{c}`").alias(c) for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the text once: not in the packed row
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col("text").isNull().alias("void"))
    found = repeated_passages(docs.select(row.alias("__row"), F.col("text").alias("__text"), F.col("doc_id").alias("__id")), keep=("__row",), key="__id", text="__text", edited=True)
    touched = found.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    text = F.when(~F.col("__row.void"), F.col("kept_text"))
    put = {"text": text, "n_chars": F.length(text).cast("long")}
    return touched.select(*[put[c].alias(c) if c in put else F.col(f"__row.rest.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("__row",), text="__text")
    clean = found.where(F.size("items") < 2)
    return _retexted(clean, docs.columns, without_spans("__row.text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = mix_sources(docs.select("doc_id", "source", "text", row.alias("__row")), carry="__row")
    more = []
    for c in ("n_tokens", "weight", "block", "n_copies"):
        name = c
        while name in docs.columns:
            name = "mix_" + name
        more.append(F.col(c).alias(name))
    return found.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns], *more)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicate),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Components over verified similarity, byte-exact edits and bisected weights are beyond one SQL statement; tests hold stages 1 to 4 against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = known()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped_since(before, docs)
    return docs
