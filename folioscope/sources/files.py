"""Directory scans, digests, and a cache of extracted files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READER_VERSION = "0.2.5"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "docx"), recursive: bool = True, content: bool = False) -> DataFrame:
    """relative_path, title, format, sha256 (and content) of the files below root; the digest is only worked out where it is selected."""
    kinds = ",".join(f"{s},{s.upper()}" for s in suffixes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kinds}}}").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    decoded = F.try_url_decode(F.replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    relative = F.expr(f"substring(p, instr(p, '{base}/') + {len(base) + 1})")
    out = files.withColumn("p", decoded).withColumn("relative_path", relative)
    cols = ["relative_path", F.regexp_extract("relative_path", r"([^/]*)\.[^./]*$", 1).alias("title"), F.lower(F.regexp_extract("relative_path", r"\.([^./]*)$", 1)).alias("format"), F.sha2("content", 256).alias("sha256")]
    return out.select(*cols, *(["content"] if content else []))


def source_id(path):
    """Column: the id that a source has from its path."""
    return F.concat(F.lit("S-"), F.substring(F.sha2(path, 256), 1, 16))


def with_cache_key(files: DataFrame, ocr: str = "none", pages: list[int] | None = None, language: str = "zh-Hans-CN") -> DataFrame:
    """files with cache_key: a digest of the reader's version, the content and the options."""
    import json

    tail = json.dumps([ocr, pages, language])
    return files.withColumn("cache_key", F.sha2(F.concat(F.lit(json.dumps(READER_VERSION)), F.lit("|"), "sha256", F.lit("|" + tail)), 256))


def new_work(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files of which the cache has no extraction."""
    return files.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def from_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached extractions under the names that the files have now."""
    named = files.select("cache_key", "relative_path", "title", source_id(F.col("relative_path")).alias("source_id"))
    return cache.drop("relative_path", "title", "source_id").join(named, "cache_key").withColumn("cache_hit", F.lit(True))
