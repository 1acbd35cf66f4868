"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent in
[0, 1], normalised.  Entropy falls and the repetition of small sources falls as
the exponent rises, so bisection finds the smallest exponent that keeps every
source within ``max_repeats`` passes, or the one that meets ``target_entropy``.
Weights become whole-token budgets.  Each source's documents are permuted by a
keyed hash whose leading bits name a block, so a permutation of blocks holds
permuted documents: a budget takes whole passes and then the blocks in order
up to the block in which it ends, and in that block the documents in order.
Only sums of blocks are put in a row, and only that one block is sorted.

Without ``budget_tokens`` the budget is the smallest that passes every source
once at least, so no document is lost.

Defined results: a null source is a source; a text without words costs nothing
and comes once; rows that repeat count each for itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.blocks import ALNUM, map_blocks, stored

STEPS = 60
MAX_DRIVER_SOURCES = 100_000
NULL_SOURCE = "\u0000null"


class Shares:
    """Sums over sources of f(share, exponent): on the driver while there are few sources, as an aggregate else."""

    def __init__(self, totals: DataFrame):
        n, self.tokens = totals.agg(F.count("*"), F.sum("tokens")).first()
        self.tokens = self.tokens or 0
        self.totals = totals
        self.counts = np.array([r[0] for r in totals.select("tokens").where("tokens > 0").collect()], float) if n <= MAX_DRIVER_SOURCES else None
        self.few = n <= MAX_DRIVER_SOURCES

    def entropy_and_norm(self, a: float) -> tuple[float, float]:
        if not self.tokens:
            return 0.0, 1.0
        if self.counts is not None:
            w = np.sort(self.counts / self.tokens) ** a
            z = float(w.sum())
            return float(-(w / z * np.log(w / z)).sum()), z
        w = F.pow(F.col("tokens") / F.lit(float(self.tokens)), F.lit(a))
        z, s = self.totals.where("tokens > 0").agg(F.sum(w), F.sum(w * F.log(w))).first()
        return math.log(z) - s / z, z

    def extremes(self) -> tuple[float, float]:
        low, high = self.totals.where("tokens > 0").agg(F.min("tokens"), F.max("tokens")).first()
        return float(low or 1), float(high or 1)


def exponent(shares: Shares, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The bisected exponent: the entropy's where one is given, and not below the repetition limit's."""
    low, high = shares.extremes()

    def bisect(holds) -> float:
        """Smallest exponent for which holds is true; it is false below and true above."""
        if holds(0.0):
            return 0.0
        a, b = 0.0, 1.0
        for _ in range(STEPS):
            mid = (a + b) / 2
            a, b = (a, mid) if holds(mid) else (mid, b)
        return b

    def repeats(a: float) -> float:
        if budget is None:
            return (high / low) ** (1 - a)
        _, z = shares.entropy_and_norm(a)
        return (low / shares.tokens) ** a / z * budget / low

    found = bisect(lambda a: shares.entropy_and_norm(a)[0] <= target_entropy) if target_entropy is not None else 0.0
    return max(found, bisect(lambda a: repeats(a) <= max_repeats)) if max_repeats is not None else found


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = None, max_repeats: float | None = 4.0, budget_tokens: int | None = None, block_tokens: int = 1 << 14, seed: int = 17, carry: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight (its source's), block, n_copies of each document, and the column named by carry, as carried."""
    own = ["doc_id", "source", "h", *["carried"] * (carry is not None)]
    # the hash takes in the text: rows of equal or null ids lie in many blocks
    named = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.lit(seed), key, text).alias("h"), *[F.col(carry).alias("carried") for _ in own[3:]], F.col(text).alias("__text"))
    counted = map_blocks(named, "__text", own, "n_tokens long", lambda: lambda b: [b.words(ALNUM).counts])
    counted = stored(counted.withColumn("s", F.coalesce("source", F.lit(NULL_SOURCE))), "mix")
    totals = stored(counted.groupBy("s").agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    shares = Shares(totals)
    a = exponent(shares, target_entropy, max_repeats, budget_tokens)
    _, norm = shares.entropy_and_norm(a)
    _, high = shares.extremes()
    whole = float(shares.tokens or 1)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(whole), F.lit(a)) / F.lit(norm)).otherwise(0.0)
    if budget_tokens is None:
        budget = F.greatest("tokens", F.round(F.col("tokens") * F.pow(F.lit(high) / F.greatest("tokens", F.lit(1)), F.lit(1 - a))).cast("long"))
    else:
        budget = F.floor(weight * F.lit(float(budget_tokens))).cast("long")
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("tokens") / F.lit(float(block_tokens)), F.lit(1.0)))))).cast("int")
    plan = totals.select("s", weight.alias("weight"), bits.alias("bits"), F.when(F.col("tokens") > 0, F.floor(budget / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long").alias("passes"), F.when(F.col("tokens") > 0, budget % F.greatest("tokens", F.lit(1))).otherwise(0).alias("rest"))
    block = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0)).cast("long")
    placed = counted.join(plan, "s").withColumn("block", block)
    # 2 ** 16 blocks a source at most
    blocks = placed.groupBy("s", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.withColumn("c", F.sum("t").over(upto)).withColumn("before", F.col("c") - F.col("t")).select("s", "block", F.when(F.col("c") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(-1).alias("state"), (F.col("rest") - F.col("before")).alias("left"))
    known = placed.drop("rest").join(ends, ["s", "block"])
    inside = Window.partitionBy("s", "block").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = known.where("state = -1").withColumn("more", (F.sum("n_tokens").over(inside) <= F.col("left")).cast("long"))
    done = known.where("state >= 0").withColumn("more", F.col("state").cast("long"))
    out = done.unionByName(last)
    copies = F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(F.col("passes") + F.col("more"))
    return out.select("doc_id", "source", "n_tokens", "weight", "block", copies.cast("long").alias("n_copies"), *own[3:])


def realise(plan: DataFrame, seed: int = 17) -> DataFrame:
    """A row for each copy, with its pass and sort keys: order by (pass, block_key, doc_key) to read passes as permutations of blocks."""
    each = plan.where("n_copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return each.withColumn("block_key", F.xxhash64(F.lit(seed), "source", "block", "pass")).withColumn("doc_key", F.xxhash64(F.lit(seed), "doc_id", "pass"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
