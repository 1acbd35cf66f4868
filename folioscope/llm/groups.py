"""Grouped passes over sorted partitions, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import dropped, lean, stored


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """fn over each run of equal keys[0] values, which sit in one partition in order; far cheaper for many small groups than one call of Spark's each."""
    placed = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    placed = placed.sortWithinPartitions(*keys, *(order or []))
    first = keys[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.names.index(first)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column(batch.schema.names.index(first))[-1].as_py() != key[0]:
                yield from fn(pa.Table.from_batches(held))
                held = []
            lo = 0
            for hi in cuts.tolist():
                held.append(batch.slice(lo, hi - lo))
                yield from fn(pa.Table.from_batches(held))
                held, lo = [], hi
            held.append(batch.slice(lo))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return placed.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """id and comp (and old, which is the same), the smallest id reachable, for every id of the edges (a, b).

    Labels point to smaller ids of the same component.  Each round hands the
    smallest label among a node's neighbours to the node and to the node that
    its label names, then every node takes the label of its label (Liu and
    Tarjan's extended connect with shortcutting).  It ends when no label moves,
    and only then; labels only fall, so it does end.  Paths of a million nodes
    whose ids rise, fall, alternate or are shuffled took 18 to 21 rounds in a
    simulation.  Labels and edges stay in tables; only a count comes to the
    driver.
    """
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # for the node itself, and for the node that its label names
        given = step.select(F.explode(F.array(F.struct("id", "old", "comp"), F.struct(F.col("old").alias("id"), F.lit(None).cast(labels.schema["id"].dataType).alias("old"), "comp"))).alias("x")).select("x.*")
        lowered = stored(given.groupBy("id").agg(F.min("old").alias("old"), F.min("comp").alias("comp")), "labels")
        hop = lowered.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        moved = stored(lowered.join(hop, "comp").select("id", "old", F.col("next").alias("comp")), "labels")
        dropped(before, lowered)
        labels, before = moved.select("id", "comp"), moved
        if not moved.where("old <> comp").limit(1).count():
            dropped(both)
            return moved
