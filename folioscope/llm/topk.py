"""Exact top-k by inner product over impact-ordered postings.

Vectors become integers floor(256 * x).  Candidates are dealt into groups of
about ``group_rows``; a group's index holds, for each impact (the bit length of
a value) and dimension, a posting list of the vectors that have such a value
there.  Queries are dealt into sets of about ``query_rows``; a set meets a group
in one task, which builds the group's index once and then takes the set's
queries as they come, CHUNK at a time.  Posting lists are processed by
descending impact; where an impact's lists are long, they are laid into a slab
of rows and dimensions and added for all queries of a chunk by one product, and
list by list else.  After an impact the unprocessed rest of vector v cannot
change a query's score by more than |q| * |rest(v)|; a query stops once its k-th
best lower bound leaves few enough vectors whose upper bound reaches it, and
those are rescored exactly from the whole vectors, in Python's integers where
64 bits might not do.  Nothing else ends a query but the last impact.  Bounds
allow for the rounding of the running sums.

Defined results: rows with a null id, and vectors that are null or hold null or
non-finite components, take no part; of vectors with different lengths the
shorter is padded with zeros, an empty one too; rows with the query's id count
as its own; rows of equal id are queries and candidates each for themselves;
ranks go by exact scores, and a score outside of 64 bits is given as the nearest
number within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.blocks import lean, small_batches

CHUNK = 128
SLAB_ROWS = 2048
LONG = np.iinfo(np.int64)


class Postings:
    """Whole-number vectors, held as floats, by descending impact."""

    def __init__(self, v: np.ndarray, vid: np.ndarray):
        self.v, self.vid = v, vid
        row, dim = np.nonzero(v)
        impact = np.frexp(np.abs(v[row, dim]))[1]
        order = np.lexsort((row, dim, -impact))
        self.row, dim, impact = row[order], dim[order], impact[order]
        self.value = v[self.row, dim]
        new = np.ones(len(order), bool)
        new[1:] = (dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1])
        heads = np.flatnonzero(new)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (v**2).sum(1)
        self.norm, rest = np.sqrt(squares), squares.copy()
        #: for each impact the norms of what is left after it, and its posting lists (dimension, first, end)
        self.impacts: list[tuple[np.ndarray, list[tuple[int, int, int]]]] = []
        ends = np.append(heads[1:], len(order))
        levels = impact[heads]
        for level in sorted(set(levels.tolist()), reverse=True):
            own = np.flatnonzero(levels == level)
            a, b = int(heads[own[0]]), int(ends[own[-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                rest = rest - np.bincount(self.row[a:b], weights=self.value[a:b] ** 2, minlength=len(v))
            left = np.sqrt(np.maximum(rest, 0) + 1e-12 * squares)
            self.impacts.append((left, [(int(dim[heads[i]]), int(heads[i]), int(ends[i])) for i in own]))
        if not self.impacts:
            self.impacts.append((np.zeros(len(v)), []))
        self.order = np.argsort(vid, kind="stable")
        self.sorted = vid[self.order]

    def add(self, score: np.ndarray, lists: list[tuple[int, int, int]], part: np.ndarray) -> None:
        """Adds an impact's lists to the scores (vector, query); by list where most places of a slab would be empty."""
        m = len(score)
        if sum(b - a for _, a, b in lists) * 32 < m * len(lists):
            for dim, a, b in lists:
                score[self.row[a:b]] += self.value[a:b, None] * part[None, :, dim]
            return
        by_dim = np.ascontiguousarray(part[:, [dim for dim, _, _ in lists]].T)
        for lo in range(0, m, SLAB_ROWS):
            hi = min(lo + SLAB_ROWS, m)
            slab = np.zeros((hi - lo, len(lists)))
            for i, (_, a, b) in enumerate(lists):
                c, e = a + np.searchsorted(self.row[a:b], [lo, hi])
                slab[self.row[c:e] - lo, i] = self.value[c:e]
            score[lo:hi] += slab @ by_dim

    def own(self, x: int) -> np.ndarray:
        """Rows of that id."""
        return self.order[np.searchsorted(self.sorted, x, "left") : np.searchsorted(self.sorted, x, "right")]


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as floats."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    if most < 2.0**53:
        return (v @ q).astype(np.int64)
    if most < 2.0**62 and max(np.abs(v).max(initial=0), np.abs(q).max(initial=0)) < 2.0**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q.tolist()]
    out = np.empty(len(v), object)
    out[:] = [sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in v.tolist()]
    return out


def search(index: Postings, q: np.ndarray, qid: np.ndarray, k: int, few: float = 0.01) -> list[tuple[np.ndarray, list[int]]]:
    """For each query the rows of the index that may be among its k best, and their exact scores."""
    v, m = index.v, len(index.v)
    with np.errstate(over="ignore", invalid="ignore"):
        # infinite or undefined where norms are beyond floats
        whole = np.isfinite(index.norm.max(initial=0) * np.sqrt((q**2).sum(1)))
    usual, out = index.norm.mean(), []
    for at in range(0, len(q), CHUNK):
        own = q[at : at + CHUNK]
        found: list = [None] * len(own)
        live = np.flatnonzero(whole[at : at + CHUNK])
        part = own[live]
        norm = np.sqrt((part**2).sum(1))
        score = np.zeros((m, len(live)))
        for i, j in enumerate(live.tolist()):
            score[index.own(int(qid[at + j])), i] = -np.inf
        for n, (left, lists) in enumerate(index.impacts, 1):
            index.add(score, lists, part)
            last = n == len(index.impacts)
            if not last and left.mean() > 0.2 * usual:
                continue
            slack = ((0 if last else left) + index.norm * (v.shape[1] + 64) * 2.0**-50)[:, None] * norm[None, :]
            low = score - slack
            bar = np.partition(low, m - k, 0)[m - k] if m > k else np.full(len(live), -np.inf)
            reach = (score + slack >= bar) & (score > -np.inf)
            done = np.full(len(live), last) | (reach.sum(0) <= max(4 * k, few * m))
            for i in np.flatnonzero(done):
                found[live[i]] = np.flatnonzero(reach[:, i])
            live, part, norm, score = live[~done], part[~done], norm[~done], score[:, ~done]
            if not len(live):
                break
        for i, rows in enumerate(found):
            if rows is None:  # norms beyond any float: all are rescored
                rows = np.setdiff1d(np.arange(m), index.own(int(qid[at + i])))
            exact = inner(v[rows], own[i]).tolist()
            ids = index.vid[rows].tolist()
            best = sorted(range(len(rows)), key=lambda r: (-exact[r], ids[r]))[:k]
            out.append((rows[best], [exact[r] for r in best]))
    return out


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component, exact as floats; lists cut or padded to width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    some = place < width
    out[row[some], place[some]] = flat[some]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", group_rows: int = 16384, query_rows: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates."""
    small_batches(vectors.sparkSession)
    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wide = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row")]
    cand, ask = vectors.where(fit).select(*wide), queries.where(fit).select(*wide)
    groups = max(1, -(-vectors.count() // group_rows))
    sets = max(1, -(-queries.count() // query_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = cand.select(F.lit(0).alias("kind"), "row", "id", "v", deal(groups, 1).alias("g"), every(sets).alias("s"))
    ask = ask.select(F.lit(1).alias("kind"), "row", "id", "v", every(groups).alias("g"), deal(sets, 2).alias("s"))
    met = cand.unionByName(ask).select((F.col("g") * sets + F.col("s")).cast("long").alias("gid"), "kind", "row", "id", "v")
    placed = met.repartition(min(groups * sets, 1 << 15), "gid").sortWithinPartitions("gid", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, held, index = None, [], None
        for batch in batches:
            gid, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((gid[1:] != gid[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(gid)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if gid[a] != now:
                    now, held, index = gid[a], [], None
                if not kind[a]:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    width = max(int(np.diff(p.column(4).offsets.to_numpy()).max(initial=0)) for p in held)
                    index = Postings(np.concatenate([whole_numbers(p.column(4), width) for p in held]), np.concatenate([p.column(3).to_numpy() for p in held]))
                    held = []
                qid = part.column(3).to_numpy()
                found = search(index, whole_numbers(part.column(4), index.v.shape[1]), qid, k)
                n = [len(r) for r, _ in found]
                score = [min(max(x, LONG.min), LONG.max) for _, s in found for x in s]
                # of scores beyond 64 bits, what is beyond: its number of digits and digits
                more = [abs(x) - LONG.max for _, s in found for x in s]
                beyond = [f"{len(str(x)):06d}{x}" if x > 0 else "" for x in more]
                at = np.concatenate([r for r, _ in found]).astype(np.int64)
                cols = [pa.array(np.repeat(part.column(2).to_numpy(), n), pa.int64()), pa.array(np.repeat(qid, n), pa.int64()), pa.array(index.vid[at], pa.int64()), pa.array(score, pa.int64()), pa.array(beyond, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "query_id", "vec_id", "score", "beyond"])

    made = placed.mapInArrow(run, "row long, query_id long, vec_id long, score long, beyond string")
    # negative scores beyond 64 bits: the less beyond the better
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.desc(F.when(F.col("score") > 0, F.col("beyond"))), F.when(F.col("score") < 0, F.col("beyond")), "vec_id")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
