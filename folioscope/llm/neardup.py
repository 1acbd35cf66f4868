"""Near duplicates by SetSketch registers, confirmed on full shingle sets.

A text's set holds the 64-bit hashes of its distinct word shingles.  Every
element is a Poisson process of points, each with a register and a value; a
register keeps the smallest value, truncated to a power of BASE.  Registers of
a union are the larger of the parts' registers, and two sets agree in a
register with a probability just over their similarity.  Points beyond the
value that all registers of a set of this size fall under but with probability
exp(-SLACK) are never made.

Sets that are equal are one node (their smallest id).  BANDS bands of WIDTH
registers deal nodes to buckets; a pair at 0.75 shares none with probability
(1 - 0.75**5)**51 = 1e-6.  Each node is held against two pivots among its
buckets, which joins most copies; then all pairs that share a bucket but not a
component are judged, in tiles of bounded size, in the first bucket they share:
a bucket's nodes outside of its largest component meet all of its nodes, and no
two nodes within that component meet.
A joint likelihood of the registers with the known set sizes rules out pairs
far below the threshold (a statistic over LR, five sigma and more); all others
are confirmed on their full sets.  No pair but a confirmed link leaves a task as a row, and
no bucket is cut short.

Defined results: null and empty texts have an empty set and stay by
themselves; a row with null id takes no part (component_id null, kept true);
rows of equal id are one node that has the links of each of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import SOLID, Block, blocks, dropped_since, known, lean, map_blocks, mix, small_batches, stored
from folioscope.llm.groups import components, map_groups

WORDS = 5
REGISTERS = 256
WIDTH, BANDS = 5, 51
BASE = 1.08
OFFSET = 40
SLACK = 7.0
LR = 26.0
TILE = 1024
SMALL = 48
PAIRS = 1 << 14  # that a partition confirms
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(block: Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, in order, and each text's bounds."""
    words = block.words(SOLID)
    bounds = np.zeros(len(block) + 1, np.int64)
    if not len(words):
        return np.empty(0, np.uint64), bounds
    hashes = words.hashes
    grams = words.grams(hashes, n)
    at = np.flatnonzero(words.whole(n))
    h, owner = grams[at], np.searchsorted(words.bounds, at, "right") - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        from folioscope.llm.blocks import running, span_hash

        h = np.concatenate([h, span_hash(running(hashes), words.bounds[few], words.bounds[few + 1])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(block) + 1))


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of truncated minima for each set."""
    sizes = np.diff(bounds)
    low = np.full(len(sizes) * REGISTERS, np.inf)
    limit = (math.log(REGISTERS) + SLACK) / np.maximum(sizes, 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for part, wide in ((sizes[owner] >= SMALL, 1), (sizes[owner] < SMALL, 64)):
        e, own = h[part], owner[part]
        x, step = np.zeros(len(e)), 0
        while len(e):
            count = np.arange(step + 1, step + 1 + wide, dtype=np.uint64) * GOLD
            state = mix((e[:, None] + count[None, :]).ravel()).reshape(len(e), wide)
            gap = -np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / REGISTERS
            point = x[:, None] + (np.cumsum(gap, 1) if wide > 1 else gap)
            good = point <= limit[own][:, None]
            slot = (own[:, None] * REGISTERS + ((state & np.uint64(2047)).astype(np.int64) * REGISTERS >> 11))[good]
            np.minimum.at(low, slot, point[good])
            alive = good[:, -1]
            e, own, x, step = e[alive], own[alive], point[alive, -1], step + wide
    with np.errstate(divide="ignore"):
        k = np.floor(-np.log(low) / math.log(BASE)) + OFFSET
    return np.clip(np.where(np.isfinite(low), k, 0), 0, 255).astype(np.uint8).reshape(len(sizes), REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    parts = regs[:, : BANDS * WIDTH].reshape(len(regs), BANDS, WIDTH).astype(np.uint64)
    word = np.zeros((len(regs), BANDS), np.uint64)
    for i in range(WIDTH):
        word = (word << np.uint64(8)) | parts[:, :, i]
    return mix(word ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD)).view(np.int64)


def _agree(x: np.ndarray) -> np.ndarray:
    """p_b of the register comparison."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def statistic(above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    """Twice the log likelihood by which the best similarity beats the best one of at least threshold."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    most = np.minimum(u / v, v / u)
    equal = REGISTERS - above - below
    best, within = np.full(len(n1), -np.inf), np.full(len(n1), -np.inf)
    for f in np.linspace(0, 1, 41):
        for start, out in ((np.zeros(len(n1)), best), (np.minimum(threshold, most), within)):
            j = start + f * (most - start)
            p1, p2 = np.clip(_agree(u - v * j), 1e-9, 1), np.clip(_agree(v - u * j), 1e-9, 1)
            p0 = np.clip(1 - p1 - p2, 1e-9, 1)
            np.maximum(out, above * np.log(p1) + below * np.log(p2) + equal * np.log(p0), out=out)
    return 2 * (np.maximum(best, within) - within)


def candidate_pairs(band: int, ids: np.ndarray, comp: np.ndarray, minor: np.ndarray, n: np.ndarray, regs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right rows in different components that this band is the first to bring together and that registers do not rule out; of two in the minority, that from the smaller id."""
    keep_a, keep_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in left:
        other = right[(comp[right] != comp[i]) & (~minor[right] | (ids[right] > ids[i]))]
        lo, hi = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
        other = other[lo >= threshold * hi - 1e-9]
        if not len(other):
            continue
        equal = regs[other] == regs[i]
        met = equal[:, : band * WIDTH].reshape(len(other), band, WIDTH).all(2).any(1) if band else np.zeros(len(other), bool)
        other, equal = other[~met], equal[~met]
        # far pairs go before the likelihood is worked out
        other = other[equal.sum(1) >= 0.5 * threshold * REGISTERS]
        if not len(other):
            continue
        above, below = (regs[i] > regs[other]).sum(1), (regs[i] < regs[other]).sum(1)
        other = other[statistic(above, below, np.full(len(other), float(n[i])), n[other].astype(float), threshold) <= LR]
        keep_a.append(np.full(len(other), i))
        keep_b.append(other)
    return np.concatenate(keep_a), np.concatenate(keep_b)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n, s1, s2 (the set's identity), regs."""

    def fn(block: Block) -> list:
        h, bounds = shingle_sets(block)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ GOLD), out=total[1:])
        other = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, out=other[1:])
        s1, s2 = total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
        regs = registers(h, bounds)
        return [np.diff(bounds), s1.view(np.int64), s2.view(np.int64), [r.tobytes() for r in regs]]

    return map_blocks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text")), "__text", ["doc_id"], "n long, s1 long, s2 long, regs binary", lambda: fn)


def full_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, bits: int = 25) -> DataFrame:
    """id and set of each of ids.  A bitmap of at most 2 ** bits ids' hashes lets the scan leave out most other texts."""
    spark = docs.sparkSession
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    rows = ids.select(spot("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # 2 ** (bits - 15) rows of 4 KiB at most
    front = np.zeros((1 << bits) // 8 + 8192, np.uint8)
    for r in rows:
        at = max(0, r["b"] * 4096) if r["b"] >= 0 else 0
        front[at : at + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)
    shared = spark.sparkContext.broadcast(front)
    # bit of a spot, as bitmap_bucket_number and bitmap_bit_position have it
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")
    source = source.select("id", "t", F.bitmap_bucket_number(spot("id")).alias("b"), F.bitmap_bit_position(spot("id")).alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bitmap = shared.value
        for batch in batches:
            b, i = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            there = (bitmap[np.maximum(b, 0) * 4096 + (i >> 3)] >> (i & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(there))
            for lo, hi, block in blocks(batch.column(1)):
                h, bounds = shingle_sets(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "set"])

    return source.mapInArrow(run, "id long, set binary").join(ids.select("id").distinct(), "id", "left_semi")


def _pivot_edges(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Each node with two of its buckets' pivots, the smallest id and the smallest hash, as far as registers do not rule them out."""
    out = None
    for rank in (F.col("id"), F.xxhash64("id", F.lit(1))):
        ranked = members.select("bucket", "id", rank.alias("rank"))
        pivots = ranked.groupBy("bucket").agg(F.min(F.struct("rank", F.col("id").alias("p"))).alias("x"))
        edges = members.join(pivots, "bucket").where("id <> x.p").groupBy("id").agg(F.min("x").alias("x")).select("id", F.col("x.p").alias("p"))
        out = edges if out is None else out.unionByName(edges)
    side = lambda name, n, regs: reps.groupBy("doc_id").agg(F.first("n").alias(n), F.first("regs").alias(regs), F.count("*").alias(f"{n}_sets")).withColumnRenamed("doc_id", name)
    seen = out.distinct().join(side("id", "n1", "r1"), "id").join(side("p", "n2", "r2"), "p").select("id", "p", "n1", "n2", "r1", "r2", ((F.col("n1_sets") > 1) | (F.col("n2_sets") > 1)).alias("several"))
    threshold = percent / 100

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            if batch.num_rows:
                n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                r1, r2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (4, 5))
                near = (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9) & (statistic((r1 > r2).sum(1), (r1 < r2).sum(1), n1.astype(float), n2.astype(float), threshold) <= LR)
                keep = near | batch.column(6).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "p"]).filter(pa.array(keep))

    return seen.mapInArrow(far, "id long, p long")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    judged = edges.join(sets, "id").select("id", "p", F.col("set").alias("x")).join(sets.select(F.col("id").alias("p"), F.col("set").alias("y")), "p").select("id", "p", "x", "y")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return judged.mapInArrow(judge, "a long, b long")


def _tiled_links(members: DataFrame, labels: DataFrame, reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Confirmed links between components, over all pairs of their nodes that share a bucket."""
    seen = members.join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("comp", "id").alias("comp"))
    held = seen.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("size")).where("size > most.k")
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    mixed = held.select("bucket", F.col("most.comp").alias("major"), tiles(F.col("size")).alias("tiles"), tiles(F.col("size") - F.col("most.k")).alias("few"))
    shared = seen.join(mixed, "bucket").withColumn("minor", F.col("comp") != F.col("major"))
    spot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a tile: all nodes of one part of the bucket, and nodes of the minority of another
    there = shared.select("bucket", "band", "id", "comp", "minor", F.lit(False).alias("visits"), spot("tiles", 1).alias("u"), each("few").alias("w"))
    come = shared.where("minor").select("bucket", "band", "id", "comp", "minor", F.lit(True).alias("visits"), each("tiles").alias("u"), spot("few", 2).alias("w"))
    placed = there.unionByName(come).select(F.xxhash64("bucket", "u", "w").alias("gid"), "band", "id", "comp", "minor", "visits")
    placed = placed.join(reps.select(F.col("doc_id").alias("id"), "n", "regs"), "id")
    threshold = percent / 100

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        col = {k: t.column(k).to_numpy() for k in ("gid", "band", "id", "comp", "n", "minor", "visits")}
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint8).reshape(t.num_rows, REGISTERS)
        rows = np.arange(t.num_rows)
        a, b = candidate_pairs(int(col["band"][0]), col["id"], col["comp"], col["minor"], col["n"], regs, rows[col["visits"]], rows[~col["visits"]], threshold)
        if len(a):
            gid, ids, comp = int(col["gid"][0]), col["id"], col["comp"]
            used = np.unique(np.concatenate([a, b]))
            slot = np.zeros(t.num_rows, np.int32)
            slot[used] = np.arange(len(used))
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([ids[used].tolist()], pa.list_(pa.int64())), pa.array([comp[used].tolist()], pa.list_(pa.int64())), pa.array([np.stack([slot[a], slot[b]], 1).astype(np.int32).tobytes()], pa.binary())], names=["gid", "ids", "comps", "pairs"])

    found = stored(map_groups(placed, ["gid"], pairs, "gid long, ids array<long>, comps array<long>, pairs binary"), "tiles")
    # the work is in the pairs and not in the bytes: partitions go by their number
    work = found.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0
    parts = int(min(max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), work // (8 * PAIRS)), 1 << 15))
    ids = found.select("gid", F.posexplode("ids").alias("pos", "id"))
    sets = sets_of(ids.select("id").distinct())
    wanted = found.select("gid", F.posexplode("ids").alias("pos", "id")).join(sets, "id").select("gid", F.lit(1).alias("kind"), "pos", "id", F.col("set").alias("data"), F.lit(None).cast("array<long>").alias("comps"))
    heads = found.select("gid", F.lit(0).alias("kind"), F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("id"), F.col("pairs").alias("data"), "comps")

    def confirm(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, pos = t.column("kind").to_numpy(), t.column("pos").to_numpy()
        head = int(np.flatnonzero(kind == 0)[0])
        todo = np.frombuffer(t.column("data")[head].as_py(), np.int32).reshape(-1, 2)
        parent = {c: c for c in t.column("comps")[head].as_py()}
        comp = t.column("comps")[head].as_py()

        def top(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sets_of: dict[int, list] = {}
        name = {}
        ids, data = t.column("id").to_pylist(), t.column("data")
        for r in np.flatnonzero(kind == 1).tolist():
            sets_of.setdefault(int(pos[r]), []).append(np.frombuffer(data[r].as_py(), np.uint64))
            name[int(pos[r])] = ids[r]
        a, b = [], []
        for i, j in todo.tolist():
            x, y = top(comp[i]), top(comp[j])
            if x != y and any(linked(p, q, percent) for p in sets_of.get(i, []) for q in sets_of.get(j, [])):
                parent[x] = y
                a.append(name[i])
                b.append(name[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_groups(heads.unionByName(wanted), ["gid"], confirm, "a long, b long", order=["kind"], parts=parts)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    small_batches(docs.sparkSession)
    before = known()
    made = stored(sketches(docs, key, text), "sketches")
    some = made.where("doc_id is not null and n > 0")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = stored(some.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc_id", "rep", "n").distinct(), "member")
    reps = stored(some.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "s1", "s2"]), "reps")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(keys)))], names=["id", "bucket", "band"])

    bands = reps.select("doc_id", "regs").mapInArrow(explode, "id long, bucket long, band byte")
    many = bands.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    members = stored(bands.join(many, "bucket").distinct(), "members")
    sets_of = lambda ids: stored(full_sets(docs, key, text, ids), "sets")
    # rows of equal id make links of their own: their classes' representatives
    links = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(reps.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")
    edges = stored(_pivot_edges(members, reps, percent), "edges")
    sets = sets_of(edges.select("id").union(edges.select("p")).distinct())
    # links are few beside what finds them: dealt anew, they fill one file where the tasks would write one each
    few = lambda links: stored(links.repartition("a", "b"), "links")
    links = few(links.unionByName(_confirmed(edges, sets, percent)))
    labels = components(links)
    links = few(links.unionByName(_tiled_links(members, labels, reps, sets_of, percent)))
    labels = components(links)
    dropped_since(before, made, member, labels)
    placed = member.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = made.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""
