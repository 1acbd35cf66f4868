"""Removal of repeated passages, exact to the byte, by suffix arrays.

A byte goes if a string of LENGTH bytes around it also starts in a document
with a smaller id.  Suffix arrays of all the text would have to be compared
shard with shard, so the text is first cut where equal strings must agree:

1.  Every LENGTH bytes pick the smallest hash among their GRAM-byte strings
    (winnowing), so equal strings pick the same one.  Consecutive strings that
    pick the same place make a context: its bytes, its pick, its strings.  All
    places of a string lie in contexts of the same pick.
2.  Equal contexts need no comparison: all but those of the smallest document
    go whole.  Documents are dealt to blocks by a hash of id and text; a block
    sends each distinct context once, with its smallest document and its place
    in the block, to the bucket of its pick, so a passage that everyone has
    arrives once from each block.  Picks of very many contexts are found
    beforehand on a sample of documents and dealt to buckets by context.  All
    contexts at once need more disk than their texts, so PASSES turns take a
    part of the picks each; of many blocks, several send together, as rows
    grow with senders times buckets.
3.  Contexts of one pick that differ can share strings only if they agree in
    SIDE bytes on one side of the pick.  One copy of each such context is cut
    from its block, at the place sent, and goes to a shard.  The shard builds
    the suffix array of its contexts (Larsson-Sadakane refinement: groups that
    are not yet single are sorted by the ranks h bytes on), the common prefixes
    by Kasai's rule, and so the distinct strings with their smallest documents.
    A pick's contexts stay in one shard; if they are too many, those that agree
    on the left side do, and those that agree on the right one.  Where even
    these fill several shards, each shard sends its distinct strings, in suffix
    order and dealt by their hash into ranges; a range merges the shards' runs
    by binary search on the strings' bytes, and tells shards where another one
    has a smaller document.
4.  Blocks take back the contexts that a smaller document elsewhere has and the
    strings found in shards, both by place, mark the bytes, and cut them out.

Equality of whole contexts is that of 96 bits of hash (pick and content); all
else is decided on bytes.

Defined results: null text is empty; texts under LENGTH bytes keep everything; a
null id counts as larger than any other; rows of equal id never remove each
other; other columns, of whatever names, are those of keep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioscope.llm.blocks import Block, blocks, buffers, lean, mix, powers, raw_prefix, small_batches, span_hash, stored
from folioscope.llm.groups import map_groups

LENGTH = 50
GRAM = 18
SIDE = (LENGTH - GRAM) // 2
PASSES = 2  # turns that contexts are sent in, by pick
SHARD = 1 << 12  # contexts that a shard takes of one bucket, and what a pick has beyond them
GANG = 3  # at most 2 ** GANG blocks send together
PART = 1 << 16  # bytes of text that are hashed at once: few enough that their arrays stay in the cache, and on the heap
CELL = 512  # strings, or places of strings, in one row on the way
SAMPLE = 64  # picks of very many contexts are looked for in one document of so many
HOT = 1 << 16  # contexts that make a pick one of these
TOP = 4096  # picks that a partition of the sample reports
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
GOLD = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.uint64(0xFFFFFFFF)
AT = np.uint64(40)  # bits of a place in a block; above them, the block's number in its gang
#: A context as blocks and buckets know it: hashes of pick and content (48 bits each), smallest document, place, number of strings, hashes of the sides (0: not within the context).
KEY = np.dtype([("fp", "<u8"), ("ch", "<u8"), ("doc", "<i8"), ("at", "<u8"), ("n", "u1"), ("left", "u1"), ("right", "u1")])
#: A context as shards know it.
PIECE = np.dtype([("at", "<u8"), ("doc", "<i8"), ("n", "u1")])
#: A place of a shard's string.
PLACE = np.dtype([("sid", "<i4"), ("blk", "<i4"), ("at", "<u8"), ("doc", "<i8"), ("number", "u1")])
#: A distinct string of a shard.
MEMBER = np.dtype([("sid", "<i4"), ("doc", "<i8")])
FP_BITS, CH_BITS = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0x0000FFFFFFFFFFFF)
# bytes of KEY that hold anything: the upper six of fp, the lower six of ch, all of doc, the lower six of at, and the rest
_HELD = [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, *range(16, 24), *range(24, 30), 32, 33, 34]


def pack(keys: np.ndarray) -> bytes:
    """Keys byte by byte, equal places together, which leaves shuffle compression little but hashes."""
    return keys.view(np.uint8).reshape(len(keys), KEY.itemsize).T[_HELD].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(len(_HELD), -1)
    out = np.zeros((planes.shape[1], KEY.itemsize), np.uint8)
    out[:, _HELD] = planes.T
    return out.view(KEY).reshape(-1)


def contexts(block: Block, sides: bool = True, turn: int | None = None) -> dict[str, np.ndarray]:
    """The contexts of a block's texts (or those of a turn's picks), by place: text, start (in the block), n, off, fp, ch, and if wanted left, right."""
    data, offs = block.data, block.offs
    n, w = len(data), LENGTH - GRAM + 1
    empty = {k: np.empty(0, t) for k, t in (("text", np.int64), ("start", np.int64), ("n", np.int64), ("off", np.int64), ("fp", np.uint64), ("ch", np.uint64), ("left", np.uint8), ("right", np.uint8))}
    if n < LENGTH:
        return empty
    # strings within one text
    good = np.ones(n - LENGTH + 1, bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        good[max(a, b - LENGTH + 1) : b] = False
    if not good.any():
        return empty
    prefix = raw_prefix(data)
    m = n - GRAM + 1
    gram = prefix[GRAM:] - prefix[:m]
    gram *= powers(n + 1)[1][:m]
    # half a hash to go by, and half a place: of equal halves the first is picked
    low = gram * GOLD
    low &= ~PLACES
    low |= np.arange(m, dtype=np.uint64)
    done = 1
    while done * 2 <= w:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < w:
        low = np.minimum(low[: len(low) - (w - done)], low[w - done :])
    pick = (low & PLACES).astype(np.int64)
    moved = pick[1:] != pick[:-1]
    new, stop = good.copy(), good.copy()
    new[1:] &= ~good[:-1] | moved
    stop[:-1] &= ~good[1:] | moved
    start = np.flatnonzero(new)
    count = np.flatnonzero(stop) - start + 1
    p = pick[start]
    fp = mix(gram[p]) & FP_BITS
    if turn is not None:
        some = np.flatnonzero((fp >> np.uint64(16)) % np.uint64(PASSES) == np.uint64(turn))
        start, count, p, fp = start[some], count[some], p[some], fp[some]
    off = p - start
    end = start + count - 1 + LENGTH
    ch = mix(span_hash(prefix, start, end) + off.astype(np.uint64) * GOLD) & CH_BITS

    def side(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        value = span_hash(prefix, np.maximum(lo, 0), np.minimum(hi, n)) % np.uint64(255) + np.uint64(1)
        return np.where((lo >= start) & (hi <= end), value, np.uint64(0)).astype(np.uint8)

    text = np.searchsorted(offs, start, "right") - 1
    out = {"text": text, "start": start, "n": count, "off": off, "fp": fp, "ch": ch}
    return out | {"left": side(p - SIDE, p), "right": side(p + GRAM, p + GRAM + SIDE)} if sides else out


def _pieces_of(column: pa.ChunkedArray) -> Iterator[tuple[int, int, int, Block]]:
    """Row ranges of a column with the place of their first byte in it, and their blocks."""
    row = base = 0
    for chunk in column.chunks:
        for lo, hi, block in blocks(chunk, PART):
            yield row + lo, row + hi, base, block
            base += len(block.data)
        row += len(chunk)


def _spread(fp: np.ndarray, ch: np.ndarray) -> np.ndarray:
    return mix(fp ^ mix(ch))


def _homes(fp: np.ndarray, ch: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Bucket of each context, that of its pick or, for picks of very many, one of as many more; below it, bits that bring equal contexts together."""
    h = _spread(fp, ch)
    home = fp >> np.uint64(64 - bits)
    if len(hot):
        there = hot[np.minimum(np.searchsorted(hot, fp), len(hot) - 1)] == fp
        home = np.where(there, np.uint64(1 << bits) + (h >> np.uint64(64 - bits)), home)
    return (home << np.uint64(63 - bits)) | (h >> np.uint64(bits + 1))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spans(new: np.ndarray) -> list[tuple[int, int]]:
    """The runs that begin where new says."""
    edges = [*np.flatnonzero(new).tolist(), len(new)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _classes(fp: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal contexts are neighbours, and where a new one begins."""
    h = _spread(fp, ch)
    order = np.argsort(h, kind="stable")
    new = _changes(fp[order], ch[order])
    if (new & ~_changes(h[order])).any():  # a hash of two contexts
        order = np.lexsort((ch, fp))
        new = _changes(fp[order], ch[order])
    return order, new


def suffix_array(data: np.ndarray, depth: int, stop: np.ndarray) -> np.ndarray:
    """Order of all suffixes by their first depth bytes up to stop, the end of the piece that each begins in, and then by place."""
    n = len(data)
    word = _words(data)[:n]
    short = np.flatnonzero(stop - np.arange(n) < 7)
    left = (stop[short] - short + 1).astype(np.uint64) * np.uint64(8)
    word[short] &= ~((np.uint64(1) << (np.uint64(64) - left)) - np.uint64(1))
    order = np.argsort(word, kind="stable")
    new = _changes(word[order])
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        step = min(h, depth - h)
        # places of groups with more than one suffix
        alone = np.ones(n + 1, bool)
        alone[:n] = new
        open_ = np.flatnonzero(~(alone[:n] & alone[1:]))
        if not len(open_):
            break
        suffix = order[open_]
        ahead = suffix + step
        far = np.where(ahead <= stop[suffix], group[np.minimum(ahead, n - 1)], -1)
        own = group[suffix]
        # groups stand in order already: one sort by both ranks
        again = np.argsort(own * (n + 1) + far + 1, kind="stable")
        order[open_] = suffix[again]
        new[open_] = _changes(own[again], far[again])
        ranks = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        group[order[open_]] = ranks[open_]
        h += step
    return order


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, and one place more, the first as the highest; zeros after the end."""
    word = np.zeros(len(data) + 8, np.uint64)
    word[: len(data)] = data
    for k in (1, 2, 4):
        word[:-k] = (word[:-k] << np.uint64(8 * k)) | word[k:]
        word[-k:] <<= np.uint64(8 * k)
    return word[: len(data) + 1]


_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to its piece's end, which a byte that no piece has follows.

    Pieces run abreast: at step k each takes its k-th suffix and begins with the
    length that the step before it found, less one; eight bytes are compared at once.
    """
    n = len(data)
    word = _words(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    held = np.zeros(len(starts), np.int64)
    sizes = ends - starts
    lanes = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[lanes], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    for k, m in enumerate(active.tolist()):
        lane = lanes[:m]
        i = starts[lane] + k
        here = place[i]
        j = order[np.maximum(here - 1, 0)]
        most = ends[lane] - i
        size = np.where(here > 0, np.maximum(held[lane] - 1, 0), 0)
        go = np.flatnonzero((here > 0) & (size < most))
        while len(go):
            x = word[i[go] + size[go]] ^ word[j[go] + size[go]]
            size[go] += np.where(x == 0, 8, 7 - np.searchsorted(_STEPS, x, "right"))
            go = go[(x == 0) & (size[go] < most[go])]
        size = np.minimum(size, most)
        held[lane] = size
        lcp[i] = size
    return lcp


def distinct_strings(pieces: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string (the first counts[i] of LENGTH bytes of each piece): its class (numbered in suffix order), piece and number."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # Kasai's rule needs suffixes in full order: no piece is as long as 2 * LENGTH
    order = suffix_array(data, 2 * LENGTH, np.repeat(starts + sizes, sizes + 1))
    lcp = kasai(data, order, starts, starts + sizes)
    piece = np.repeat(np.arange(len(pieces)), counts)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[piece] + number
    valid = np.zeros(len(data), bool)
    valid[at] = True
    ranked = order[valid[order]]
    # equal strings are neighbours: all suffixes of one LENGTH-byte prefix are strings
    fresh = lcp[ranked] < LENGTH
    cls = np.empty(len(data), np.int64)
    cls[ranked] = np.cumsum(fresh) - 1
    return cls[at], piece, number


def _mask(piece: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.bitwise_or.at(out, piece, np.uint64(1) << number.astype(np.uint64))
    return out


def hot_picks(docs: DataFrame, key: str, text: str, least: int, sample: int = SAMPLE) -> np.ndarray:
    """Picks of about least contexts and more, by a sample of documents; which these are decides where contexts meet, and no result."""
    some = docs.where(F.pmod(F.xxhash64(key, text, F.lit(sample)), F.lit(sample)) == 0).select(F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        fps, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0), 4 * PART):
                found = contexts(block, sides=False)
                order, new = _classes(found["fp"], found["ch"])
                fps, back = np.unique(np.concatenate([fps, found["fp"][order][new]]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, np.ones(int(new.sum()), np.int64)])).astype(np.int64)
                if len(fps) > 16 * TOP:
                    top = np.sort(np.argsort(-n, kind="stable")[:TOP])
                    fps, n = fps[top], n[top]
        top = np.argsort(-n, kind="stable")[:TOP]
        yield pa.RecordBatch.from_arrays([pa.array(fps[top].view(np.int64)), pa.array(n[top], pa.int64())], names=["fp", "n"])

    found = some.mapInArrow(count, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, least // sample)).select("fp")
    return np.sort(np.array([r["fp"] for r in found.collect()], np.int64).view(np.uint64))  # 2 ** 20 at most, by least


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _cells(owner: np.ndarray, values: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """Each owner's values, in cells of at most so many."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    for a, b in _spans(_changes(owner)):
        for lo in range(a, b, most):
            yield int(owner[a]), values[lo : min(lo + most, b)].tobytes()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two columns of eight bytes as one."""
    return np.stack([a.astype(np.uint64), b.view(np.uint64)], 1).view("V16").reshape(-1)


def _places(at: np.ndarray) -> np.ndarray:
    """Places in a block, five bytes each."""
    return np.ascontiguousarray(at.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").reshape(-1)


def _unplaced(cells: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<i8").reshape(-1)


def _unpaired(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(cells), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _rows(names, kinds, held)
            held = []
    if held:
        yield _rows(names, kinds, held)


def units(lead: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Which distinct contexts to compare: sets that need no others, of 2 * most at most, and larger ones that share no string with any of these.

    Contexts of one pick that share a string agree on a side of it, and those of
    one document remove nothing.  A pick that needs more than most contexts
    gives a set to each value of each side, and a context is in two at most.
    """
    need, agree = np.zeros(len(lead), bool), []
    by = np.argsort(lead["fp"], kind="stable")
    edge = np.append(_changes(lead["fp"][by]), True)
    several = by[~(edge[:-1] & edge[1:])]
    for side in ("left", "right"):
        own = several[lead[side][several] > 0]
        own = own[np.lexsort((lead["doc"][own], lead[side][own], lead["fp"][own]))]
        start = np.flatnonzero(_changes(lead["fp"][own], lead[side][own]))
        size = np.diff(np.append(start, len(own)))
        # contexts that agree on the side and have different smallest documents
        mixed = np.repeat(lead["doc"][own[start]] != lead["doc"][own[start + size - 1]], size) if len(start) else np.zeros(0, bool)
        own = own[mixed]
        need[own] = True
        agree.append((own, _changes(lead["fp"][own], lead[side][own])))
    ask = by[need[by]]
    new = _changes(lead["fp"][ask])
    many = np.zeros(len(lead), bool)
    many[ask] = _sizes(new) > most
    sets = [(ask[~many[ask]], new[~many[ask]])] + [(own[many[own]], new[many[own]]) for own, new in agree]
    member, new = (np.concatenate(x) for x in zip(*sets, strict=True))
    size = _sizes(new)
    large = [member[size > most][a:b] for a, b in _spans(new[size > most])] if (size > most).any() else []
    member, new = member[size <= most], new[size <= most]
    # a set goes where its first context does
    home = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) // most
    return [member[a:b] for a, b in _spans(_changes(home))] if len(member) else [], large


def _sizes(new: np.ndarray) -> np.ndarray:
    """For each row, how many are in its run."""
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    return np.repeat(size, size)


def smallest(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of distinct strings and their documents as one, with the smallest document of each: two by two, the one searched in the other."""
    while len(runs) > 1:
        out = []
        for k in range(0, len(runs) - 1, 2):
            (a, x), (b, y) = runs[k], runs[k + 1]
            at = np.searchsorted(a, b)
            known = np.zeros(len(b), bool)
            inside = at < len(a)
            known[inside] = a[at[inside]] == b[inside]
            x = x.copy()
            x[at[known]] = np.minimum(x[at[known]], y[known])
            out.append((np.insert(a, at[~known], b[~known]), np.insert(x, at[~known], y[~known])))
        runs = out + runs[len(runs) // 2 * 2 :]
    return runs[0]


LONG, INT, BIN = pa.int64(), pa.int32(), pa.binary()


def repeated_passages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", block_bytes: int = 1 << 22, shard_contexts: int = SHARD, edited: bool = False, hot_contexts: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """keep's columns with n_bytes, n_removed, n_spans, kept_sha256; with edited also kept_text, what is left as text (a character cut in part goes whole)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_blocks = max(32, -(-size // block_bytes))
    bits = max(8, int(n_blocks).bit_length() - 1)
    gang = min(GANG, max(0, int(n_blocks).bit_length() - 9))
    hot = hot_picks(docs, key, text, max(hot_contexts, size >> 24), sample)
    payload = F.struct(*[F.col(c) for c in keep])
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(n_blocks)).cast("int").alias("blk"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(text, F.lit("")).alias("t"), payload.alias("row"))

    def send(t: pa.Table, turn: int) -> Iterator[pa.RecordBatch]:
        ids, blk, found = t.column("id").to_numpy(), t.column("blk").to_numpy(), []
        for a, b in _spans(_changes(blk)):
            for lo, hi, base, block in _pieces_of(t.column("t").slice(a, b - a)):
                c = contexts(block, turn=turn)
                keys = np.empty(len(c["fp"]), KEY)
                for k in ("fp", "ch", "n", "left", "right"):
                    keys[k] = c[k]
                keys["doc"] = ids[a + lo : a + hi][c["text"]]
                keys["at"] = (base + c["start"]).astype(np.uint64) | (np.uint64(blk[a] % (1 << gang)) << AT)
                found.append(keys)
        keys = np.concatenate(found) if found else np.empty(0, KEY)
        del found
        home = _homes(keys["fp"], keys["ch"], bits, hot)
        # a block's rows are in order of id: the first of equal contexts is of the smallest document
        order = np.argsort(home, kind="stable")
        ranked, whose = keys[order], home[order]
        one = _changes(ranked["fp"], ranked["ch"], ranked["at"] >> AT)
        if (one & ~_changes(whose, ranked["at"] >> AT)).any():  # a home of two contexts
            order = np.lexsort((keys["at"] >> AT, keys["ch"], keys["fp"], home))
            ranked, whose = keys[order], home[order]
            one = _changes(ranked["fp"], ranked["ch"], ranked["at"] >> AT)
        keys, bucket = ranked[one], (whose[one] >> np.uint64(63 - bits)).astype(np.int64)
        first = int(blk[0]) >> gang << gang
        yield from _in_batches(((int(bucket[a]), first, pack(keys[a:b])) for a, b in _spans(_changes(bucket))), ["bucket", "blk", "keys"], [LONG, INT, BIN])

    def meet(t: pa.Table, turn: int) -> Iterator[pa.RecordBatch]:
        """To blocks: the contexts that a smaller document elsewhere has.  To blocks as well: contexts to compare."""
        packs = [unpack(x.as_py()) for x in t.column("keys")]
        keys = np.concatenate(packs)
        blk = np.repeat(t.column("blk").to_numpy(), [len(p) for p in packs]) + (keys["at"] >> AT).astype(np.int32)
        del packs
        keys["at"] &= (np.uint64(1) << AT) - np.uint64(1)
        order, new = _classes(keys["fp"], keys["ch"])
        keys, blk = keys[order], blk[order]
        head = np.flatnonzero(new)
        cls = np.cumsum(new) - 1
        least = np.minimum.reduceat(keys["doc"], head)
        mine = np.flatnonzero(keys["doc"] == least[cls])
        mine = mine[_changes(cls[mine])]
        lead, home = keys[mine], blk[mine]
        bucket = t.column("bucket")[0].as_py()
        # a block has a context once here, with its smallest document
        late = keys["doc"] > least[cls]
        answers = ((b, None, None, x) for b, x in _cells(blk[late], _places(keys["at"][late]), 1 << 12))
        names, kinds = ["blk", "shard", "domain", "data"], [INT, LONG, LONG, BIN]
        yield from _in_batches(answers, names, kinds)
        del keys, blk, cls, order, new, late
        number = bucket * PASSES + turn

        def shards() -> Iterator[tuple[int, int | None, np.ndarray]]:
            """Number, domain (of shards that must be merged) and contexts of each shard."""
            if bucket >= 1 << bits:  # others of the same pick are in other buckets
                whole, large = [], [(turn, np.arange(len(lead)))]
            else:
                whole, large = units(lead, shard_contexts)
                large = [((number + 1 << 20) + k, x) for k, x in enumerate(large)]
            for c, part in enumerate(whole):
                yield (number << 32) + c, None, part
            cuts = ((domain, x[lo : lo + shard_contexts]) for domain, x in large for lo in range(0, len(x), shard_contexts))
            for c, (domain, part) in enumerate(cuts):
                yield -(number << 32) - c - 1, domain, part

        def wanted() -> Iterator[tuple]:
            for shard, domain, part in shards():
                pieces = np.empty(len(part), PIECE)
                for k in PIECE.names:
                    pieces[k] = lead[k][part]
                yield from ((b, shard, domain, x) for b, x in _cells(home[part], pieces, CELL))

        yield from _in_batches(wanted(), names, kinds)

    texts = rows.select(F.shiftright("blk", gang).alias("gang"), "blk", "id", "t")
    met = []
    for turn in range(PASSES):
        sent = map_groups(texts, ["gang"], partial(send, turn=turn), "bucket long, blk int, keys binary", order=["blk", "id", "t"])
        met.append(stored(map_groups(sent, ["bucket"], partial(meet, turn=turn), "blk int, shard long, domain long, data binary"), "passages"))
    met = reduce(DataFrame.unionByName, met)
    back = met.where("shard is null").select("blk", "data")
    asked = met.where("shard is not null")

    def cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The bytes of the contexts asked for, from the block's texts."""
        kind = t.column("kind").to_numpy()
        want = int((kind == 0).sum())
        if not want or want == t.num_rows:
            return
        texts = b"".join(buffers(c)[0].tobytes() for c in t.column("t").slice(want).chunks)
        shards, domains, data = t.column("shard").slice(0, want).to_pylist(), t.column("domain").slice(0, want).to_pylist(), t.column("data").slice(0, want)
        blk = t.column("blk")[0].as_py()

        def bytes_of(raw: bytes) -> bytes:
            p = np.frombuffer(raw, PIECE)
            return b"".join([texts[a : a + n] for a, n in zip(p["at"].tolist(), (p["n"].astype(int) - 1 + LENGTH).tolist(), strict=True)])

        found = ((s, d, blk, x.as_py(), bytes_of(x.as_py())) for s, d, x in zip(shards, domains, data, strict=True))
        yield from _in_batches(found, ["shard", "domain", "blk", "keys", "raw"], [LONG, LONG, INT, BIN, BIN], 128)

    none = lambda kind: F.lit(None).cast(kind)
    lent = rows.select("blk", F.lit(1).alias("kind"), "id", none("long").alias("shard"), none("long").alias("domain"), none("binary").alias("data"), "t")
    pieces = map_groups(asked.select("blk", F.lit(0).alias("kind"), none("long").alias("id"), "shard", "domain", "data", none("string").alias("t")).unionByName(lent), ["blk"], cut, "shard long, domain long, blk int, keys binary, raw binary", order=["kind", "id", "t"])
    parts = asked.where("domain is not null").select("shard", "domain").distinct().groupBy("domain").agg(F.count("*").alias("parts")).where("parts > 1")
    pieces = pieces.join(parts, "domain", "left")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Strings of a shard that start in a smaller document; or, if its domain has more shards, its distinct strings by range and their places."""
        packs = [np.frombuffer(x.as_py(), PIECE) for x in t.column("keys")]
        keys = np.concatenate(packs)
        blk = np.repeat(t.column("blk").to_numpy(), [len(p) for p in packs])
        texts = []
        for p, raw in zip(packs, t.column("raw"), strict=True):
            raw, at = raw.as_py(), 0
            for n in (p["n"].astype(int) - 1 + LENGTH).tolist():
                texts.append(raw[at : at + n])
                at += n
        cls, piece, number = distinct_strings(texts, keys["n"].astype(int))
        doc = keys["doc"][piece]
        first = np.full(cls.max(initial=0) + 1, LAST)
        np.minimum.at(first, cls, doc)
        ranges = t.column("parts")[0].as_py()
        if not ranges:
            gone = doc > first[cls]
            yield from _to_blocks(blk, keys["at"], _mask(piece[gone], number[gone], len(keys)))
            return
        shard, names = t.column("shard")[0].as_py(), ["kind", "blk", "key", "part", "seq", "strings", "data"]
        kinds = [INT, INT, LONG, LONG, INT, BIN, BIN]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]])
        some = np.zeros(len(first), np.int64)
        some[cls] = starts[piece] + number
        goes = (span_hash(raw_prefix(raw), some, some + LENGTH) % np.uint64(ranges)).astype(np.int64)
        member = np.zeros(len(first), MEMBER)
        member["sid"], member["doc"] = np.arange(len(first)), first

        def runs():
            by = np.argsort(goes, kind="stable")
            for a, b in _spans(_changes(goes[by])):
                key = (t.column("domain")[0].as_py() << 20) + int(goes[by[a]])
                for seq, lo in enumerate(range(a, b, CELL)):
                    ids = by[lo : min(lo + CELL, b)]
                    yield 1, None, key, shard, seq, raw[some[ids][:, None] + np.arange(LENGTH)].tobytes(), member[ids].tobytes()

        yield from _in_batches(runs(), names, kinds, 128)
        places = np.zeros(len(cls), PLACE)
        places["sid"], places["blk"], places["at"], places["doc"], places["number"] = cls, blk[piece], keys["at"][piece], doc, number
        yield from _in_batches(((2, None, shard, None, 0, None, places[lo : lo + CELL].tobytes()) for lo in range(0, len(places), CELL)), names, kinds, 128)

    compared = stored(map_groups(pieces, ["shard"], compare, "kind int, blk int, key long, part long, seq int, strings binary, data binary"), "strings")

    def merge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """To shards: strings that another one has in a smaller document."""
        part, strings, data = t.column("part").to_numpy(), t.column("strings"), t.column("data")
        spans, runs, members = _spans(_changes(part)), [], []
        for a, b in spans:
            members.append(np.frombuffer(b"".join(x.as_py() for x in data[a:b]), MEMBER))
            runs.append((np.frombuffer(b"".join(x.as_py() for x in strings[a:b]), f"S{LENGTH}"), members[-1]["doc"]))
        value, doc = smallest(runs)
        for (a, _), (own, _), member in zip(spans, runs, members, strict=True):
            least = doc[np.searchsorted(value, own)]
            less = np.flatnonzero(least < member["doc"])
            found = ((int(part[a]), 0, x) for _, x in _cells(np.zeros(len(less), np.int64), _pairs(member["sid"][less], least[less]), CELL))
            yield from _in_batches(found, ["key", "seq", "data"], [LONG, INT, BIN])

    less = map_groups(compared.where("kind = 1").select("key", "part", "seq", "strings", "data"), ["key"], merge, "key long, seq int, data binary", order=["part", "seq"])

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """To blocks: the strings of a shard that start in a smaller document anywhere."""
        told = int((t.column("seq").to_numpy() == 0).sum())
        data = [x.as_py() for x in t.column("data")]
        places = np.frombuffer(b"".join(data[told:]), PLACE)
        if not len(places):
            return
        first = np.full(places["sid"].max() + 1, LAST)
        np.minimum.at(first, places["sid"], places["doc"])
        sid, least = _unpaired(data[:told])
        first[sid.astype(np.int64)] = least.view(np.int64)
        gone = places[places["doc"] > first[places["sid"]]]
        gone = gone[np.lexsort((gone["at"], gone["blk"]))]
        new = _changes(gone["blk"], gone["at"])
        for batch in _to_blocks(gone["blk"][new], gone["at"][new], _mask(np.cumsum(new) - 1, gone["number"], int(new.sum()))):
            yield batch.select(["blk", "data"])

    places = compared.where("kind = 2").select("key", F.lit(1).alias("seq"), "data")
    edges = compared.where("kind = 0").select("blk", "data").unionByName(map_groups(less.unionByName(places), ["key"], resolve, "blk int, data binary", order=["seq"]))

    made = StructType([StructField(f.name, f.dataType) for c in keep for f in [docs.schema[c]]])
    out_fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * edited
    schema = StructType([*made.fields, *StructType.fromDDL(out_fields).fields])

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, data = t.column("kind").to_numpy(), t.column("data")
        ends = [int((kind <= k).sum()) for k in range(3)]
        if ends[1] == ends[2]:
            return
        late = _unplaced([x.as_py() for x in data[: ends[0]]])
        place, strings = _unpaired([x.as_py() for x in data[ends[0] : ends[1]]])
        table = t.slice(ends[1])
        ids, column = table.column("id").to_numpy(), table.column("t")
        found = []
        for lo, hi, base, block in _pieces_of(column):
            c = contexts(block, sides=False)
            found.append((lo, hi, base, {"start": c["start"], "n": c["n"], "fp": c["fp"], "ch": c["ch"], "doc": ids[lo:hi][c["text"]]}))
        every = {k: np.concatenate([c[k] for *_, c in found]) for k in ("n", "fp", "ch", "doc")}
        at, doc = np.concatenate([base + c["start"] for _, _, base, c in found]), every["doc"]
        # smallest document of a context, here and elsewhere
        order, new = _classes(every["fp"], every["ch"])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), LAST)
        np.minimum.at(first, code, doc)
        first[code[np.searchsorted(at, late)]] = FIRST
        mask = np.zeros(len(first), np.uint64)
        spot = np.searchsorted(at, place.astype(np.int64))
        own = doc[spot] == first[code[spot]]
        np.bitwise_or.at(mask, code[spot[own]], strings[own])
        del every, order, new
        whole, part = doc > first[code], (doc == first[code]) & (mask[code] != 0)
        row = table.column("row")
        done = 0
        for (lo, hi, _, c), (_, _, _, block) in zip(found, _pieces_of(column), strict=True):
            m = len(c["fp"])
            change = np.zeros(len(block.data) + 1, np.int32)
            a = np.flatnonzero(whole[done : done + m])
            np.add.at(change, c["start"][a], 1)
            np.add.at(change, c["start"][a] + c["n"][a] - 1 + LENGTH, -1)
            a = np.flatnonzero(part[done : done + m])
            held = mask[code[done + a]]
            for k in range(int(c["n"][a].max(initial=0))):
                b = c["start"][a[(held >> np.uint64(k)) & np.uint64(1) == 1]] + k
                np.add.at(change, b, 1)
                np.add.at(change, b + LENGTH, -1)
            done += m
            arrays = [pa.chunked_array([x.field(f) for x in row.slice(lo, hi - lo).chunks], row.type.field(f).type).combine_chunks() for f in range(len(made.fields))]
            yield pa.RecordBatch.from_arrays([*arrays, *_left(block, np.cumsum(change[:-1]) > 0, edited)], names=[f.name for f in schema.fields])

    row_type = rows.schema["row"].dataType
    answer = lambda df, kind: df.select("blk", F.lit(kind).alias("kind"), none("long").alias("id"), "data", none("string").alias("t"), none(row_type).alias("row"))
    last = rows.select("blk", F.lit(2).alias("kind"), "id", none("binary").alias("data"), "t", "row")
    return map_groups(answer(back, 0).unionByName(answer(edges, 1)).unionByName(last), ["blk"], finish, schema, order=["kind", "id", "t"])


def _left(block: Block, gone: np.ndarray, edited: bool) -> list[pa.Array]:
    """Bytes, removed bytes, spans, digest and, if wanted, the text left of each of a block's texts."""
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    heads = block.offs[:-1][block.offs[:-1] < len(gone)]
    edge[heads] = gone[heads]
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[block.offs])
    removed = count(gone)
    digest, left, raw = [], [], memoryview(block.data)
    for i, (x, y, cut) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), removed.tolist(), strict=True)):
        rest = block.data[x:y][~gone[x:y]].tobytes() if cut else raw[x:y]
        digest.append(hashlib.sha256(rest).hexdigest())
        if edited:
            left.append(rest.decode("utf-8", "ignore").encode() if cut else bytes(rest))
    out = [pa.array(np.diff(block.offs), LONG), pa.array(removed, LONG), pa.array(count(edge), LONG), pa.array(digest, pa.string())]
    return [*out, pa.array(left, BIN).view(pa.string())] if edited else out


def _to_blocks(blk: np.ndarray, at: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(mask)
    cells = ((0, b, None, None, 0, None, x) for b, x in _cells(blk[some], _pairs(at[some], mask[some]), 1 << 12))
    yield from _in_batches(cells, ["kind", "blk", "key", "part", "seq", "strings", "data"], [INT, INT, LONG, LONG, INT, BIN, BIN])


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL5 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, pos, b[pos:pos + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, greatest(CAST(octet_length(b) AS BIGINT) - 48, 1))) AS pos FROM d)),
m AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT g.doc_id, g.pos FROM g JOIN m ON g.s = m.s AND g.doc_id > m.first_doc),
i AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM f)),
r AS (SELECT doc_id, k, min(pos) AS lo, max(pos) + 49 AS hi FROM i GROUP BY doc_id, k),
p AS (SELECT r.doc_id, lo, hi, hex(b[coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) + 1:lo - 1]) AS piece FROM r JOIN d ON r.doc_id = d.doc_id),
a AS (SELECT doc_id, sum(hi - lo + 1) AS n, count(*) AS spans, max(hi) AS last, string_agg(piece, '' ORDER BY lo) AS pieces FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN a.doc_id IS NULL THEN b ELSE unhex(pieces || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
