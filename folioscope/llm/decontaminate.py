"""Benchmark decontamination against a broadcast hash set of n-grams.

The benchmark's word windows become a sorted hash table in flat arrays with a
bitmap in front.  Each text's word windows are looked up in it, hits are compared
word by word, and the words inside any hit make up the spans to remove.  The
table is broadcast while it takes at most ``max_table_bytes`` (WINDOW_BYTES a
word of the benchmark, besides its text); beyond, the items are dealt into
shards of that size, every shard makes its own pass, and the passes' hits are
merged by text.

Defined results: a null or empty text has no words and no hits; items without
words never occur; items of equal id count once; a null id stands as ''; rows
of equal doc_id are judged apart while one pass is enough, and together as one
key otherwise only after a row number is added, so they stay apart there too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import ALNUM, Block, block_of, lists, map_blocks, stored, sums

BITS = 22
WINDOW_BYTES = 48  # of a table's arrays, for each word of the benchmark
#: A word before letters are lower-cased.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class WindowTable:
    """Windows of benchmark items: sorted hashes, each with the place of its words and the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = 8):
        words = block_of([(t or "").encode() for _, t in items]).words(ALNUM)
        names = ["" if i is None else str(i) for i, _ in items]
        self.names = sorted(set(names))
        code = np.searchsorted(np.array(self.names), names) if names else np.empty(0, np.int64)
        self.lengths = {min(n, int(c)) for c in words.counts if c}
        #: all words, lower-cased, a space between each
        self.text = words.bytes_of(0, len(words))
        start = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
        hashes = words.hashes if len(words) else np.empty(0, np.uint64)
        found = []
        for size in sorted(self.lengths):
            grams = words.grams(hashes, size)
            at = np.flatnonzero(words.whole(size))
            owner = np.searchsorted(words.bounds, at, "right") - 1
            own = words.counts[owner] >= n if size == n else words.counts[owner] == size
            found.append((grams[at[own]], start[at[own]], start[at[own] + size] - 1, code[owner[own]]))
        key, begin, end, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        order = np.lexsort((item, key))
        key, begin, end, item = key[order], begin[order], end[order], item[order]
        # windows of one hash: those of one text are one entry
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        entry = np.cumsum(new) - 1
        extra: list[int] = []
        several = np.flatnonzero(~new)
        heads: dict[int, dict[bytes, int]] = {}
        for i in several.tolist():
            known = heads.get(int(entry[i]))
            if known is None:
                first = int(np.searchsorted(key, key[i]))
                known = heads.setdefault(int(entry[i]), {self.text[begin[first] : end[first]]: int(entry[i])})
            one = self.text[begin[i] : end[i]]
            if one not in known:  # another text of the same hash
                known[one] = int(new.sum()) + len(extra)
                extra.append(i)
            entry[i] = known[one]
        head = np.concatenate([np.flatnonzero(new), np.array(extra, np.int64)])
        order = np.argsort(key[head], kind="stable")
        place = np.empty(len(head), np.int64)
        place[order] = np.arange(len(head))
        self.keys, self.begin, self.end = key[head][order], begin[head][order], end[head][order]
        both = np.unique(place[entry] * max(1, len(self.names)) + item)
        self.items = (both % max(1, len(self.names))).astype(np.int32)
        self.bounds = np.searchsorted(both // max(1, len(self.names)), np.arange(len(head) + 1))
        self.front = np.zeros(1 << BITS, bool)
        self.front[self.keys >> np.uint64(64 - BITS)] = True

    def items_of(self, key: np.uint64, words: bytes) -> list[str]:
        """The items that have a window of these words."""
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        for e in range(int(lo), int(hi)):
            if self.text[self.begin[e] : self.end[e]] == words:
                return [self.names[i] for i in self.items[self.bounds[e] : self.bounds[e + 1]].tolist()]
        return []

    def hits(self, block: Block) -> tuple:
        """Words, flags of words that are hit, and for each text the ids of the items found."""
        words = block.words(ALNUM)
        items: list[set[str]] = [set() for _ in range(len(block))]
        change = np.zeros(len(words) + 1, np.int32)
        if len(words) and len(self.keys):
            hashes = words.hashes
            for size in self.lengths:
                grams = words.grams(hashes, size)
                at = np.flatnonzero(self.front[grams >> np.uint64(64 - BITS)] & words.whole(size))
                slot = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
                at = at[self.keys[slot] == grams[at]]
                owner = np.searchsorted(words.bounds, at, "right") - 1
                for i, text in zip(at.tolist(), owner.tolist(), strict=True):
                    if names := self.items_of(grams[i], words.bytes_of(i, i + size)):
                        items[text].update(names)
                        change[i] += 1
                        change[i + size] -= 1
        return words, np.cumsum(change[:-1]) > 0, items


def _one_pass(docs: DataFrame, keep: list[str], text: str, table) -> DataFrame:
    def make():
        index = table.value

        def fn(block: Block) -> list:
            words, hit, items = index.hits(block)
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # a run of hit words may cross into the next text
            cut = words.bounds[1:-1]
            cut = np.unique(cut[(cut > 0) & (cut < len(hit))])
            cut = cut[hit[cut] & hit[cut - 1]] if len(cut) else cut
            lo, hi = np.sort(np.concatenate([lo, cut])), np.sort(np.concatenate([hi, cut]))
            bounds = np.searchsorted(lo, words.bounds)
            owner = np.searchsorted(words.bounds, lo, "right") - 1
            base, first = block.offs[owner], words.bounds[owner]
            spans = [lists(x, bounds, pa.int64()) for x in (lo - first, hi - first, words.start[lo] - base, words.end[hi - 1] - base)]
            return [words.counts, sums(hit, words.bounds), [sorted(x) for x in items], *spans]

        return fn

    return map_blocks(docs, text, keep, "n_words long, n_hit long, items array<string>, word_from array<long>, word_to array<long>, byte_from array<long>, byte_to array<long>", make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, max_table_bytes: int = 64 << 20) -> DataFrame:
    """keep's columns with n_words, n_hit, items, and the hit spans in words (word_from, word_to) and UTF-8 bytes (byte_from, byte_to)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = bench.agg(F.sum(F.octet_length(F.coalesce("t", F.lit(""))) + F.lit(64) + F.lit(WINDOW_BYTES) * F.regexp_count(F.coalesce("t", F.lit("")), F.lit(ANY_WORD)))).first()[0] or 0
    shards = -(-total // max_table_bytes) or 1
    if shards == 1:
        table = spark.sparkContext.broadcast(WindowTable([tuple(r) for r in bench.collect()], n))
        return _one_pass(docs, list(keep), text, table)
    # names by place, so that none of keep's clashes; numbered once and written, so that every pass sees the same numbers
    own = [f"__{i}" for i in range(len(keep))]
    numbered = stored(docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "numbered")
    out = None
    for k in range(shards):
        part = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        table = spark.sparkContext.broadcast(WindowTable([tuple(r) for r in part.collect()], n))
        one = _one_pass(numbered, [*own, "__row"], "__text", table)
        out = one if out is None else out.unionByName(one)
    # every shard gives a row for each text: as many rows meet in a group as there are shards
    merged = out.groupBy("__row").agg(
        *[F.first(o).alias(o) for o in own],
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("word_from", "word_to", "byte_from", "byte_to")))).alias("spans"),
    )
    first = "struct(spans[0].word_from as word_from, spans[0].word_to as word_to, spans[0].byte_from as byte_from, spans[0].byte_to as byte_to)"
    joined = F.expr(
        f"""if(size(spans) = 0, cast(array() as array<struct<word_from:bigint,word_to:bigint,byte_from:bigint,byte_to:bigint>>),
        aggregate(slice(spans, 2, greatest(size(spans) - 1, 0)), array({first}), (a, x) -> if(x.word_from <= element_at(a, -1).word_to,
          concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).word_from as word_from, greatest(element_at(a, -1).word_to, x.word_to) as word_to,
            element_at(a, -1).byte_from as byte_from, greatest(element_at(a, -1).byte_to, x.byte_to) as byte_to))), concat(a, array(x)))))"""
    )
    s = merged.withColumn("spans", joined)
    return s.select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.word_to - x.word_from)").alias("n_hit"), "items", *[F.col(f"spans.{c}").alias(c) for c in ("word_from", "word_to", "byte_from", "byte_to")])


def without_spans(text: str, byte_from: str = "byte_from", byte_to: str = "byte_to"):
    """Column: the text of that name without its hit spans."""
    begin, end = f"if(i = 0, 0L, get({byte_to}, i - 1))", f"if(i = size({byte_from}), cast(octet_length({text}) as bigint), get({byte_from}, i))"
    rest = f"aggregate(sequence(0, size({byte_from})), cast('' as binary), (a, i) -> concat(a, substring(encode({text}, 'UTF-8'), cast({begin} as int) + 1, cast({end} - {begin} as int))))"
    return F.expr(f"if(size({byte_from}) = 0, {text}, decode({rest}, 'UTF-8'))")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


SQL4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS win, least(len(w), 8) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT dw.doc_id, dw.pos, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS p FROM hits),
c AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
