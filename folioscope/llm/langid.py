"""Language identification by bit-sliced Bloom filters of n-grams.

Training counts byte n-grams of words (with their edges) by language over a
bounded sample of labelled rows.  A language's n-grams are those it uses often
(MIN_COUNT times) and not far less than the language that uses them most.  A
language with fewer than FEW n-grams that often keeps all that it has, and its
rates, being rough, take none from other languages.  One table of words of
``ceil(languages / 64)`` masks holds all filters side by side: a lookup reads k
slots and ANDs them, which leaves the bits of all languages whose filter holds
the n-gram.  A text's counts by language, corrected for each filter's rate of
false positives, decide; ``score`` is the winner's share of the corrected rates.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
nothing was learned.  A text with letters but no n-gram that any filter knows
gets the language with most training rows, with score 0.  Ties go to the
language with more training rows, then to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.blocks import ALNUM, LOWER, Block, blocks, lean, map_blocks, mix, powers, raw_prefix, small_batches

SIZES = (2, 3, 4, 5)
SLOT_BITS = 18
PROBES = 3
MAX_DOCS = 1500  # of a language's rows, about, those with the smallest hash
MAX_LANGS = 200  # languages, those of most rows
MAX_GRAMS = 20000  # of a language's n-grams, the most frequent
MIN_SHARE = 0.15  # of the rate in the language that uses the n-gram most
MIN_COUNT = 5  # of an n-gram in the sample, in languages with FEW such n-grams and more
FEW = 100


class Grams:
    """N-grams of a block's runs of letters.

    A run of letters is padded with one byte on either side, so that beginnings
    and ends count as such.  Texts lie one after the other, each behind one
    such byte; an n-gram belongs to the text in which it begins.
    """

    def __init__(self, block: Block):
        low, offs = block.low, block.offs
        letters = LETTERS[low]
        self.starts = offs + np.arange(len(offs))
        wide = np.zeros(len(low) + len(offs), np.uint8)
        if len(block) * 64 < len(low):
            for a, b, to in zip(offs[:-1].tolist(), offs[1:].tolist(), self.starts.tolist(), strict=False):
                wide[to + 1 : to + 1 + b - a] = letters[a:b]
        else:
            wide[np.arange(len(low)) + np.repeat(np.arange(1, len(block) + 1), np.diff(offs))] = letters
        self.solid = wide > 0
        self.prefix = raw_prefix(wide)
        self.inside = self.solid

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each place, and whether an n-gram begins there: inner bytes all letters, the outer two perhaps not."""
        m = max(0, len(self.solid) - size + 1)
        h = self.prefix[size : size + m] - self.prefix[:m]
        h *= powers(len(self.prefix))[1][:m]
        h += np.uint64(size)
        good = np.ones(m, bool)
        for k in range(1, size - 1):
            good &= self.solid[k : k + m]
        if size == 2:
            good = self.solid[:m] | self.solid[1 : 1 + m]
        return mix(h), good


def gram_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters, and the text of each."""
    grams, out, whose = Grams(block), [], []
    for size in SIZES:
        h, good = grams.of(size)
        at = np.flatnonzero(good)
        out.append(h[at])
        whose.append(np.searchsorted(grams.starts, at, "right") - 1)
    return np.concatenate(out), np.concatenate(whose)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * k)) & low).view(np.int64) for k in range(PROBES)]


#: Bits 0 to 3, and 4 to 7, of a byte as four numbers of 16 bits.
_LANES = [sum(((np.arange(256, dtype=np.uint64) >> np.uint64(4 * half + k)) & np.uint64(1)) << np.uint64(16 * k) for k in range(4)) for half in (0, 1)]


#: Letters, and bytes beyond ASCII, as they are when lower-cased; zero for anything else.
LETTERS = np.where(ALNUM, LOWER, 0).astype(np.uint8)
LETTERS[48:58] = 0


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums between one cut and the next."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:], dtype=np.uint64)
    return total[cut[1:]] - total[cut[:-1]]


class Filters:
    def __init__(self, grams: dict[str, np.ndarray], rows: dict[str, int]):
        self.names = sorted(grams, key=lambda x: (-rows.get(x, 0), x))
        self.words = max(1, -(-len(self.names) // 64))
        self.table = np.zeros((self.words, 1 << SLOT_BITS), np.uint64)
        fill = []
        for i, name in enumerate(self.names):
            bit = np.uint64(1 << (i % 64))
            for s in _slots(grams[name]):
                self.table[i // 64][s] |= bit
            fill.append(np.count_nonzero(self.table[i // 64] & bit) / (1 << SLOT_BITS))
        self.false = np.minimum(np.array(fill) ** PROBES, 0.99)
        if len(self.names) <= 8:
            self.table = self.table.astype(np.uint8)  # one byte a slot stays in cache

    def rates(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Corrected rates by text and language, and the n-grams of each text."""
        grams = Grams(block)
        out, n = np.zeros((len(block), len(self.names))), np.zeros(len(block))
        # stretches of at most 2 ** 15 places, whose counts fit 16 bits
        edges = np.unique(np.concatenate([grams.starts, np.arange(0, len(grams.solid), 1 << 15)]))
        owner = np.searchsorted(grams.starts, edges[:-1], "right") - 1
        for size in SIZES:
            h, good = grams.of(size)
            if not len(h):
                continue
            cut = np.minimum(edges, len(h))
            n += np.bincount(owner, weights=_sums(good, cut), minlength=len(block))
            slots = _slots(h)
            for w in range(self.words):
                mask = self.table[w][slots[0]]
                for s in slots[1:]:
                    mask &= self.table[w][s]
                mask *= good
                first = w * 64
                if mask.dtype == np.uint8:
                    for half in range(1 + (len(self.names) > 4)):
                        packed = _sums(_LANES[half][mask], cut)
                        for k, i in enumerate(range(4 * half, min(len(self.names), 4 * half + 4))):
                            out[:, i] += np.bincount(owner, weights=(packed >> np.uint64(16 * k)) & np.uint64(0xFFFF), minlength=len(block))
                    continue
                for b, i in enumerate(range(first, min(len(self.names), first + 64))):
                    out[:, i] += np.bincount(owner, weights=_sums((mask >> np.uint64(b)) & np.uint64(1), cut), minlength=len(block))
        rate = out / np.maximum(n, 1)[:, None]
        return np.maximum(rate - self.false, 0) / (1 - self.false), n

    def predict(self, block: Block) -> list:
        if not self.names:
            return [["und"] * len(block), [0.0] * len(block)]
        rate, _ = self.rates(block)
        total = rate.sum(1)
        best = rate.argmax(1)
        score = np.where(total > 0, rate.max(1) / np.maximum(total, 1e-300), 0.0)
        names = np.array(self.names, object)[best]
        letter = ((LETTER[block.low]).astype(np.int8))
        count = np.zeros(len(letter) + 1, np.int64)
        np.cumsum(letter, out=count[1:])
        for i in np.flatnonzero(count[block.offs[1:]] == count[block.offs[:-1]]):
            if not any(c.isalpha() for c in block.text(i).decode("utf-8", "replace")):
                names[i], score[i] = "und", 0.0
        return [list(names), score]


LETTER = np.zeros(256, bool)
LETTER[97:123] = True


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_grams: int = MAX_GRAMS, max_bytes: int = 1 << 18, max_langs: int = MAX_LANGS) -> Filters:
    """Filters of the max_langs languages of most rows, each from about max_docs of its rows, texts of at most max_bytes; rows without language or text take no part."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= max_bytes)).select(F.xxhash64(key, text).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    spark = rows.sparkSession
    small_batches(spark)
    rows_of = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()}
    # a language's rows are those of the smallest hashes, by a bound on these; of equal rows one
    shares = spark.createDataFrame([(name, min(1 << 30, int((1 << 30) * max_docs / n))) for name, n in rows_of.items()], "l string, share long")
    sample = rows.join(F.broadcast(shares), "l").where(F.pmod("k", F.lit(1 << 30)) < F.col("share")).groupBy("l", "k").agg(F.first("t").alias("t"))  # max_langs rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, _, block in blocks(batch.column(0)):
                hashes, owner = gram_hashes(block)
                for name in set(langs[lo : lo + len(block)]):
                    own = np.array([x == name for x in langs[lo : lo + len(block)]])
                    h, c = np.unique(hashes[own[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["l", "h", "c"])

    grams = sample.select("t", "l").mapInArrow(count, "l string, h long, c long").groupBy("l", "h").agg(F.sum("c").alias("c"))
    # the most frequent of each language: how many n-grams have each count tells from which count on they are few enough.
    # No table between: both sides read one exchange, and each file of a table starts processes beside the executor that writes it
    upto = F.sum("n").over(Window.partitionBy("l").orderBy(F.desc("c")))
    rank = grams.groupBy("l", "c").agg(F.count("*").alias("n")).select("l", "c", "n", upto.alias("upto"))
    cuts = rank.where((F.col("upto") <= max_grams) | (F.col("upto") == F.col("n"))).groupBy("l").agg(F.min("c").alias("least"))
    got = grams.join(F.broadcast(cuts), "l").where("c >= least").select("l", "h", "c").toPandas()  # max_grams a language, and as many languages as max_langs
    often = (got["c"] >= MIN_COUNT).groupby(got["l"]).sum()
    few = set(often.index[often < FEW])
    got = got[(got["c"] >= MIN_COUNT) | got["l"].isin(few)].copy()
    total = got.groupby("l")["c"].sum().to_dict()
    got["rate"] = got["c"] / got["l"].map(total) if len(got) else []
    most = got[~got["l"].isin(few)].groupby("h")["rate"].max()
    out = {}
    for name in total:
        own = got[got["l"] == name]
        good = np.ones(len(own), bool) if name in few else own["rate"].to_numpy() >= MIN_SHARE * most.loc[own["h"]].to_numpy()
        out[name] = own["h"].to_numpy(np.int64)[good].view(np.uint64)
    return Filters(out, rows_of)


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** SLOT_BITS slots
    return map_blocks(docs, text, list(keep), "lang_pred string, score double", lambda: shared.value.predict, limit=1 << 17)


def held_out(key="doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1


def fitted(docs: DataFrame) -> Filters:
    return fit(docs.where(~F.coalesce(held_out(), F.lit(False))))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fitted(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
