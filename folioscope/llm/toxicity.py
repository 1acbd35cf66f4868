"""Toxic spans by a linear-chain conditional random field.

Training takes a bounded sample of labelled rows.  Document labels become token
labels: in a toxic document those tokens are toxic whose word or prefixes occur
far more often in toxic documents than in clean ones; no token of a clean
document is.  A two-state chain is fitted to windows of tokens by gradient
ascent on the conditional likelihood, with forward-backward for the
expectations; of the sampled texts' windows at most max_windows take part, half
of them around toxic tokens and half anywhere, both drawn at random.  Features are the word and its prefixes of 4 to 7 bytes.

Scoring is exact forward-backward over the whole text.  A token without any
known feature has the same potentials wherever it stands, so a run of them is a
power of one 2 by 2 matrix, taken in closed form; the recursions step only over
tokens with features, for all texts of a block at once.  Marginals of a text's
tokens (largest, their sum, and that sum per token) pass a logistic fit on the
sampled labels and give its score; tokens over one half give the spans.

Defined results: null and empty texts have no tokens and get the score of a
text without any evidence.  If the sample lacks a class, every score is the
sample's share of toxic rows (0.0 for an empty sample).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import ALNUM, Block, blocks, lists, map_blocks, span_hash

PREFIXES = (4, 5, 6, 7)
MAX_DOCS = 1200  # of each class, about, those with the smallest hash
MAX_BYTES = 1 << 13  # of a sampled text
MAX_FEATURES = 1 << 16
WINDOW = 16
MAX_WINDOWS = 6000  # of the sampled texts' windows, those that the chain is fitted to
STEPS = 130


def token_features(block: Block) -> tuple:
    """Words, and a matrix of feature hashes (word and prefixes; 0 where there is none)."""
    words = block.words(ALNUM)
    size = words.end - words.start
    out = np.zeros((1 + len(PREFIXES), len(words)), np.uint64)
    if len(words):
        out[0] = words.hashes
        for i, n in enumerate(PREFIXES, 1):
            fits = size >= n
            # the length is part of the hash; one more constant keeps a prefix apart from a word
            out[i, fits] = span_hash(block.prefix, words.start[fits], words.start[fits] + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    return words, out


class Chain:
    """A two-state chain: feature weights of the toxic state, transitions and start."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, trans: np.ndarray, fit: np.ndarray, prior: float):
        self.keys, self.weights, self.bias, self.trans, self.fit, self.prior = keys, weights, bias, trans, fit, prior
        self.front = np.zeros(1 << 20, bool)
        self.front[keys >> np.uint64(44)] = True

    def evidence(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with known features, and the sum of their weights."""
        total = None
        hit = np.zeros(features.shape[1], bool)
        total = np.zeros(features.shape[1])
        for row in features:
            near = np.flatnonzero(self.front[row >> np.uint64(44)])
            if not len(near) or not len(self.keys):
                continue
            slot = np.minimum(np.searchsorted(self.keys, row[near]), len(self.keys) - 1)
            good = self.keys[slot] == row[near]
            total[near[good]] += self.weights[slot[good]]
            hit[near[good]] = True
        at = np.flatnonzero(hit)
        return at, total[at]

    def _power(self, n: np.ndarray) -> np.ndarray:
        """The transition over runs of n tokens without features, scaled: (len(n), 2, 2)."""
        m = self.trans * np.array([1.0, np.exp(self.bias)])[None, :]
        values, vectors = np.linalg.eig(m)
        values, vectors = values.real, vectors.real
        top = np.abs(values).max()
        p = (values[None, :] / top) ** n[:, None]
        return np.maximum(np.einsum("ij,nj,jk->nik", vectors, p, np.linalg.inv(vectors)), 0)

    def marginals(self, counts: np.ndarray, bounds: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Probability of the toxic state at each token with features."""
        lo, hi = np.searchsorted(at, bounds[:-1]), np.searchsorted(at, bounds[1:])
        n = hi - lo
        out = np.zeros(len(at))
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        if not len(order):
            return out
        longest = int(n[order[0]])
        gap = np.zeros(len(at), np.int64)
        gap[1:] = at[1:] - at[:-1] - 1
        begins = lo[n > 0]
        gap[begins] = at[begins] - bounds[:-1][n > 0]
        ends = hi[n > 0] - 1
        tail = np.zeros(len(at), np.int64)
        tail[ends] = bounds[1:][n > 0] - at[ends] - 1
        # the first token of a text has no transition before it
        late = np.zeros(len(at), bool)
        late[begins] = gap[begins] > 0
        inner = self._power(gap - late)
        emit = np.stack([np.ones(len(at)), np.exp(np.clip(self.bias + weight, -30, 30))], 1)
        alpha, beta = np.zeros((len(at), 2)), np.zeros((len(at), 2))
        active = np.searchsorted(-n[order], -np.arange(1, longest + 1), "right")
        start = np.array([1.0, 1e-3])
        for step, k in enumerate(active.tolist()):
            i = lo[order[:k]] + step
            before = alpha[i - 1] if step else np.where(late[i][:, None], start * np.array([1.0, np.exp(self.bias)]), start)
            moved = np.einsum("ni,nij->nj", before, inner[i])
            moved = moved @ self.trans if step else np.where(late[i][:, None], moved @ self.trans, before)
            now = moved * emit[i]
            alpha[i] = now / now.sum(1, keepdims=True)
        for step in range(longest):
            k = int(active[step])
            i = hi[order[:k]] - 1 - step
            if not step:
                now = np.einsum("nij,j->ni", self._power(tail[i]), np.ones(2))
            else:
                after = (beta[i + 1] * emit[i + 1]) @ self.trans.T
                now = np.einsum("nij,nj->ni", inner[i + 1], after)
            beta[i] = now / now.sum(1, keepdims=True)
        both = alpha * beta
        return both[:, 1] / both.sum(1)

    def summary(self, block: Block) -> tuple:
        words, features = token_features(block)
        at, weight = self.evidence(features)
        p = self.marginals(words.counts, words.bounds, at, weight)
        owner = np.searchsorted(words.bounds, at, "right") - 1
        total = np.bincount(owner, weights=p, minlength=len(block))
        most = np.zeros(len(block))
        np.maximum.at(most, owner, p)
        x = np.stack([np.ones(len(block)), most, np.log1p(total), np.log1p(100 * total / np.maximum(words.counts, 1))], 1)
        return words, at, p, owner, x

    def score(self, block: Block) -> list:
        words, at, p, owner, x = self.summary(block)
        if len(self.fit) == 0:
            score = np.full(len(block), self.prior)
        else:
            score = 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))
        bad = np.flatnonzero(p > 0.5)
        # neighbouring toxic tokens are one span
        tokens = at[bad]
        new = np.ones(len(tokens), bool)
        new[1:] = (np.diff(tokens) != 1) | (owner[bad][1:] != owner[bad][:-1])
        a = np.flatnonzero(new)
        z = np.concatenate([a[1:], [len(tokens)]]) - 1 if len(a) else a
        text = owner[bad][a] if len(a) else np.empty(0, np.int64)
        bounds = np.searchsorted(text, np.arange(len(block) + 1))
        return [score, lists(words.start[tokens[a]] - block.offs[text], bounds, pa.int64()), lists(words.end[tokens[z]] - block.offs[text], bounds, pa.int64())]


def _fit_chain(index: np.ndarray, label: np.ndarray, n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions from windows: index (windows, WINDOW, features; n_features stands for none), label (windows, WINDOW)."""
    w, bias, trans = np.zeros(n_features + 1), -2.0, np.zeros((2, 2))
    s, t = label.shape
    flat = index.reshape(s * t, -1)
    moments = [np.zeros_like(w), 0.0, np.zeros((2, 2))]
    squares = [np.zeros_like(w), 0.0, np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        emit = np.ones((s, t, 2))
        emit[:, :, 1] = np.exp(np.clip(bias + w[flat].sum(1), -30, 30)).reshape(s, t)
        m = np.exp(trans)
        alpha, beta = np.empty((s, t, 2)), np.ones((s, t, 2))
        now = emit[:, 0] * np.array([1.0, 1e-3])
        alpha[:, 0] = now / now.sum(1, keepdims=True)
        for k in range(1, t):
            now = (alpha[:, k - 1] @ m) * emit[:, k]
            alpha[:, k] = now / now.sum(1, keepdims=True)
        pair = np.zeros((2, 2))
        for k in range(t - 2, -1, -1):
            out = emit[:, k + 1] * beta[:, k + 1]
            both = alpha[:, k][:, :, None] * m[None] * out[:, None, :]
            pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
            now = out @ m.T
            beta[:, k] = now / now.sum(1, keepdims=True)
        p = alpha[:, :, 1] * beta[:, :, 1]
        p = p / (p + alpha[:, :, 0] * beta[:, :, 0])
        diff = (label - p).reshape(-1)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:, :-1].astype(int).ravel(), label[:, 1:].astype(int).ravel()), 1)
        size = s * t
        grads = [np.bincount(flat.ravel(), weights=np.repeat(diff, flat.shape[1]), minlength=n_features + 1) / size * 100 - 0.002 * w, diff.sum() / size * 100, (seen - pair) / size * 100 - 0.002 * trans]
        values = [w, bias, trans]
        for i, g in enumerate(grads):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            move = 0.1 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
            values[i] = values[i] + move
        w, bias, trans = values
        w[n_features] = 0
    return w[:n_features], float(bias), np.exp(trans - trans.max())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 5, max_windows: int = MAX_WINDOWS) -> Chain:
    """A chain from sampled texts and their labels, and the logistic fit of its scores."""
    toxic = np.asarray(toxic, bool)
    made = [token_features(block) for _, _, block in blocks(texts)]
    features = np.concatenate([f for _, f in made], 1) if made else np.zeros((1, 0), np.uint64)
    counts = np.concatenate([w.counts for w, _ in made]) if made else np.zeros(0, np.int64)
    del made
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    n_tokens = len(owner)
    none = Chain(np.empty(0, np.uint64), np.empty(0), -5.0, np.ones((2, 2)), np.empty(0), float(toxic.mean()) if len(toxic) else 0.0)
    if not toxic.any() or toxic.all() or not n_tokens:
        return none
    # texts in which each feature occurs, by class
    both = features.ravel()
    docs = np.tile(owner, len(features))
    keep = both != 0
    keys, code = np.unique(both[keep], return_inverse=True)
    pairs = np.unique(code.astype(np.int64) * len(toxic) + docs[keep])
    bad = toxic[pairs % len(toxic)]
    n1 = np.bincount(pairs // len(toxic), weights=bad, minlength=len(keys))
    n0 = np.bincount(pairs // len(toxic), weights=~bad, minlength=len(keys))
    lift = (n1 + 0.1) / toxic.sum() / ((n0 + 0.5) / (~toxic).sum())
    # the held number of features, by lift, among those that toxic texts use
    rank = np.lexsort((keys, -n1, -lift))
    chosen = rank[(n1[rank] >= 2)][:MAX_FEATURES]
    seed_set = np.zeros(len(keys), bool)
    seed_set[chosen[(lift[chosen] >= 20) & (n1[chosen] >= 4)]] = True
    column = np.full(len(keys), len(chosen))
    column[chosen] = np.arange(len(chosen))
    index = np.full(features.shape, len(chosen))
    is_seed = np.zeros(features.shape, bool)
    index.ravel()[np.flatnonzero(keep)] = column[code]
    is_seed.ravel()[np.flatnonzero(keep)] = seed_set[code]
    label = is_seed.any(0) & toxic[owner]
    # windows around toxic tokens, and as many from anywhere
    rng = np.random.default_rng(seed)
    ends = bounds[owner + 1]
    at = np.flatnonzero(label)
    starts = np.concatenate([rng.permutation(at)[: max_windows // 2] - rng.integers(0, WINDOW, min(len(at), max_windows // 2)), rng.integers(0, n_tokens, max_windows // 2)])
    starts = np.maximum(starts, 0)
    cells = starts[:, None] + np.arange(WINDOW)[None, :]
    inside = cells < ends[starts][:, None]
    cells = np.where(inside, cells, 0)
    windows = np.where(inside[:, :, None], index[:, cells].transpose(1, 2, 0), len(chosen))
    w, bias, trans = _fit_chain(windows, np.where(inside, label[cells], False).astype(float), len(chosen))
    strong = np.abs(w) > 0.2
    held = keys[chosen][strong]
    order = np.argsort(held)
    chain = Chain(held[order], w[strong][order], bias, trans, np.empty(0), float(toxic.mean()))
    x = np.concatenate([chain.summary(block)[-1] for _, _, block in blocks(texts)])
    chain.fit = _logistic(x, toxic.astype(float))
    return chain


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> Chain:
    """A chain from about max_docs labelled rows of each class (2 * max_docs at most in all), of texts of at most MAX_BYTES, fitted to at most max_windows windows of their tokens."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull()).groupBy("k").agg(F.max("y").alias("y"))
    sized = docs.select(F.col(key).alias("k"), F.octet_length(text).alias("n")).where(F.col("n") <= MAX_BYTES)
    both = sized.join(marked, "k").select("k", "y").distinct()
    # a class's rows are those of the smallest hashes: by a bound on these, so that no class meets in one task
    n = {r["y"]: r["n"] for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = [min(1 << 30, int((1 << 30) * max_docs / max(1, n.get(y, 0)))) for y in (0, 1)]
    chosen = both.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= MAX_BYTES).join(F.broadcast(chosen), "k").orderBy(F.xxhash64("k"), "k", "t").limit(2 * max_docs).toArrow()
    return train(got.column("t").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("y").to_numpy() == 1, max_windows=max_windows)


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns with score and the toxic spans in UTF-8 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # MAX_FEATURES weights
    return map_blocks(docs, text, list(keep), "score double, toxic_from array<long>, toxic_to array<long>", lambda: shared.value.score, limit=1 << 19)


def held_out(key="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def op7_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = fit(docs.where(~held_out()), labels.where(~held_out()))
    found = score(docs.select("doc_id", "text"), chain)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("toxic_from").alias("n_spans"))
