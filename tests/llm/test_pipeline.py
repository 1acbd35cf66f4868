import functools
import hashlib
import math
import random

import corpus_pipeline
from folioscope.llm import queries, suffixdedup
from tests.llm.test_operators import WORD, brute5, brute6, lower, windows


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "an", "ing", "er", "wh", "ou"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30), text(30)]
    passage = text(60)
    texts = [text(120) for _ in range(40)]
    texts += [texts[0], "%%% 123", None, "", text(50) + " " + items[0] + " " + items[1], text(50) + " " + items[0], text(40) + " " + passage, text(40) + " " + passage]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns, name
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, fourth = kept.values()
    assert set(range(48)) - set(first) == {41, 42, 43}
    assert set(first) - set(second) == {40}
    assert set(third) == set(second) and passage not in third[47] and passage in third[46] and third[5] == texts[5]
    assert set(third) - set(fourth) == {44} and items[0] not in fourth[45] and fourth[5] == texts[5]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in mixed.collect()} == fourth
    assert mixed.columns == [*docs.columns, "n_tokens", "weight", "block", "n_copies"]


def brute_mix(rows, most=4.0):
    """Tokens that each source's budget takes, without a budget: whole passes, and a rest that fewer than one block misses."""
    totals = {}
    for s, t in rows:
        totals[s] = totals.get(s, 0) + len(WORD.findall(lower(t)))
    full = {s: n for s, n in totals.items() if n}
    high, low = max(full.values()), min(full.values())
    a = max(0.0, 1 - math.log(most) / math.log(high / low)) if high > low else 0.0
    return totals, {s: max(n, round(n * (high / n) ** (1 - a))) for s, n in full.items()}


def test_mixing_stage_against_brute_force(spark, tmp_path):
    """The last stage: every row with all its columns, and copies that make up the budgets; null sources, texts without words, clashing names."""
    rng = random.Random(15)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, text(rng.randrange(40)), s, float(i)) for i, s in enumerate(["big"] * 120 + ["mid"] * 30 + ["low"] * 6 + [None] * 4)] + [(900, None, "mid", 0.5), (None, "... !", "void", 1.0), (901, "", "low", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double").repartition(3)
    got = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.source, r.weight) for r in got))) == sorted(map(repr, rows))
    totals, budget = brute_mix([(s, t) for _, t, s, _ in rows])
    for s, n in budget.items():
        own = [r for r in got if r.source == s]
        assert all(r.n_tokens == len(WORD.findall(lower(r.text))) for r in own)
        taken = sum(r.n_tokens * r.n_copies for r in own)
        assert budget[s] - max(r.n_tokens for r in own) < taken <= budget[s], s
        copies = {r.n_copies for r in own if r.n_tokens}
        passes = n // totals[s]
        assert copies <= {passes, passes + 1} and abs(own[0].mix_weight - n / sum(budget.values())) < 0.01, s
    assert all(r.n_copies == 1 for r in got if not r.n_tokens)
    assert abs(sum({r.source: r.mix_weight for r in got}.values()) - 1) < 1e-9


def test_rows_of_equal_id(spark, tmp_path):
    """Of rows of one id the stage keeps one, the same whatever the partitions; rows without id all stay."""
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g h i j k l m", "s"), (1, None, "z"), (2, "x", "s"), (2, "x", "t"), (None, "q", "s"), (None, "q", "s")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = corpus_pipeline.near_duplicate(spark, docs, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[1], rows[4], rows[5], rows[6]]))


def test_empty_table_in_each_stage(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_decontamination_in_shards(spark, tmp_path, monkeypatch):
    """Stage 4 with a benchmark over the bound of one table: the rows that one table gives, equal rows included."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [text(20) for _ in range(9)]
    texts = [text(40), None, "", text(9) + " " + items[0] + " " + text(9), text(9) + " " + items[3] + " " + items[5], items[8], items[7] + " " + text(4), items[7] + " " + text(4)]
    rows = [(i, t, "en", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, text(5), "en", 1), (None, items[2] + " end", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_chars long").repartition(3)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = lambda df: sorted(map(repr, df.collect()))
    whole = seen(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert len(whole) == len(rows) - 1
    monkeypatch.setattr(corpus_pipeline, "decontaminate", functools.partial(corpus_pipeline.decontaminate, max_table_bytes=4000))
    cut = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and seen(cut) == whole
    gone = [r.text for r in cut.collect() if r.text and any(i in r.text for i in items)]
    assert not gone


def brute_stage4(text, items):
    """The text without its hit runs of words; None if two items and more are found."""
    found = list(WORD.finditer(lower(text)))
    w, hit, names = [m.group() for m in found], [False] * len(found), set()
    for name, item in items:
        for g in windows(item)[1]:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit[i : i + len(g)] = [True] * len(g)
                    names.add(name)
    out, at = "", 0
    for i, m in enumerate(found):
        if hit[i]:
            out += text[at : m.start()] if not (i and hit[i - 1]) else ""
            at = m.end()
    return None if len(names) > 1 else out + text[at:]


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    """Stages 1 to 4, each on all that the one before kept: near copies, a chain of revisions, passages, nulls, a benchmark in shards."""
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(i, text(20)) for i in range(6)]
    texts, chain, passage = [None, "", "12 34"], text(100).split(), text(30)
    for k in range(7):
        chain[14 * k : 14 * k + 2] = text(2).split()
        texts.append(" ".join(chain))
    base = text(80).split()
    texts += [" ".join([*base[:k], "zz", *base[k:]]) for k in (0, 20, 40)] + [text(50) + " " + passage + " " + text(20) for _ in range(3)]
    texts += [text(30) + " " + items[0][1] + ", " + text(30), text(30) + " " + items[3][1] + " " + items[5][1], items[4][1] + " " + text(40)] + [text(60) for _ in range(8)]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(corpus_pipeline, "decontaminate", functools.partial(corpus_pipeline.decontaminate, max_table_bytes=3000))
    got = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        got.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(got[-1])
    first = {i: t for i, t in zip(ids, texts, strict=True) if t and any(c.isalpha() for c in t)}
    second = {i: first[i] for i, _, comp in brute6(list(first), list(first.values())) if i == comp}
    assert got[:2] == [first, second] and len(second) < len(first) - 7
    cut = brute5(list(second), list(second.values()))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got[2].items()} == {i: v[0][3] for i, v in cut.items()}
    assert sum(v[0][1] > 0 for v in cut.values()) == 2
    fourth = {i: brute_stage4(t, items) for i, t in got[2].items()}
    assert got[3] == {i: t for i, t in fourth.items() if t is not None} and None in fourth.values()


def test_suffix_stage_keeps_strings_in_shards(spark, tmp_path, monkeypatch):
    """The third stage: small picks fill buckets beyond a shard, and no string travels; what is left is that of brute force."""
    rng = random.Random(54)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(700)}"
    pool = [" ".join(word() for _ in range(14)) for _ in range(1200)]
    use = [p[rng.randrange(12) : len(p) - rng.randrange(12)] for p in pool for _ in range(4)]
    rng.shuffle(use)
    texts = [None, *(" ".join(x for y in use[k : k + 12] for x in (y, word())) for k in range(0, len(use), 12))]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    tables = []

    def stored(df, label, write=suffixdedup.stored):
        tables.append(write(df, label))
        return tables[-1]

    monkeypatch.setattr(suffixdedup, "stored", stored)
    monkeypatch.setattr(corpus_pipeline, "repeated_passages", functools.partial(suffixdedup.repeated_passages, shard_contexts=40))
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).collect()}
    want = {k: v[0] for k, v in brute5(list(range(len(texts))), texts).items()}
    assert all(hashlib.sha256((got[i].text or "").encode()).hexdigest() == want[i][3] for i in got)
    assert set(got) | {i for i, x in want.items() if x[1]} == set(want)
    strings = [t for t in tables if "strings" in t.columns]
    assert len(strings) == 1 and not strings[0].where("kind > 0").count()
    assert sum("shard" in t.columns for t in tables) > 1


def test_language_without_labels(spark, tmp_path):
    """Stage 1 with nothing to learn from: null and letterless texts go, all others stay."""
    docs = spark.createDataFrame([(0, "plain text", None), (1, "123 !!!", None), (2, None, None), (3, "", None), (4, "\n\u4e2d", None), (5, "12 \u00df", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == [0, 4, 5]


def test_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
