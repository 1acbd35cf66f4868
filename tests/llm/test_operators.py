"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, licenses, mixing, neardup, suffixdedup, topk, toxicity, urlfilter, warc
from folioscope.llm.groups import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def docs_of(spark, texts, ids=None, langs=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), 0.5, 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOC).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(words)}" for _ in range(n))


# ---- 4


def windows(text, n=8):
    w = WORD.findall(lower(text))
    return w, ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())


def brute4(texts, items):
    out = []
    for t in texts:
        w, _ = windows(t)
        hit, names = set(), set()
        for name, item in items:
            for g in windows(item)[1]:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        names.add("" if name is None else str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [(1, prose(rng, 20)), (2, "Short ITEM"), (None, prose(rng, 9)), (4, None), (5, "..."), (2, prose(rng, 12))]
    a, b = items[0][1], items[5][1]
    texts = [None, "", prose(rng, 30) + " " + a[5:90] + " " + b, "x " + a.upper() + "! short, item", "short", prose(rng, 3000) + " " + a, a, a, "é" + b]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute4(texts, items)
    for bound in (16 << 20, 1500):  # one table, and shards
        found = decontaminate.decontaminate(docs_of(spark, texts), bench, max_table_bytes=bound).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r["items"]) for r in found] == want, bound
    cleaned = decontaminate.decontaminate(docs_of(spark, texts), bench, keep=("doc_id", "text")).select("doc_id", decontaminate.without_spans("text").alias("t")).orderBy("doc_id").collect()
    assert [cleaned[i].t for i in (0, 1, 4)] == [None, "", "short"] and cleaned[6].t == ""
    assert all(w == 0 for w, _ in [(r[1], 0) for r in brute4([r.t for r in cleaned if r.doc_id in (2, 5)], items)])
    assert decontaminate.decontaminate(docs_of(spark, texts), bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(docs_of(spark, texts).where("false"), bench).count() == 0


def test_windows_of_one_hash(monkeypatch):
    """Windows whose hashes are all alike are told apart by their words; those of one text share an entry."""
    from folioscope.llm.blocks import Words, block_of

    monkeypatch.setattr(Words, "grams", lambda self, hashes, n: np.full(max(0, len(hashes) - n + 1), 7, np.uint64))
    table = decontaminate.WindowTable([("a", "one two three"), ("b", "two three four"), ("c", "One, two three!"), (None, "x y")], 3)
    assert len(table.keys) == 3 and table.items_of(np.uint64(7), b"one two three") == ["a", "c"] and table.items_of(np.uint64(7), b"x y") == [""]
    words, hit, items = table.hits(block_of([b"one two three four", b"y x y"]))
    assert hit.tolist() == [True] * 4 + [False, True, True] and items == [{"a", "b", "c"}, {""}]


# ---- 9


def test_rates_against_counting():
    """The filters' rates are those of looking up every n-gram by itself, over long texts and many languages too."""
    from folioscope.llm.blocks import block_of

    rng = random.Random(91)
    texts = [prose(rng, n).encode() for n in (0, 1, 30, 20000)] + ["Ünd 12 ß".encode(), b"", b"a"]
    for n_langs in (3, 7, 70):
        hashes, owner = langid.gram_hashes(block_of(texts))
        pick = np.unique(hashes)
        filters = langid.Filters({f"l{i:02d}": pick[i % 7 :: 7 + i] for i in range(n_langs)}, {})
        got, n = filters.rates(block_of(texts))
        rows = [int(h) for h in hashes]
        want = np.zeros((len(texts), n_langs))
        for h, o in zip(rows, owner.tolist(), strict=True):
            slots = [(h >> (langid.SLOT_BITS * k)) & ((1 << langid.SLOT_BITS) - 1) for k in range(langid.PROBES)]
            for i in range(n_langs):
                want[o, i] += all(int(filters.table[i // 64][s]) >> (i % 64) & 1 for s in slots)
        assert n.tolist() == np.bincount(owner, minlength=len(texts)).tolist()
        rate = np.maximum(want / np.maximum(n, 1)[:, None] - filters.false, 0) / (1 - filters.false)
        assert np.allclose(got, rate)
        if n_langs == 3:
            grams = [w[i : i + s] for t in texts for w in re.findall(rb"\0[a-z\x80-\xff]+(?=\0)", b"\0" + re.sub(rb"[^a-z\x80-\xff]+", b"\0\0", t.lower()) + b"\0") for w in [w + b"\0"] for s in langid.SIZES for i in range(len(w) - s + 1)]
            assert len(grams) == len(hashes)


def test_language(spark):
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["ser", "ton", "vé"], "cc": ["ul", "wh", "mi"]}
    texts, langs = [], []
    for _ in range(240):
        lang = rng.choice(list(parts))
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 30))))
        langs.append(lang)
    texts += [None, "", "123 !!!", "ß", "kalomi" * 3000]
    langs += ["aa", "aa", "bb", None, "aa"]
    docs = docs_of(spark, texts, langs=langs)
    got = {r.doc_id: r for r in langid.identify(docs, langid.fitted(docs), keep=("doc_id", "score")).toDF("doc_id", "kept", "lang_pred", "score").collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[243].lang_pred in parts and got[244].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(docs, langid.fit(docs.where("false")))
    assert none.select("lang_pred").distinct().collect()[0][0] == "und"


def test_languages_of_few_rows(spark):
    """A language of one short row is learned, and takes nothing from the others."""
    rng = random.Random(90)
    parts = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["ser", "ton", "vel"]}
    texts = [" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)) for lang in ["aa", "bb"] * 80]
    docs = docs_of(spark, [*texts, "quyx zhogg fwip", "kalomi"], langs=["aa", "bb"] * 80 + ["qq", "xx"])
    filters = langid.fit(docs)
    assert sorted(filters.names) == ["aa", "bb", "qq", "xx"]
    got = langid.identify(docs_of(spark, ["zhogg quyx", *texts]), filters).orderBy("doc_id").collect()
    assert got[0].lang_pred == "qq" and np.mean([r.lang_pred == lang for r, lang in zip(got[1:], ["aa", "bb"] * 80, strict=True)]) > 0.97


def test_fit_writes_no_table_and_bounds_its_batches(spark, monkeypatch):
    """Learning writes nothing to the shared folder, hands at most 1000 texts at once to Python, and keeps the n-grams that counting finds."""
    from folioscope.llm import blocks

    rng = random.Random(91)
    texts = [" ".join("".join(rng.choice(["ka", "lo", "mi", "ru"]) for _ in range(3)) for _ in range(20)) for _ in range(60)]
    found = Counter(np.concatenate([langid.gram_hashes(blocks.block_of([t.encode()]))[0] for t in texts]).tolist())
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    monkeypatch.setattr(blocks, "shared_dir", lambda spark: pytest.fail("a table was written"))
    spark.conf.set(rows, "10000")
    try:
        for most in (40, 10**6):
            filters = langid.fit(docs_of(spark, texts, langs=["aa"] * 60), max_grams=most)
            least = min(c for c in found.values() if sum(x >= c for x in found.values()) <= most)
            kept = np.array([h for h, c in found.items() if c >= max(least, langid.MIN_COUNT)], np.uint64)
            assert len(kept) and np.array_equal(filters.table, langid.Filters({"aa": kept}, {"aa": 60}).table)
        assert int(spark.conf.get(rows)) <= 1000
    finally:
        spark.conf.set(rows, before)


def test_filters_have_no_false_negatives():
    grams = {"a": np.arange(1, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), "b": np.arange(5000, 5400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)}
    filters = langid.Filters(grams, {"a": 2, "b": 1})
    slots = langid._slots(grams["a"])
    mask = filters.table[0][slots[0]]
    for s in slots[1:]:
        mask = mask & filters.table[0][s]
    assert (mask & 1 == 1).all()


# ---- 2


def test_licenses(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES[0][1]
    broken = mit.replace("obtaining", "getting").replace("copy", "piece")
    texts = [None, "", "GNU  General-Public license; Apache LICENSE, cc by mit license", "gnu general", prose(rng, 50) + " CC-BY-NC 4.0", mit.upper(), "x " + broken + " y", mit.replace("free of charge", "at a charge"), "cc by cc by", "mit licenses", "cc\nby"]
    got = licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        w = WORD.findall(lower(t))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[5].labels == "mit" and got[6].labels == "mit" and 0.75 <= got[6].score < 1 and got[7].labels == "" and "cc-by-nc" in got[4].labels
    assert licenses.scan_licenses(docs_of(spark, texts).where("false")).count() == 0
    own = [("house", "Copyright (c) the House. All rights reserved, none given; ask first.", 0.8, ["all rights reserved"])]
    more = licenses.scan_licenses(docs_of(spark, ["copyright c the house all rights reserved none given ask us", "all rights reserved", mit]), more=own).orderBy("doc_id").collect()
    assert [r.labels for r in more] == ["house", "", ""]


# ---- 3


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vecs = [list(map(float, rng.normal(0, 0.3, 12))) for _ in range(160)]
    vecs[7] = vecs[8]
    rows = list(enumerate(vecs)) + [(160, None), (161, []), (162, [float("nan")] * 12), (163, [None] + vecs[1][1:]), (164, vecs[2][:5]), (165, [float("inf")] * 12), (100, vecs[3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for group in (16384, 40):
        got = topk.top_k(table, table.where("vec_id % 50 = 0"), group_rows=group, query_rows=2).collect()
        f = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
        good = [(i, f(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, v in good:
            if q % 50 == 0:
                scored = sorted(((-sum(a * b for a, b in zip(v, c)), i) for i, c in good if i != q))[:5]  # noqa: B905
                want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
        assert sorted(map(tuple, got)) == sorted(want), group


def test_top_k_of_thin_and_full_impacts():
    """Impacts with few entries go list by list, full ones by slabs of rows; both, and several slabs, agree with plain products."""
    rng = np.random.default_rng(33)
    v = np.floor(rng.normal(0, 60, (2 * topk.SLAB_ROWS + 700, 20)))
    v[:, 10:] *= rng.random((len(v), 10)) < 0.01
    v[:, 15:] *= 1000
    ids = rng.permutation(len(v))
    index, asked = topk.Postings(v, ids), np.arange(0, len(v), 30)
    thin = [sum(b - a for _, a, b in lists) * 32 < len(v) * len(lists) for _, lists in index.impacts]
    assert any(thin) and not all(thin)
    for (rows, scores), i in zip(topk.search(index, v[asked], ids[asked], 5), asked.tolist(), strict=True):
        all_scores = (v @ v[i]).astype(int).tolist()
        want = sorted((-s, x) for j, (s, x) in enumerate(zip(all_scores, ids.tolist(), strict=True)) if j != i)[:5]
        assert [(-s, x) for s, x in zip(scores, ids[rows].tolist(), strict=True)] == want


def test_top_k_of_large_components(spark):
    """Exact beyond 53 and 64 bits, with ties, a null id, and repeated rows."""
    rng = random.Random(31)
    big = [[rng.choice([1.0, -1e7, 2e7, 3.5e6, 1e7]) * rng.choice([1, 1, 0.5]) for _ in range(6)] for _ in range(90)]
    huge = [[rng.uniform(-1, 1) * 10.0 ** rng.randrange(25) for _ in range(6)] for _ in range(60)]
    for vecs in (big, huge, [[1e200] * 3, [2e200, 1.0, 0.0], [-1e200] * 3, [1.0] * 3]):
        rows = [(i * 10, v) for i, v in enumerate(vecs)] + [(77, vecs[1]), (77, vecs[1]), (None, vecs[2])]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
        got = topk.top_k(table, table.where("vec_id % 50 = 0"), group_rows=30).collect()
        good = [(i, [math.floor(256 * int(x)) if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows if i is not None]
        want = []
        for q, v in good:
            if q % 50 == 0:
                scored = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in good if i != q)[:5]
                want += [(q, k, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(scored, 1)]
        assert sorted(map(tuple, got)) == sorted(want)


# ---- 8


def test_urls(spark):
    rules = urlfilter.RULES
    urls = [None, "", "no scheme", "http://Sub.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org", "https://a.com/fr/#t", "https://a.com/de/", "https://xcom/de/", "http://x.net/a.org/b", "http://my-casino.net/", "http://h.org/" + "p" * 3000, "a://b.com/de/://c.org/", "http://u.com/fr", "http://x.net/casino", "http://free-bets.net/", "http://é.org/É"]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").select("page_id", "url")).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == (best[2] if best else "block" if u and ("casino" in host or "-bets." in host) else "allow")


def test_automaton_against_regex():
    rng = random.Random(8)
    globs = ["".join(rng.choice("ab*?/") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 14))) for _ in range(200)] + [""]
    texts += ["".join(rng.choice("ab/") for _ in range(rng.randrange(40, 90))) for _ in range(60)]
    globs += ["*a/*", "a*", "*/ab*b/", "*"]
    machine = urlfilter.Automaton(globs)

    def regex(g):
        out, slash = "", False
        for j, c in enumerate(g):
            out += ("." if slash or j == len(g) - 1 else "[^/]") + "*" if c == "*" else "." if c == "?" else re.escape(c)
            slash |= c == "/"
        return re.compile(out, re.S)

    raw = [t.encode() for t in texts]
    got = machine.run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[bool(regex(g).fullmatch(t)) for g in globs] for t in texts]
    assert got.tolist() == want and machine.words > 1


# ---- 10


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(10)
    long = "".join(chr(rng.choice([65, 233, 13, 10, 20013])) for _ in range(5000)) + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    html = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, long, long, "z" * 16384]
    ids = [5, 6, 7, 8, 9, 10, 3, 1, None, 20, 15, 2]
    pages = spark.createDataFrame(list(zip(ids, html, strict=True)), "page_id long, html string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, segment_bytes=700, records_per_file=4)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(ids) and {r.status for r in got} == {"ok"}
    first = {h: min(i for i, x in zip(ids, html, strict=True) if x == h and i is not None) for h in html}
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 1)
            continue
        h = html[ids.index(r.page_id)]
        raw = (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = len(raw) >= 100 and first[h] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))
        assert again or bytes(r.payload) == raw


def test_archives_of_several_gzip_members(spark, tmp_path):
    bodies = [b"first", b"second" * 50, b"third" * 700]
    raw = [[x + b"\r\n\r\n" for x in warc.records_of(f"n{i}", i, b, hashlib.sha256(b).hexdigest(), None, False, 900)] for i, b in enumerate(bodies)]
    assert len(raw[2]) > 1
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for rows in raw for x in rows))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(raw[0])) + b"\0" * 512)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload), r.status) for r in got) == sorted([(i, b, "ok") for i, b in enumerate(bodies)] + [(0, bodies[0], "ok")])


def test_records_with_bad_headers(spark, tmp_path):
    """A record whose numbers make no sense is a row with a status, and the next ones are read."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    whole = lambda i, b: b"".join(x + b"\r\n\r\n" for x in warc.records_of(f"n{i}", i, b, sha(b), None, False, 900))
    bad = [whole(1, b"one").replace(b"Content-Length: ", b"Content-Length: x"), whole(2, b"two").replace(b"WARC-Page-ID: 2", b"WARC-Page-ID: two"), whole(3, b"3" * 2000).replace(b"Segment-Number: 1", b"Segment-Number: first"), b"WARC/1.1\r\nWARC-Type: revisit\r\n\r\n\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join([bad[0], whole(4, b"four"), bad[1], whole(5, b"five"), bad[3], whole(6, b"six"), bad[2], whole(7, b"seven")]) + whole(8, b"eight")[:-20])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got if r.status == "ok"} == {(i, w) for i, w in ((4, b"four"), (5, b"five"), (6, b"six"), (7, b"seven"))}
    states = [r.status for r in got if r.status != "ok"]
    assert states.count("header") == 4 and "length" in states and "gap" in states


def test_broken_records():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc", 2)
    assert warc._decoded(block, hashlib.sha256(b"abc").hexdigest()) == (b"abc", "ok")
    assert warc._decoded(block[:-3], "x") == (None, "framing") and warc._decoded(block, "x")[1] == "digest"
    assert warc.dechunked(b"") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"0\r\n\r\n") == b""


# ---- 1


def test_mixing(spark):
    rng = random.Random(1)
    sources = ["big"] * 300 + ["mid"] * 60 + ["tiny"] * 5 + [None] * 10
    texts = [prose(rng, rng.randrange(0, 40)) for _ in sources]
    texts[3] = None
    docs = docs_of(spark, texts, sources=sources)
    got = {r.doc_id: r for r in mixing.mix_sources(docs, block_tokens=256).collect()}
    assert len(got) == len(texts)
    totals, taken = defaultdict(int), defaultdict(int)
    for i, t in enumerate(texts):
        n = len(WORD.findall(lower(t)))
        assert got[i].n_tokens == n and got[i].n_copies >= 1
        totals[sources[i]] += n
        taken[sources[i]] += n * got[i].n_copies
    most = max(totals.values())
    assert max(taken[s] / totals[s] for s in totals) <= 4.001
    exponent = 1 - math.log(4) / math.log(most / min(totals.values()))
    for s in totals:
        want = totals[s] * (most / totals[s]) ** (1 - exponent)
        assert want - 256 - 40 <= taken[s] <= want + 1, s
    entropy = mixing.mix_sources(docs, target_entropy=1.0, max_repeats=None).select("source", "weight").distinct().collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in entropy) - 1.0) < 1e-6
    few = mixing.mix_sources(docs, budget_tokens=500, max_repeats=1.0, block_tokens=64)
    assert few.agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).first()[0] <= 500
    assert mixing.realise(few).count() == few.agg(F.sum("n_copies")).first()[0]
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mix_sources(docs_of(spark, ["a b", "a b"], ids=[1, 1])).count() == 2
    same = mixing.mix_sources(docs_of(spark, [f"w{i} b c" for i in range(200)], ids=[None] * 100 + [1] * 100), block_tokens=30, carry="lang")
    assert same.select("block").distinct().count() > 4 and {r.carried for r in same.select("carried").collect()} == {"en"}


# ---- 7


def test_toxicity(spark):
    rng = random.Random(7)
    texts, labels = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randrange(3, 40), 60).split()
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilex", "grubo", "snarkest"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    texts += [None, ""]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (999999, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs.where(~toxicity.held_out()), table.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i].score >= 0.3) == labels[i] for i in held]) > 0.97
    i = next(i for i in held if labels[i])
    spans = [texts[i].encode()[a:b].decode() for a, b in zip(got[i].toxic_from, got[i].toxic_to, strict=True)]
    assert any(w in " ".join(spans) for w in ("vilex", "grubo", "snarkest"))
    assert got[600].score == got[601].score < 0.3
    empty = toxicity.score(docs, toxicity.fit(docs.where("false"), table)).select("score").distinct().collect()
    assert [r.score for r in empty] == [0.0]


def test_windows_of_the_chain_are_a_parameter(spark, monkeypatch):
    texts = ["vilex good words here " * 40 if i % 2 else "good words here only " * 40 for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    seen, plain = [], toxicity._fit_chain
    monkeypatch.setattr(toxicity, "_fit_chain", lambda index, *more: seen.append(len(index)) or plain(index, *more))
    for most in (40, 200):
        toxicity.fit(docs_of(spark, texts), labels, max_windows=most)
    assert seen == [40, 200]


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(70)
    chain = toxicity.Chain(np.array([1], np.uint64), np.array([1.0]), -0.7, np.array([[1.0, 0.2], [0.5, 0.9]]), np.empty(0), 0.5)
    counts = np.array([0, 7, 1, 12])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.array([1, 2, 5, 7, 11, 19])
    weight = rng.normal(0, 2, len(at))
    got = dict(zip(at.tolist(), chain.marginals(counts, bounds, at, weight), strict=True))
    full = np.zeros(bounds[-1])
    full[at] = weight
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n = hi - lo
        total, on = 0.0, np.zeros(n)
        for code in range(2**n) if n else ():
            s = [(code >> k) & 1 for k in range(n)]
            p = [1.0, 1e-3][s[0]]
            for k in range(n):
                p *= (chain.trans[s[k - 1], s[k]] if k else 1.0) * (math.exp(chain.bias + full[lo + k]) if s[k] else 1.0)
            total += p
            on += p * np.array(s)
        for k in range(n):
            if lo + k in got:
                assert abs(got[lo + k] - on[k] / total) < 1e-9


# ---- 6


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute6(ids, texts):
    sets, top = [shingles(t) for t in texts], {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                top[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in zip(ids, sets, strict=True)]


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "ONE", "a b c d e", "a b c d e f", "é b c d e"]
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 200), 4000).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(9))
            texts.append(" ".join(copy))
    ids = rng.sample(range(10000), len(texts))
    got = neardup.near_duplicates(docs_of(spark, texts, ids=ids)).collect()
    want = brute6(ids, texts)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = neardup.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "x y", "x y", "q"], ids=[1, 1, None, 7, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("1", "1", True), ("1", "1", True), ("7", "7", True), ("None", "None", True), ("None", "None", True)]
    assert neardup.near_duplicates(docs_of(spark, texts).where("false")).count() == 0


def test_links_fill_few_files(spark, monkeypatch):
    """Links come from many tasks, but few links make few files; no link is lost."""
    rng = random.Random(66)
    texts = []
    for _ in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(80)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:-3], "less"])]
    files, keep = [], neardup.stored

    def counted(df, label):
        out = keep(df, label)
        if label == "links":
            files.append((len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts).repartition(8)).collect()}
    assert got == {i: i - i % 3 for i in range(120)}
    assert len(files) == 2 and all(n == 1 and rows >= 80 for n, rows in files), files


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(60)
    both = rng.integers(1, 2**63, 900, dtype=np.uint64)
    a, b = both[:800], both[100:]
    sets = [np.sort(a), np.sort(b), np.sort(both)]
    regs = neardup.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).mean() > 0.99
    same = neardup.statistic(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([800.0]), np.array([800.0]), 0.75)
    assert same[0] < neardup.LR


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# ---- 5


def brute5(ids, texts):
    seen, out = defaultdict(lambda: 2**63), {}
    raws = [(t or "").encode() for t in texts]
    for i, raw in zip(ids, raws, strict=True):
        for k in range(len(raw) - 49):
            g = raw[k : k + 50]
            seen[g] = min(seen[g], 2**62 if i is None else i)
    for i, raw in zip(ids, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if seen[raw[k : k + 50]] < (2**62 if i is None else i):
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.setdefault(i, []).append((len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("shard", "hot"), [(1 << 12, 1 << 16), (5, 1 << 16), (1 << 12, 2), (5, 2)])
def test_repeated_passages(spark, shard, hot):
    """Whole buckets in a shard, buckets in several, and picks of many contexts dealt by context."""
    rng = random.Random(5)
    pool = [prose(rng, rng.randrange(5, 40), 90) for _ in range(12)] + ["ab" * 60, "a" * 140, "é" * 40]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 50]
    for _ in range(45):
        cut = [p[rng.randrange(20) : len(p) - rng.randrange(20)] for p in rng.sample(pool, 3)]
        texts.append(" ".join([prose(rng, 4, 5000), *cut]))
    ids = rng.sample(range(1000), len(texts))
    ids[8], ids[9] = ids[10], None
    got = suffixdedup.repeated_passages(docs_of(spark, texts, ids=ids), shard_contexts=shard, hot_contexts=hot, sample=2).collect()
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = brute5(ids, texts)
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[1] for v in want.values() for x in v) > 1000
    assert suffixdedup.repeated_passages(docs_of(spark, texts).where("false")).count() == 0


def test_repeated_passages_in_long_texts(spark):
    """A text of over a million bytes, one that is all one letter, rows that repeat, and a common edge of many contexts."""
    rng = random.Random(51)
    edge = prose(rng, 3, 80)
    long = prose(rng, 9, 150000)
    texts = [long, "x" + long[300000:700000], "a" * 5000, "a" * 4000, *(edge + prose(rng, 9, 40) for _ in range(60)), *["same text " * 12] * 3]
    ids = [*range(len(texts) - 3), 900, 900, 900]
    docs = docs_of(spark, texts, ids=ids).repartition(5)
    got = suffixdedup.repeated_passages(docs, keep=("doc_id", "text"), shard_contexts=9, hot_contexts=8, sample=1, edited=True).collect()
    want = brute5(ids, texts)
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted((k, x) for k, v in want.items() for x in v)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got) and got[0].text is not None


@pytest.mark.parametrize("block_bytes", [1 << 22, 256])
def test_repeated_passages_stay_in_their_shards(spark, monkeypatch, block_bytes):
    """Buckets of many small picks: no string leaves its shard, no pass sends all contexts; of many blocks, several send together."""
    rng = random.Random(53)
    pool = [prose(rng, 14, 400) for _ in range(1200)]
    use = [p[rng.randrange(12) : len(p) - rng.randrange(12)] for p in pool for _ in range(4)]
    rng.shuffle(use)
    texts = [" ".join(x for y in use[k : k + 12] for x in (y, prose(rng, 2, 5000))) for k in range(0, len(use), 12)]
    ids = rng.sample(range(9000), len(texts))
    tables, sent = [], []

    def stored(df, label, write=suffixdedup.stored):
        tables.append(write(df, label))
        return tables[-1]

    def grouped(df, keys, fn, schema, *more, run=suffixdedup.map_groups, **named):
        out = run(df, keys, fn, schema, *more, **named)
        if out.columns[0] == "bucket":
            sent.append(sum(len(r["keys"]) for r in out.select("keys").collect()))
        return out

    monkeypatch.setattr(suffixdedup, "stored", stored)
    monkeypatch.setattr(suffixdedup, "map_groups", grouped)
    got = suffixdedup.repeated_passages(docs_of(spark, texts, ids=ids), shard_contexts=40, block_bytes=block_bytes).collect()
    want = brute5(ids, texts)
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted((k, x) for k, v in want.items() for x in v)
    assert sum(x[1] for v in want.values() for x in v) > 100000
    strings = [t for t in tables if "strings" in t.columns]
    assert len(strings) == 1 and strings[0].where("kind = 0").count() and not strings[0].where("kind > 0").count()
    assert max(sent) < 0.6 * sum(sent)


def test_runs_merge_by_bytes():
    rng = np.random.default_rng(52)
    strings = np.unique(np.frombuffer(rng.integers(0, 256, 50 * 300, dtype=np.uint8).tobytes(), "S50"))
    runs, want = [], {}
    for _ in range(7):
        own = np.sort(rng.choice(strings, 90, replace=False))
        doc = rng.integers(0, 1000, 90)
        runs.append((own, doc))
        for s, d in zip(own.tolist(), doc.tolist(), strict=True):
            want[s] = min(d, want.get(s, d))
    value, doc = suffixdedup.smallest(runs)
    assert value.tolist() == sorted(want) and dict(zip(value.tolist(), doc.tolist(), strict=True)) == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(50)
    pieces = [bytes(rng.integers(97, 99, rng.integers(50, 82), dtype=np.uint8)) for _ in range(40)]
    pieces = list(dict.fromkeys(pieces + [p[:-1] + b"z" for p in pieces[:20]]))
    counts = np.array([len(p) - 49 for p in pieces])
    cls, piece, number = suffixdedup.distinct_strings(pieces, counts)
    by = defaultdict(set)
    for c, p, n in zip(cls, piece, number, strict=True):
        by[int(c)].add(pieces[p][n : n + 50])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({v for s in by.values() for v in s})
