"""License scans over a positional index of rare words.

Templates are short licence passages; the base phrases are templates of which
every word is mandatory.  One pass over all texts counts in how many of them
each template word occurs.  A template's anchors are its words of highest IDF,
as many as it takes that any text with enough of the template holds one of them
(one for a base phrase).  A scan looks the words of a text up in the template
vocabulary, turns each anchor word into alignments (text position less template
position), intersects the template's postings with the text at each alignment,
and keeps an alignment if it has the template's share of words in place and all
words of its key phrases.

Defined results: null is the empty text, without words and labels, of score 0.
``score`` is the best share of a template's words found in place among the
alignments kept, so 1 for a base phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import ALNUM, Block, block_of, blocks, map_blocks

#: phrase, label
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: label, template, share of its words that must stand in place, key phrases
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.75, ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.75, ["source and binary forms"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.75, ["free software", "redistribute it"]),
    ("lgpl", "gnu lesser general public license", 1.0, []),
    ("agpl", "gnu affero general public license", 1.0, []),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.75, ["in compliance with the license"]),
    ("mpl", "mozilla public license", 1.0, []),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.75, ["for any purpose"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.8, ["public domain"]),
    ("cc-by", "creative commons attribution", 1.0, []),
    ("cc-by-nc", "cc by nc", 1.0, []),
    ("cc-by-sa", "cc by sa", 1.0, []),
    ("cc0", "cc0 1 0 universal", 1.0, []),
]


class Template:
    def __init__(self, label: str, text: str, share: float, keys: list[str], base: bool):
        self.label, self.share, self.base = label, share, base
        own = block_of([text.encode()]).words(ALNUM)
        self.words, self.hashes = own.bytes_of(0, len(own)).split(b" "), own.hashes
        self.key_at = np.zeros(len(self.words), bool)
        for key in keys:
            own = block_of([key.encode()]).words(ALNUM)
            part = own.bytes_of(0, len(own)).split(b" ")
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            self.key_at[at : at + len(part)] = True
        if share >= 1:
            self.key_at[:] = True
        self.anchors: list[int] = []

    def choose(self, idf: dict[int, float]) -> None:
        """Anchor positions: any share of the words that counts leaves too few out to miss all of them."""
        spare = len(self.words) - int(np.ceil(self.share * len(self.words) - 1e-9))
        ranked = sorted(range(len(self.words)), key=lambda i: (-idf[int(self.hashes[i])], i))
        self.anchors = ranked[: spare + 1]


class Index:
    def __init__(self, templates: list[Template], idf: dict[int, float]):
        self.templates, self.idf = templates, idf
        for t in templates:
            t.choose(idf)
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for n, t in enumerate(templates):
            for at in t.anchors:
                self.postings.setdefault(int(t.hashes[at]), []).append((n, at))
        self.keys = np.sort(np.fromiter(self.postings, np.uint64, len(self.postings)))
        self.front = np.zeros(1 << 16, bool)
        self.front[self.keys >> np.uint64(48)] = True

    def places(self, block: Block) -> tuple:
        """Words, and of each alignment kept: template, text, first word, share in place."""
        words = block.words(ALNUM)
        out: list[tuple[int, int, int, float]] = []
        if len(words) and len(self.keys):
            hashes = words.hashes
            near = np.flatnonzero(self.front[hashes >> np.uint64(48)])
            near = near[np.isin(hashes[near], self.keys)]
            starts: dict[int, list[np.ndarray]] = {}
            for key in np.unique(hashes[near]):
                at = near[hashes[near] == key]
                for n, place in self.postings[int(key)]:
                    starts.setdefault(n, []).append(at - place)
            for n, found in starts.items():
                t = self.templates[n]
                first = np.unique(np.concatenate(found))
                first = first[(first >= 0) & (first + len(t.words) <= len(words))]
                owner = np.searchsorted(words.bounds, first, "right") - 1
                good = first + len(t.words) <= words.bounds[owner + 1]
                first, owner = first[good], owner[good]
                same = hashes[first[:, None] + np.arange(len(t.words))[None, :]] == t.hashes[None, :]
                share = same.mean(1)
                keep = np.flatnonzero((share >= t.share - 1e-9) & same[:, t.key_at].all(1))
                for i in keep.tolist():
                    got = words.bytes_of(int(first[i]), int(first[i]) + len(t.words)).split(b" ")
                    place = [a == b for a, b in zip(got, t.words, strict=True)]
                    if sum(place) >= t.share * len(place) - 1e-9 and all(p or not k for p, k in zip(place, t.key_at, strict=True)):
                        out.append((n, int(owner[i]), int(first[i]), sum(place) / len(place)))
        return words, out

    def scan(self, block: Block) -> list:
        words, found = self.places(block)
        n = len(block)
        starts: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        score = np.zeros(n)
        for t, text, first, share in found:
            own = self.templates[t]
            labels[text].add(own.label)
            score[text] = max(score[text], share)
            if own.base:
                base[text].add(own.label)
                starts[text].append(first - int(words.bounds[text]))
        return [words.counts, [len(s) for s in starts], [min(s, default=None) for s in starts], [max(s, default=None) for s in starts], [",".join(sorted(b)) for b in base], [",".join(sorted(x)) for x in labels], score]


def templates(more: list[tuple[str, str, float, list[str]]] = TEMPLATES) -> list[Template]:
    return [Template(label, text, 1.0, [], True) for text, label in BASE] + [Template(label, text, share, keys, False) for label, text, share, keys in more]


def vocabulary_idf(docs: DataFrame, known: list[Template], text: str = "text") -> dict[int, float]:
    """IDF of each template word over all texts; one row of counts a batch leaves the executors."""
    vocab = np.unique(np.concatenate([t.hashes for t in known]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                words = block.words(ALNUM)
                n += len(block)
                if len(words):
                    h = words.hashes
                    slot = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                    at = np.flatnonzero(vocab[slot] == h)
                    owner = np.searchsorted(words.bounds, at, "right") - 1
                    seen = np.unique(owner * len(vocab) + slot[at])
                    total += np.bincount(seen % len(vocab), minlength=len(vocab))
        slots = np.concatenate([np.flatnonzero(total), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.concatenate([total[total > 0], [n]]), pa.int64())], names=["slot", "n"])

    got = {r["slot"]: r["n"] for r in docs.select(text).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    return {int(h): float(np.log((n + 1) / (got.get(i, 0) + 1))) for i, h in enumerate(vocab)}


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", more: list[tuple[str, str, float, list[str]]] = TEMPLATES) -> DataFrame:
    """keep's columns with n_words, n_base, first_word, last_word, base_labels, labels, score; more are templates as TEMPLATES has them, whole licence texts too."""
    known = templates(more)
    shared = docs.sparkSession.sparkContext.broadcast(Index(known, vocabulary_idf(docs, known, text)))  # the templates' words
    return map_blocks(docs, text, list(keep), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", lambda: shared.value.scan)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql2() -> str:
    """The scan in SQL: words meet template words, and alignments are counted."""
    words, heads = [], []
    for n, t in enumerate(templates()):
        least = int(np.ceil(t.share * len(t.words) - 1e-9))
        heads.append(f"({n}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {least}, {int(t.key_at.sum())})")
        words += [f"({n}, {i}, '{w.decode()}', {str(bool(k)).lower()})" for i, (w, k) in enumerate(zip(t.words, t.key_at, strict=True))]
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(tid, label, base, n, least, n_key) AS (VALUES {", ".join(heads)}),
tw(tid, tpos, word, is_key) AS (VALUES {", ".join(words)}),
dw AS (SELECT doc_id, len(w) AS n_words, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
a AS (SELECT doc_id, n_words, tid, pos - tpos AS first, count(*) AS held, count(*) FILTER (is_key) AS keys FROM dw JOIN tw ON dw.word = tw.word GROUP BY ALL),
k AS (SELECT doc_id, first, label, base, held / n AS share FROM a JOIN t ON a.tid = t.tid WHERE held >= least AND keys = n_key AND first >= 0 AND first + n <= n_words),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
