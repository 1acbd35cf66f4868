"""URL filters: wildcard rules simulated together by a bit-parallel automaton.

Every rule is a glob over the canonical form ``.host/path`` (host in lower
case, without query and fragment).  ``*`` before the first ``/`` of a glob stays
inside the host, after it takes anything; ``?`` takes one byte.  All globs' states lie side by side in
64-bit words: one step shifts every word with its carry, masks it by the byte's
literals and keeps the states whose star takes the byte.  A step runs at once for
all URLs of a block that are long enough and whose states can still change.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no prefix rule.  The longest fitting prefix rule decides (equal length:
block, then the smaller string); else any fitting glob blocks; else ``allow``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import Block, map_blocks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The method's own rules: hosts of gambling, advertising and adult sites.
GLOBS = ["*casino*", "*-bets.*", "*.ads-*", "*.adserver.*", "*poker*", "*.xxx/*", "*porn*"]


class Automaton:
    """Shift-And over several words for a list of globs."""

    def __init__(self, globs: list[str]):
        self.globs, self.start, self.final = globs, [], []
        literals: list[int] = [-1]
        stars: list[int] = [0]  # 0 none, 1 host bytes, 2 any
        for glob in globs:
            slash = False
            literals.append(-1)
            stars.append(0)
            self.start.append(len(literals) - 1)
            raw = glob.encode()
            for j, c in enumerate(raw):
                if c == ord("*"):
                    stars[-1] = 2 if slash or j == len(raw) - 1 else 1
                else:
                    slash |= c == ord("/")
                    literals.append(256 if c == ord("?") else c)
                    stars.append(0)
            self.final.append(len(literals) - 1)
        self.words = -(-len(literals) // 64)
        lit, star = np.array(literals), np.array(stars)
        self.shift = np.zeros((self.words, 256), np.uint64)
        self.stay = np.zeros((self.words, 256), np.uint64)
        for c in range(256):
            self.shift[:, c] = self._pack((lit == c) | (lit == 256))
            self.stay[:, c] = self._pack((star == 2) | ((star == 1) & (c != ord("/"))))
        begin = np.zeros(len(lit), bool)
        begin[self.start] = True
        self.begin = self._pack(begin)
        end = np.zeros(len(lit), bool)
        end[self.final] = True
        #: ends that take whatever follows
        self.settled = self._pack(end & (star == 2))

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.words * 64, bool)
        bits[: len(flags)] = flags
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def run(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which glob takes which text, as a matrix of texts by globs."""
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        starts, longest = offs[:-1][order], size[order]
        state = np.repeat(self.begin[:, None], len(size), 1)
        live, now = np.arange(len(size)), state
        for step in range(int(longest[0]) if len(size) else 0):
            n = int(np.searchsorted(-longest[live], -step, "left"))
            if n < len(live):  # these texts have ended
                state[:, live[n:]] = now[:, n:]
                live, now = live[:n], now[:, :n]
            if not len(live):
                break
            byte = data[starts[live] + step]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[1:] |= now[:-1] >> np.uint64(63)
            now = (moved & self.shift[:, byte]) | (now & self.stay[:, byte])
            if step % 16 == 15:
                # texts of which no glob is left, or none that is not settled
                go = (now & ~self.settled[:, None]).any(0)
                if not go.all():
                    state[:, live[~go]] = now[:, ~go]
                    live, now = live[go], now[:, go]
        state[:, live] = now
        out = np.zeros((len(size), len(self.globs)), bool)
        for g, bit in enumerate(self.final):
            out[order, g] = (state[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", rules: list[tuple[str, str, str]] = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """keep's columns with host, path, rule and verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    names = [h + p for _, h, p in ranked]

    def make():
        machine = Automaton([f"*.{h}{p}*" for _, h, p in ranked] + globs)

        def fn(block: Block) -> list:
            fits = machine.run(block.data, block.offs)
            base, own = fits[:, : len(ranked)], fits[:, len(ranked) :].any(1)
            some, first = base.any(1), base.argmax(1) if ranked else np.zeros(len(block), int)
            rule = [names[i] if s else None for i, s in zip(first, some, strict=True)]
            verdict = [ranked[i][0] if s else "block" if o else "allow" for i, s, o in zip(first, some, own, strict=True)]
            return [rule, verdict]

        return fn

    named = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = named.withColumn("__url", F.concat(F.lit("."), "host", "path"))
    return map_blocks(named, "__url", [*keep, "host", "path"], "rule string, verdict string", make)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


SQL8 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC, v DESC, rh || rp) AS n
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, rule, CASE WHEN v IS NOT NULL THEN v
  WHEN contains(h.host, 'casino') OR contains('.' || h.host, '-bets.') OR contains('.' || h.host, '.ads-') OR contains('.' || h.host, '.adserver.') OR contains(h.host, 'poker') OR contains('.' || h.host || h.path, '.xxx/') AND ends_with('.' || h.host, '.xxx') OR contains(h.host, 'porn') THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN fit ON h.page_id = fit.page_id AND h.host = fit.host AND h.path = fit.path AND n = 1
"""
