"""Benchmark decontamination by greedy string tiling.

Words (runs of letters, digits and underscores, lower-cased) of the benchmark are hashed; Karp-Rabin hashes of all runs of
``k`` words are the seeds. A document's running hashes are looked up among the seeds; shared seeds of one diagonal join
into maximal matches, which are verified on the words' hashes. Tiling then repeatedly marks the longest match whose words
are still free in the document and in the test; a match that lost words to an earlier tile is cut and queued again if at
least ``k`` words are left. A document is contaminated by a test if the tiles cover at least ``coverage`` of the test's
words, in whatever order they stand. Tests of fewer than ``k`` words must be contained whole.

The benchmark is taken in blocks of about BLOCK_WORDS words, each sent to all tasks: the documents are passed once per
block, nothing is shuffled, and no benchmark is too large. Nulls and odd cases: null or wordless texts and tests never
match; null ids are kept in the result; repeated documents and tests are each judged; texts of any length are tiled whole;
further columns are left out of the report and kept by the filter; empty tables give no pair.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import SLICE, column, map_slices, need, texts
from panelwright.session import small_batches
from panelwright.llm.tokens import U, windows

WORD = re.compile(r"\w+")
BLOCK_WORDS = 400_000
SIEVE = 1 << 20


def hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word."""
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))


@dataclass
class Tests:
    """One block of the benchmark, ready for lookups."""

    k: int
    ids: list[int | None]
    words: list[np.ndarray]
    #: Per seed length: sorted seed hashes with test and position, and a sieve over their low bits.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], k: int) -> Tests:
        rows = sorted(((i, t) for i, t in rows if t), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        words = [hashes(t) for _, t in rows]
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for n, w in enumerate(words):
            if len(w):
                by_length[min(k, len(w))].append((windows(w, min(k, len(w))), n))
        seeds = {}
        for length, found in by_length.items():
            h = np.concatenate([x for x, _ in found])
            test = np.concatenate([np.full(len(x), n) for x, n in found])
            at = np.concatenate([np.arange(len(x)) for x, _ in found])
            order = np.lexsort((at, test, h))
            sieve = np.zeros(SIEVE, bool)
            sieve[(h & U(SIEVE - 1)).astype(np.int64)] = True
            seeds[length] = h[order], test[order], at[order], sieve
        return cls(k, [i for i, _ in rows], words, seeds)

    def matches(self, doc: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal matches by test: (length, start in the document, start in the test)."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for length, (h, test, at, sieve) in self.seeds.items():
            w = windows(doc, length)
            i = np.flatnonzero(sieve[(w & U(SIEVE - 1)).astype(np.int64)])
            if not len(i):
                continue
            low, high = np.searchsorted(h, w[i], "left"), np.searchsorted(h, w[i], "right")
            n = high - low
            if not n.any():
                continue
            d = np.repeat(i, n)
            s = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            order = np.lexsort((d, d - at[s], test[s]))
            d, s = d[order], s[order]
            new = np.ones(len(d), bool)
            new[1:] = (test[s][1:] != test[s][:-1]) | (at[s][1:] - at[s][:-1] != 1) | (d[1:] - d[:-1] != 1)
            start = np.flatnonzero(new)
            for b, e in zip(start, np.append(start[1:], len(d))):
                t, di, ti, size = int(test[s[b]]), int(d[b]), int(at[s[b]]), int(e - b) + length - 1
                if np.array_equal(doc[di : di + size], self.words[t][ti : ti + size]):
                    out[t].append((size, di, ti))
        return out

    def tile(self, t: int, found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """Words covered, tiles and longest tile of test ``t`` by greedy tiling."""
        least = min(self.k, len(self.words[t]))
        queue = [(-size, d, i) for size, d, i in found]
        heapq.heapify(queue)
        in_doc, in_test = set(), np.zeros(len(self.words[t]), bool)
        covered = tiles = longest = 0
        while queue and covered < len(in_test):
            size, d, i = heapq.heappop(queue)
            size = -size
            free = [not in_test[i + j] and d + j not in in_doc for j in range(size)]
            if all(free):
                in_test[i : i + size] = True
                in_doc.update(range(d, d + size))
                covered, tiles, longest = covered + size, tiles + 1, max(longest, size)
                continue
            at = 0
            while at < size:  # what is left of the match, in pieces
                if free[at]:
                    end = at
                    while end < size and free[end]:
                        end += 1
                    if end - at >= least:
                        heapq.heappush(queue, (at - end, d + at, i + at))
                    at = end
                at += 1
        return covered, tiles, longest

    def judge(self, text: str | None, coverage: float) -> Iterator[tuple[int | None, float, int, int]]:
        """(item_id, share of the test's words covered, tiles, longest tile) of the tests that contaminate a text."""
        doc = hashes(text)
        found = self.matches(doc)
        for t in sorted(found):
            n = len(self.words[t])
            if len({i + j for size, _, i in found[t] for j in range(size)}) < coverage * n:
                continue  # not even all matches together
            covered, tiles, longest = self.tile(t, found[t])
            if covered >= coverage * n:
                yield self.ids[t], covered / n, tiles, longest


def blocks(benchmark: DataFrame, k: int) -> Iterator[Tests]:
    """The benchmark in blocks of bounded size, in no particular order."""
    b = need(benchmark, item_id="long", text="string").where(F.col("text").isNotNull())
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (6 * BLOCK_WORDS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n > 1 else F.lit(0)
    for j in range(n):
        rows = [(r.item_id, r.text) for r in b.where(part == j).collect()]  # about BLOCK_WORDS words
        if rows:
            yield Tests.of(rows, k)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.6) -> DataFrame:
    """Pairs: doc_id, item_id, coverage, n_tiles, longest (words)."""
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int"
    d = need(docs, doc_id="long", text="string")
    sc = docs.sparkSession.sparkContext

    def pass_over(sent) -> DataFrame:
        def run(batch):
            found = [(i, *x) for i, t in zip(column(batch, "doc_id").to_pylist(), texts(batch)) for x in sent.value.judge(t, coverage)]
            return {n: [f[c] for f in found] for c, n in enumerate(["doc_id", "item_id", "coverage", "n_tiles", "longest"])}

        return map_slices(d, run, schema)

    out = None
    for tests in blocks(benchmark, k):
        got = pass_over(sc.broadcast(tests))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, that no test contaminates."""
    sc = docs.sparkSession.sparkContext

    def pass_over(rest: DataFrame, sent) -> DataFrame:
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield part.filter(pa.array([next(sent.value.judge(t, coverage), None) is None for t in texts(part)], pa.bool_()))

        return small_batches(rest).mapInArrow(run, rest.schema)

    for tests in blocks(benchmark, k):
        docs = pass_over(docs, sc.broadcast(tests))
    return docs
