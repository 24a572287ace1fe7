"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all lower-cased words of a bounded sample of labelled texts, and those beginnings (PREFIXES letters) of longer
words whose document frequencies differ between the labels. A weight is (1 + ln tf) x IDF, times BOOST for terms that differ
between the labels beyond chance: by a log-likelihood ratio of at least MIN_G2, so that chance finds none among millions of
terms, and by a factor of at least LIFT. Vectors have length 1.

The examples' inverted index holds, per term, its examples in order; per term and block of BLOCK examples, where the block's
entries lie and the largest weight. A search first sums the terms that few examples have, over all blocks; the ``k``-th best
of these partial cosines is a floor. A block whose best partial cosine plus the sum of the block maxima of the frequent
terms stays below the floor is skipped; in the others the frequent terms are added too. The neighbours are exact, ties go
to the smaller position in the index. Neighbours vote with weight cosine / (1.05 - cosine), times the labelled documents
they stand for, beside a small vote of the base rate; the vote is calibrated by isotonic regression on the sample's
leave-one-out votes, weighted back to the labels' frequencies.

Sample (documented bound): per label the PER_LABEL learnable labelled documents with the smallest hash of doc_id. The index
holds the distinct words of these texts and nothing else: it grows with the length of a text, not with the table.

Nulls and odd cases: null and empty texts, and texts without a term of the index, get the calibrated rate of examples
without neighbours; labels other than 0 and 1, null ids and labels without a document are not learnt from; of repeated rows
of one id one is learnt from and each is scored; without any toxic example every score is 0; whole texts are read; further
columns are left out of scores and kept by the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import SLICE, column, held_out, learnable, map_slices, need, smallest_hashes, texts
from panelwright.session import small_batches

PER_LABEL, MIN_G2, MIN_DF, LIFT, BOOST = 2500, 34.0, 3, 4.0, 40.0
PREFIXES, BLOCK, NEIGHBOURS, PRIOR = (4, 5, 6, 7), 64, 15, 0.25
#: Terms that a larger share of the examples has are added last, where the blocks' maxima allow.
FEW = 0.125
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def heads_of(vocabulary) -> dict[str, list[tuple[str, str]]]:
    """The beginnings in a vocabulary by their first letters, as (beginning, term)."""
    out: dict[str, list[tuple[str, str]]] = {}
    for t in vocabulary:
        if t.endswith("*"):
            out.setdefault(t[: PREFIXES[0]], []).append((t[:-1], t))
    return out


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of runs given by start and size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Postings:
    """Sparse inverted index of example vectors, with block maxima."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([np.empty(0, np.int64), *(r for r, _ in vectors)])
        at = np.repeat(np.arange(self.n), [len(r) for r, _ in vectors])
        w = np.concatenate([np.empty(0), *(x for _, x in vectors)])
        order = np.lexsort((at, term))
        term, self.example, self.weight = term[order], at[order].astype(np.int32), w[order]
        self.size = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(self.size) - self.size
        # Entries of one term in one block lie side by side.
        key = term * max(1, self.blocks) + self.example // BLOCK
        self.b_first = np.flatnonzero(np.diff(key, prepend=-1))
        self.b_size = np.diff(np.append(self.b_first, len(key)))
        self.b_max = np.maximum.reduceat(self.weight, self.b_first) if len(key) else np.empty(0)
        self.b_block = (key[self.b_first] % max(1, self.blocks)).astype(np.int32)
        self.t_size = np.bincount(term[self.b_first], minlength=n_terms)
        self.t_start = np.cumsum(self.t_size) - self.t_size

    def nearest(self, rows: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples with a positive cosine, exactly."""
        few = self.size[rows] <= FEW * self.n
        r, x = rows[few], w[few]
        at = expand(self.start[r], self.size[r])
        cosine = np.bincount(self.example[at], self.weight[at] * np.repeat(x, self.size[r]), self.n).astype(float)
        r, x = rows[~few], w[~few]
        if len(r):
            # Block entries of the frequent terms, and what these can add to a cosine in each block.
            e = expand(self.t_start[r], self.t_size[r])
            x = np.repeat(x, self.t_size[r])
            rest = np.bincount(self.b_block[e], self.b_max[e] * x, self.blocks)
            partial = cosine.copy()
            if without >= 0:
                partial[without] = -1.0
            floor = np.partition(partial, self.n - k)[self.n - k] if self.n > k else -1.0
            best = np.full(self.blocks * BLOCK, -1.0)
            best[: self.n] = partial
            open_ = best.reshape(self.blocks, BLOCK).max(axis=1) + rest >= floor - 1e-9
            use = open_[self.b_block[e]]
            e, x = e[use], x[use]
            at = expand(self.b_first[e], self.b_size[e])
            cosine += np.bincount(self.example[at], self.weight[at] * np.repeat(x, self.b_size[e]), self.n)
            cosine[~np.repeat(open_, BLOCK)[: self.n]] = 0.0  # below the floor, whatever the frequent terms add
        if without >= 0:
            cosine[without] = 0.0
        found = np.flatnonzero(cosine > 0)
        if len(found) > k:
            found = found[cosine[found] >= np.partition(cosine[found], len(found) - k)[len(found) - k] - 1e-12]
        order = np.lexsort((found, -cosine[found].round(12)))[:k]
        return found[order], cosine[found[order]]


@dataclass
class Index:
    at: dict[str, int]  # term -> row
    heads: dict[str, list[tuple[str, str]]]
    factor: np.ndarray  # IDF, boosted
    postings: Postings
    labels: np.ndarray
    stands: np.ndarray  # labelled documents an example stands for, on average 1
    ids: np.ndarray
    base: float
    grid: np.ndarray  # calibration: votes and rates, both ascending
    rates: np.ndarray
    bare: float  # rate of texts without neighbours

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weights (length 1) of a text's terms."""
        at, heads, short = self.at, self.heads, PREFIXES[0]
        got = {at[w]: n for w, n in counts.items() if w in at}
        if heads:
            for w, n in counts.items():
                if w[:short] in heads:
                    for p, t in heads[w[:short]]:
                        if len(w) > len(p) and w.startswith(p):
                            got[at[t]] = got.get(at[t], 0) + n
        rows = np.fromiter(got, np.int64, len(got))
        if not len(rows):
            return rows, np.empty(0)
        w = (1 + np.log(np.fromiter(got.values(), float, len(got)))) * self.factor[rows]
        order = np.argsort(rows)
        return rows[order], w[order] / np.sqrt(w @ w)

    def nearest(self, rows: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.postings.nearest(rows, w, k, without)

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine / (1.05 - np.minimum(cosine, 1.0)) * self.stands[at]
        return float((w @ self.labels[at] + PRIOR * self.base) / (w.sum() + PRIOR))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        rows, w = self.vector(words(text))
        if len(rows):
            at, cosine = self.nearest(rows, w)
            if len(at):
                return float(np.interp(self.vote(at, cosine), self.grid, self.rates)), [(int(self.ids[i]), float(c), int(self.labels[i])) for i, c in zip(at[:3], cosine[:3])]
        return self.bare, []


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of x and of y per block, ascending."""
    blocks: list[list[float]] = []
    for k in np.argsort(x, kind="stable"):
        blocks.append([w[k] * x[k], w[k] * y[k], w[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 1e-3 * 0.5) / (b[:, 2] + 1e-3)


class Sample:
    """Labelled word counts of the examples, held as arrays; iterating gives (doc_id, label, words) one at a time."""

    def __init__(self, ids: list[int], labels: list[int], words: pa.Array, times: np.ndarray, ends: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = [ids[k] for k in order], [labels[k] for k in order]
        coded = words.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.codes, self.times = coded.indices.to_numpy(), times
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.runs = [(int(begin[k]), int(ends[k])) for k in order]

    @classmethod
    def of(cls, rows: list[tuple[int, int, Counter]]) -> Sample:
        flat = [w for _, _, c in rows for w in c]
        times = np.array([n for _, _, c in rows for n in c.values()], np.int64)
        return cls([r[0] for r in rows], [r[1] for r in rows], pa.array(flat, pa.string()), times, np.cumsum([len(c) for _, _, c in rows]))

    def __len__(self) -> int:
        return len(self.ids)

    def __iter__(self):
        for i, y, (a, b) in zip(self.ids, self.labels, self.runs):
            yield i, y, Counter(dict(zip(map(self.names.__getitem__, self.codes[a:b].tolist()), self.times[a:b].tolist())))


def build(sample: Sample, marked: list[str], share: dict[int, float]) -> Index:
    """``marked``: terms that differ between the labels, ``share``: how many labelled documents one sampled one stands for."""
    n = len(sample)
    heads = heads_of(marked)
    vocabulary = sorted({*sample.names, *(t for t in marked if t.endswith("*"))})
    w = np.array([share[y] for y in sample.labels])
    y = np.array(sample.labels, float)
    base = float(w @ y / w.sum())
    ix = Index({t: k for k, t in enumerate(vocabulary)}, heads, np.ones(len(vocabulary)), Postings([], len(vocabulary)), y, w / w.mean(), np.zeros(0), base, np.array([0.0, 1.0]), np.array([0.0, 1.0]), base)
    df = np.zeros(len(vocabulary))
    for _, _, c in sample:
        df[ix.vector(c)[0]] += 1
    ix.factor = np.log((n + 1) / (df + 1)) + 1
    ix.factor[[ix.at[t] for t in marked if t in ix.at]] *= BOOST
    vectors = [ix.vector(c) for _, _, c in sample]
    # Like examples side by side make tight block bounds.
    order = sorted(range(n), key=lambda k: (int(vectors[k][0][vectors[k][1].argmax()]) if len(vectors[k][0]) else -1, sample.ids[k]))
    vectors = [vectors[k] for k in order]
    ix.postings = Postings(vectors, len(vocabulary))
    w, y = w[order], y[order]
    ix.labels, ix.stands, ix.ids = y, w / w.mean(), np.array([sample.ids[k] for k in order], np.int64)
    votes, truth, weight, alone = [], [], [], np.zeros(n, bool)
    for c in range(n):
        at, cosine = ix.nearest(*vectors[c], without=c) if len(vectors[c][0]) else (np.empty(0, int), np.empty(0))
        alone[c] = not len(at)
        if len(at):
            votes.append(ix.vote(at, cosine)), truth.append(y[c]), weight.append(w[c])
    ix.bare = float(((w * y)[alone].sum() + 0.5 * base) / (w[alone].sum() + 0.5))
    if votes:
        grid, rates = isotonic(np.array(votes), np.array(truth), np.array(weight))
        # A slight slope keeps the order of votes inside a block of equal rates.
        ix.grid = np.concatenate([[0.0], grid, [1.0]])
        ix.rates = np.clip(np.concatenate([[rates[0]], rates, [rates[-1]]]), 0, 1) * 0.98 + 0.02 * ix.grid
    return ix


def fit(docs: DataFrame, labels: DataFrame) -> Index | None:
    """None without toxic and other examples to learn from."""
    spark = docs.sparkSession
    d = need(docs, doc_id="long", text="string").where(learnable(F.col("doc_id")))
    y = need(labels, doc_id="long", toxic="int").where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = y.join(d.select("doc_id").distinct(), "doc_id", "left_semi")
    near, size = smallest_hashes(known, "toxic", "doc_id", PER_LABEL)
    if len(size) < 2:
        return None
    chosen = [(r.doc_id, r.toxic) for r in near.select("doc_id", "toxic").collect()]
    ids = spark.createDataFrame(chosen, "doc_id long, toxic int")
    rows = d.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])

    def word_rows(batch):
        found = [words(t) for t in texts(batch)]
        return {"doc_id": column(batch, "doc_id"), "toxic": column(batch, "toxic"), "words": [list(c) for c in found], "times": [list(c.values()) for c in found]}

    # at most 2 * PER_LABEL rows, as arrays of numbers and distinct words
    held = map_slices(rows, word_rows, "doc_id long, toxic int, words array<string>, times array<int>").toArrow()
    word_lists, time_lists = held.column("words").combine_chunks(), held.column("times").combine_chunks()
    ends = np.cumsum(word_lists.value_lengths().to_numpy()) if len(held) else np.zeros(0)
    sample = Sample(held.column("doc_id").to_pylist(), held.column("toxic").to_pylist(), word_lists.flatten(), time_lists.flatten().to_numpy(), ends)
    del held, word_lists, time_lists
    return build(sample, marked_terms(sample), {v: size[v] / min(size[v], PER_LABEL) for v in size})


def marked_terms(sample: Sample) -> list[str]:
    """Words and beginnings whose document frequencies differ between the labels, by MIN_G2, MIN_DF and LIFT."""
    y = np.array(sample.labels)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    example = np.repeat(np.arange(len(sample)), [b - a for a, b in sample.runs])
    word = np.concatenate([np.empty(0, np.int64), *(sample.codes[a:b] for a, b in sample.runs)]).astype(np.int64)
    names, a, b = [], [], []
    for size in (0, *PREFIXES):  # 0: whole words
        heads: dict[str, int] = {}
        of = np.array([heads.setdefault(w[:size] + "*" if size else w, len(heads)) if len(w) > size else -1 for w in sample.names], np.int64)
        term = of[word] if len(of) else word
        pairs = np.unique(example[term >= 0] * (len(heads) + 1) + term[term >= 0])  # an example has a term once
        e, t = np.divmod(pairs, len(heads) + 1)
        one, both = np.bincount(t[y[e] == 1], minlength=len(heads)), np.bincount(t, minlength=len(heads))
        often = np.flatnonzero(both >= MIN_DF)
        shown = list(heads)
        names += [shown[k] for k in often]
        a += one[often].tolist()
        b += (both - one)[often].tolist()
    if not names:
        return []
    a, b = np.array(a, float), np.array(b, float)
    n, g2 = n1 + n0, np.zeros(len(names))
    with np.errstate(divide="ignore", invalid="ignore"):
        for cell, row, total in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)):  # the table term x label
            g2 += np.where(cell > 0, 2 * cell * np.log(cell * n / (row * float(total))), 0.0)
    r1, r0 = (a + 0.1) / n1, (b + 0.1) / n0
    return [t for t, x in zip(names, (g2 >= MIN_G2) & ((r1 >= LIFT * r0) | (r0 >= LIFT * r1))) if x]


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (up to three nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # the words of at most 2 * PER_LABEL texts

    def run(batch):
        ix = sent.value
        got = [ix.score(t) if ix is not None else (0.0, []) for t in texts(batch)]
        return {
            "doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "score": [s for s, _ in got], "predicted": [int(s >= 0.5) for s, _ in got],
            "evidence": [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for _, e in got],
        }

    d = need(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id")))
    return map_slices(d, run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def without_toxic(docs: DataFrame, index: Index | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, ix = batch.slice(at, SLICE), sent.value
                yield part.filter(pa.array([ix is None or ix.score(t)[0] < 0.5 for t in texts(part)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
