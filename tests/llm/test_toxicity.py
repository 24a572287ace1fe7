import random

import numpy as np
import pytest

from panelwright.llm import toxicity as X
from tests.llm.helpers import DATA, none_docs, odd_docs, words

BAD = ["zorg", "brakk", "flumpo"]


def corpus(spark, n=400, label_share=0.7):
    """Texts of which a fifth hold insults, some with varying ends; labels of most of them."""
    r, docs, labels = random.Random(8), [], []
    for k in range(n):
        w, toxic = words(k, r.randint(20, 60)), k % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(BAD) if r.random() < 0.5 else "quazzi" + r.choice(["ta", "tor", "men"]))
        docs.append((k, " ".join(w).capitalize()))
        if r.random() < label_share:
            labels.append((k, 0, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = X.score(docs, X.fit(docs, labels)).collect()
    wrong = [r for r in rows if r.predicted != int(r.doc_id % 5 == 0)]
    assert len(rows) == 400 and len(wrong) <= 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.held_out for r in rows) > 40
    hit = next(r for r in rows if r.predicted)
    assert 1 <= len(hit.evidence) <= 3 and hit.evidence[0].cosine >= hit.evidence[-1].cosine


def test_block_max_search_is_exact(monkeypatch):
    r = np.random.default_rng(2)
    for trial in range(40):
        n, v = 500, 40
        monkeypatch.setattr(X, "FEW", [0.0, 0.05, 0.125, 1.0][trial % 4])
        w = r.random((v, n)) * (r.random((v, n)) < r.choice([0.02, 0.1, 0.4], size=(v, 1)))
        w = np.round(w / np.maximum(np.sqrt((w**2).sum(axis=0)), 1e-9), 2 if trial % 2 else 9)
        ix = X.Postings([(np.flatnonzero(c), c[c > 0]) for c in w.T], v)
        rows = np.sort(r.choice(v, 6, replace=False))
        q = r.random(6)
        q /= np.sqrt(q @ q)
        without = -1 if trial % 3 else 7
        all_c = q @ w[rows]
        if without >= 0:
            all_c[without] = 0
        want = [k for k in np.lexsort((np.arange(n), -all_c.round(12))) if all_c[k] > 0][:15]
        at, cosine = ix.nearest(rows, q, 15, without)
        assert at.tolist() == want and cosine == pytest.approx(all_c[want])


def brute_nearest(sample, ix, text, k):
    """Cosines of a text with every example by dictionaries of term weights."""
    def vector(c):
        rows, w = ix.vector(c)
        return dict(zip(rows.tolist(), w.tolist()))

    q = vector(X.words(text))
    found = [(sum(x * v.get(t, 0.0) for t, x in q.items()), i) for i, v in ((i, vector(c)) for i, _, c in sample)]
    return sorted(((-round(c, 10), i) for c, i in found if c > 0))[:k]


def test_scores_equal_brute_force_and_a_copy_finds_itself(spark):
    """A copy of a labelled text has cosine 1 with it alone: its rare words are in the index."""
    docs, labels = corpus(spark, 300)
    rare = [(1000 + k, " ".join([f"rareword{'abcdefgh'[k]}", f"seltenes{'abcdefgh'[k]}", *words(5000 + k, 30)])) for k in range(8)]
    docs = docs.union(spark.createDataFrame(rare, docs.schema))
    labels = labels.union(spark.createDataFrame([(i, 0, int(i % 2)) for i, _ in rare], labels.schema))
    ix = X.fit(docs, labels)
    known = {int(i) for i in ix.ids}
    sample = [(r.doc_id, 0, X.words(r.text)) for r in docs.collect() if r.doc_id in known]
    place = {int(i): k for k, i in enumerate(ix.ids)}
    copies = spark.createDataFrame([(i + 5000, t) for i, t in rare if i in known], docs.schema)
    assert copies.count() >= 4
    for r in X.score(copies, ix).collect():
        assert r.evidence[0].doc_id == r.doc_id - 5000 and r.evidence[0].cosine == pytest.approx(1.0) and r.evidence[1].cosine < 0.9
    got = {r.doc_id: r for r in X.score(docs, ix).collect()}
    for d in docs.limit(60).collect():
        want = brute_nearest(sample, ix, d.text, X.NEIGHBOURS)
        assert [e.cosine for e in got[d.doc_id].evidence] == pytest.approx([-c for c, _ in want[:3]], abs=1e-9)
        at = np.array([place[i] for _, i in want])
        cosine = np.array([-c for c, _ in want])
        rest = sorted(-c for c, _ in want)
        if len(rest) < X.NEIGHBOURS or len(set(np.round(rest, 9))) == len(rest):  # no tie that positions would decide
            assert got[d.doc_id].score == pytest.approx(float(np.interp(ix.vote(at, cosine), ix.grid, ix.rates)), abs=1e-6)


def test_isotonic_is_monotone():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    grid, rates = X.isotonic(x, np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(rates) >= 0).all() and rates[0] < 0.01 and rates[-1] > 0.99 and len(grid) == len(rates)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    ix = X.fit(docs, labels.union(spark.createDataFrame([(None, 1, 1), (10**9, 0, 1), (3, None, None), (4, 0, 7)], labels.schema)))
    odd = odd_docs(spark, ["zorg brakk zorg quazzitor flumpo"])
    rows = X.score(odd, ix).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.predicted} == {100}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    kept = X.without_toxic(odd, ix)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert X.score(none_docs(spark), ix).count() == X.without_toxic(none_docs(spark), ix).count() == 0
    none = X.fit(docs, labels.where("toxic = 0"))
    assert none is None and {(r.score, r.predicted) for r in X.score(odd, none).collect()} == {(0.0, 0)}
    assert X.fit(none_docs(spark), labels) is None and X.without_toxic(odd, None).count() == odd.count()
    assert X.fit(odd_docs(spark), labels.where("doc_id < 9")) is not False


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="test tables are absent")
def test_query_on_table(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score(docs, X.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows) and sum(r.predicted and not r.toxic for r in rows) <= 1
