import random

import pytest

from panelwright.llm import decontaminate as D
from tests.llm.helpers import none_docs, odd_docs, words


def brute_tiling(doc, test, k):
    """Plain greedy string tiling: the longest common free run, again and again."""
    doc_free, test_free, tiles = [True] * len(doc), [True] * len(test), []
    k = min(k, len(test))
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(test)):
                n = 0
                while i + n < len(doc) and j + n < len(test) and doc_free[i + n] and test_free[j + n] and doc[i + n] == test[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        if best[0] < max(1, k):
            return sum(tiles), len(tiles)
        n, i, j = best
        doc_free[i : i + n], test_free[j : j + n] = [False] * n, [False] * n
        tiles.append(n)


def test_tiling_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        test = words(r.random(), r.randint(5, 40), ["a", "b", "c"] if r.random() < 0.3 else "ka lo mi re tu".split())
        parts = [test[i : i + r.randint(3, 15)] for i in [r.randrange(len(test)) for _ in range(r.randint(1, 6))]]
        doc = [w for p in parts for w in [*p, *words(r.random(), r.randint(0, 4))]]
        t = D.Tests.of([(1, " ".join(test))], 4)
        covered, tiles, _ = t.tile(0, t.matches(D.hashes(" ".join(doc)))[0])
        assert (covered, tiles) == pytest.approx(brute_tiling(doc, test, 4), abs=0) or covered == brute_tiling(doc, test, 4)[0]


def test_reordered_short_and_clean(spark):
    a, b = words(11, 40), words(12, 30)
    docs = [(1, " ".join(words(20, 50) + a + words(21, 50))), (2, " ".join(a[20:] + words(22, 9) + a[:20])), (3, " ".join(words(23, 90))), (4, " ".join(a[:20]).upper()), (5, "x, Tiny! test y"), (6, " ".join(b[:9] + ["zz"] + b[10:19] + ["qq"] + b[20:])), (7, "tiny"), (8, None)]
    bench = [(1, " ".join(a)), (2, " ".join(b)), (3, "tiny test"), (4, None), (5, "..."), (None, "never seen words here at all")]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, coverage int")
    tests = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame, tests).collect()}
    assert got == {(1, 1), (2, 1), (5, 3), (6, 2)}
    kept = D.without_contaminated(frame, tests)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {3, 4, 7, 8}


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(words(k, 30))) for k in range(40)], "doc_id long, text string")
    tests = docs.selectExpr("doc_id as item_id", "text").where("doc_id % 3 = 0")
    one = sorted(map(tuple, D.contaminated(docs, tests).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, D.contaminated(docs, tests).collect())) == one and {(k, k) for k in range(0, 40, 3)} <= {x[:2] for x in one}
    assert D.without_contaminated(docs, tests).count() == 26


def test_odd_rows(spark):
    docs, none = odd_docs(spark), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.without_contaminated(docs, none).count() == docs.count()
    tests = docs.where("doc_id = 0").selectExpr("doc_id as item_id", "text").union(docs.where("doc_id = 0").selectExpr("doc_id", "text"))
    assert sorted(str(r.doc_id) for r in D.contaminated(docs, tests).collect()) == sorted(["0", "1", "1", "None"] * 2)
    assert D.contaminated(none_docs(spark), tests).count() == D.without_contaminated(none_docs(spark), tests).count() == 0
