import hashlib
import random

import numpy as np
import pytest

from panelwright.llm import passages as P
from panelwright.llm import suffix_dedup as S
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs, words


def check(spark, rows, hot):
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in S.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), hot).collect()}
    want = S.brute([t for _, t in rows])
    assert [got[i] for i, _ in rows] == want
    return want


@pytest.mark.parametrize("hot", [100_000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    """Copies, passages of 399 to 900 bytes in varying surroundings, self-repeats, periodic and non-ASCII texts."""
    monkeypatch.setattr(S, "BUCKET", 40)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(n) for n in (395, 399, 400, 401, 450, 700, 900)]
    rows = []
    for k in range(60):
        parts = [text(r.randint(0, 600))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.randint(0, 300))]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[3][1]), (101, "ab" * 900), (102, "a" * 399), (103, "b" * 401), (104, passages[5][:410] + "x" + passages[5][410:]), (105, passages[6][100:600]), (106, None), (107, "")]
    assert sum(map(bool, check(spark, rows, hot))) > 20


def test_multikey_sort_and_prefixes():
    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (500, 21)).astype(np.uint8)
    rows[100:200, :15] = rows[0, :15]
    order = S.multikey_sort(rows)
    by = [rows[k].tobytes() for k in order]
    assert by == sorted(by)
    lcp = S.common_prefixes(rows, order)
    for a, b, n in zip(by, by[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == 21 or a[n] != b[n])


def test_every_window_has_its_leftmost_minimum():
    raw = np.frombuffer(" ".join(words(8, 400)).encode(), np.uint8)
    p, a, b, _ = S.anchors(raw)
    assert a[0] == 0 and b[-1] == len(raw) - S.WIDTH and (a[1:] == b[:-1] + 1).all()
    assert ((p >= a) & (p + S.GRAM <= a + S.WIDTH) & (p >= b)).all()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = S.dedup_digests(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].n_removed == 5000 and by[7].n_spans == 1 and by[0].n_removed == by[0].n_bytes
    assert S.dedup_digests(none_docs(spark)).count() == 0


@needs_data
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup_digests(docs).collect()}
    for (i, t), spans in zip(rows, S.brute([t for _, t in rows])):
        raw = (t or "").encode()
        kept = S.cut(raw, spans)
        assert got[i] == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("tasks,joins", [(1, "-1"), (4, "-1"), (4, "10m")])
@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeated_rows_are_places_of_their_own(spark, tasks, joins, hot):
    """Equal ids, null ids and another id, in one task and in several, with and without broadcast joins."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    a, b, c, d = text(900), text(700), text(1200), text(500)
    rows = [(1, a), (1, a), (2, "x" + b), (None, b), (None, c), (None, c), (3, d), (None, None), (None, None), (4, d[:399])] + [(5, c[:450])] * 9
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
        got = sorted((str(x.doc_id), x.n_bytes, [tuple(v) for v in x.removed]) for x in S.dedup_bytes(docs, hot).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted((str(i), len(t or ""), m) for (i, t), m in zip(rows, S.brute([t for _, t in rows])))


@pytest.mark.parametrize("tasks", [1, 4])
def test_passages_of_over_50_words_under_400_bytes(spark, tasks):
    """The contract's 400 bytes leave them, the further column has them: in other texts, rows equal or not, not in one row alone."""
    r = random.Random(12)
    text = lambda n: words(r.random(), n)
    passages = [text(n) for n in (49, 50, 51, 55, 62, 70, 120)]
    rows = []
    for k in range(60):
        parts = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.choice([0, 0, 1, 5])
            parts = [*parts, *p[a : r.choice([len(p), 56])], *text(r.randint(0, 40))]
        rows.append((k, r.choice([" ", "\n", " \t"]).join(parts)))
    own = " ".join(text(60))
    rows += [(100, own + " x " + own), (101, "the " * 80), (102, "the " * 70), (103, "a " * 300), (104, None), (105, ""), (None, rows[2][1]), (106, rows[3][1]), (106, rows[3][1])]
    rows += [(107, " ".join(text(90)))] * 2 + [(None, " ".join(text(52)))] * 2 + [(108, " ".join(text(500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    got = S.dedup_digests(docs, passages=True).collect()
    want = sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(rows, P.brute([t for _, t in rows])))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_repeat_words) for x in got) == want
    assert sum(x.n_repeat_words > 50 and not x.n_removed for x in got) > 5 and sum(x.n_repeat_words == 0 for x in got) > 5
    assert [tuple(x)[:5] for x in sorted(got, key=str)] == [tuple(x) for x in sorted(S.dedup_digests(docs).collect(), key=str)]


def test_registered_query_tells_passages_and_clean_texts(spark, tmp_path):
    """Passages of 51 to 62 words in two texts each among others that are clean."""
    import __spark_entry__

    r = random.Random(3)
    text = lambda n: words(r.random(), n)
    rows = [(k, " ".join(text(r.randint(60, 200)))) for k in range(80)]
    for k in range(0, 40, 2):
        p = text(r.randint(51, 62))
        for i in (k, k + 1):
            w = rows[i][1].split()
            at = r.randint(0, len(w))
            rows[i] = (i, " ".join([*w[:at], *p, *w[at:]]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_repeat_words for x in __spark_entry__.queries()["op3_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert all(51 <= got[k] for k in range(40)) and all(got[k] == 0 for k in range(40, 80))
