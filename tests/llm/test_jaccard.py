import random
from collections import Counter, defaultdict

import pytest

from panelwright.llm import jaccard as J
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs, words


def shingle_set(t, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """A large group of near copies, chains, copies, small edits around the threshold; blocks of seven as well."""
    monkeypatch.setattr(J, "BLOCK", block)
    r = random.Random(5)
    base, rows = words(3, 200), []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    chain = words(4, 120)
    for k in range(20):
        rows.append((100 + k, " ".join(chain[6 * k : 6 * k + 120] + words(50 + k, 6 * k)) if k else " ".join(chain)))
    rows += [(200 + k, " ".join(words(6, 40)).upper() if k % 2 else " ".join(words(6, 40))) for k in range(8)]
    rows += [(300 + k, " ".join(words(400 + k, 50))) for k in range(30)]
    rows += [(400, "one two"), (401, "one  TWO"), (402, "one"), (403, ""), (404, None), (405, " \n")]
    got = {x.doc_id: (x.class_id, x.n_links) for x in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_banding_reaches_recall():
    bands, rows = J.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 160


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = J.near_duplicates(docs)
    assert out.count() == docs.count()
    by = defaultdict(list)
    for x in out.collect():
        by[x.doc_id].append((x.class_id, x.n_links))
    assert by[0] == [(0, 3)] and sorted(by[1]) == [(0, 3), (0, 3), (1, 0)] and sorted(by[None], key=str) == [(0, 3), (None, 0)]
    kept = J.one_per_class(docs)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect())[0] == 1 and {2, 3, 4, 5, 6, 7, 8} <= {x.doc_id for x in kept.collect()}
    assert J.near_duplicates(none_docs(spark)).count() == J.one_per_class(none_docs(spark)).count() == 0


@needs_data
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {x.doc_id: (x.class_id, x.n_links) for x in J.near_duplicates(docs).collect()}
    assert got == brute([(x.doc_id, x.text) for x in docs.collect()])


def test_rows_of_one_id_are_judged_one_by_one(spark):
    """Exactly the rows that stay: null ids and ids of several texts lose their copies only, repeated rows stay once."""
    kept = Counter((x.doc_id, x.text) for x in J.one_per_class(odd_docs(spark)).collect())
    rows = {(x.doc_id, x.text) for x in odd_docs(spark).collect()}
    base = next(t for i, t in rows if i == 0)
    assert kept == Counter(rows - {(1, base), (None, base)})
    one, two, three = (" ".join(words(k, 60)) for k in (21, 22, 23))
    more = [(None, one), (None, one + " end"), (None, two), (7, three), (7, three), (7, three.upper()), (9, two + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame(more, "doc_id long, text string")
    got = sorted(((x.doc_id, x.text) for x in J.one_per_class(docs).collect()), key=str)
    assert len(got) == 5 and {(9, two + " end"), (None, None), (None, "")} < set(got)
    assert len([t for i, t in got if i == 7]) == 1 and len([t for i, t in got if i is None and t and t.startswith(one)]) == 1
    found = sorted(((x.doc_id, x.class_id, x.n_links) for x in J.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, None, 1), (None, None, 1), (None, 9, 1), (7, 7, 2), (7, 7, 2), (7, 7, 2), (9, 9, 1), (None, None, 0), (None, None, 0)], key=str)
