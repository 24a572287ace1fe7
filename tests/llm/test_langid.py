import numpy as np

from panelwright.llm import langid as G
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs, words

TONGUES = {"aa": "ka lo mi re tu".split(), "bb": "schn ungk ichw erd".split(), "cc": "жи ло ва не".split()}


def docs_of(spark, n=240):
    rows = [(k, " ".join(words(k, 5 + k % 60, TONGUES[lang])), lang) for k in range(n) for lang in [list(TONGUES)[k % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_rows(spark):
    docs = docs_of(spark)
    m = G.fit(docs)
    want = {r.doc_id: r.lang for r in docs.collect()}
    rows = G.predict(docs, m).collect()
    assert sum(r.lang_pred == want[r.doc_id] for r in rows) >= 238 and all(0 <= r.score <= 1 for r in rows)
    odd = odd_docs(spark, ["x", "ж", "²½", "١٢"])
    got = G.predict(odd, m).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert all(by[k] == ("und", 0.0) for k in (2, 3, 4, 5, 102, 103)) and by[101][0] == "cc" and by[6][0] == "aa" and by[100][0] in TONGUES
    assert G.predict(none_docs(spark), m).count() == 0
    assert {r.lang_pred for r in G.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert G.identify(none_docs(spark)).count() == 0
    assert G.predict(odd, G.fit(odd)).count() == odd.count()


def test_kernel_equals_sets():
    texts = [" ".join(words(k, 3 + 7 * k, TONGUES[x])) for k in range(6) for x in TONGUES] + ["", "q"]
    m = G.start_model(texts[:5])
    k = m.kernel(texts, G.lookup_of(m))

    def parts(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    for i, t in enumerate(texts):
        for j, u in enumerate(texts[:5]):
            a, b = parts(t), parts(u)
            assert np.isclose(k[i, j], len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))), atol=1e-5)


def test_blocks_of_long_texts(monkeypatch):
    t = " ".join(words(5, 900))
    whole = np.sort(G.grams(t))
    monkeypatch.setattr(G, "BLOCK", 97)
    assert (G.grams(t) == whole).all()


@needs_data
def test_query_on_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in G.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in rows) >= 0.98 * len(rows)
