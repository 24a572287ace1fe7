import hashlib
from collections import defaultdict

import duckdb
import pytest

from panelwright.llm import line_dedup as L
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    owner = {}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                at = 2**63 - 1 if i is None else i
                owner[key(x)] = min(owner.get(key(x), at), at)
    out = defaultdict(int)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), 2**63 - 1) >= (2**63 - 1 if i is None else i)]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("n_batches,fanout", [(1, 1), (4, 2), (5, 1)])
def test_report_equals_brute_force(spark, n_batches, fanout):
    more = ["Shared LINE of text\nown line number one", " shared line of text\t\nshort\nshort", "short\nÄÖÜ shared ünïcode\n", "äöü shared ünïcode\nÄÖÜ shared ünïcode", "a\n" * 3000 + "Shared line of text\n" * 50, "123456789\n1234567890", "123456789\n 1234567890 "]
    docs = odd_docs(spark, more)
    got = defaultdict(int)
    for r in L.line_report(docs, n_batches=n_batches, fanout=fanout).collect():
        got[tuple(r)] += 1
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_filter_keeps_columns_and_rows(spark):
    docs = odd_docs(spark)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {r.doc_id: r for r in out.collect() if r.doc_id in (0, 2, 3)}
    assert kept[2].text is None and kept[3].text == "" and kept[0].text == docs.where("doc_id = 0").first().text
    assert L.dedup_lines(none_docs(spark)).count() == 0


@needs_data
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(L.SQL).fetchall())
    assert sorted(map(tuple, L.line_report(spark.read.parquet(f"{DATA}/documents.parquet")).collect())) == want


def test_plan_runs_no_python(spark):
    plan = L.line_report(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_table_with_half_its_ids_null(spark):
    rows = [(k if k % 2 else None, f"shared line number {k % 3}\nown line number {k}") for k in range(40)]
    got = defaultdict(int)
    for r in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[tuple(r)] += 1
    assert got == brute(rows)
