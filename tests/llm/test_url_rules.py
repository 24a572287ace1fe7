import duckdb

from panelwright.llm import url_rules as R
from tests.llm.helpers import DATA, needs_data


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://wexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/",
        "http://a.b.c.example.com/de/", "http://example.com:80/en/", "x://é.net/es/ü", "a://b://net/es/", "http://net.com?/es/", "http://.net/es/", "http://a..net/es/1", "http://x.net/es/\n1"]


def test_equals_brute_force_with_many_buckets(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 3)] + [(1, URLS[6])] * 50 + [(None, URLS[7])]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, host string, rule string, verdict string")
    for n in (1, 7):
        got = sorted(map(str, map(tuple, R.judge_urls(pages, R.rules_frame(spark), buckets=n).collect())))
        assert got == sorted(str((i, *brute(u, R.RULES))) for i, u in rows)


def test_nested_rules_and_ties(spark):
    rules = [("a.com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/x", "allow"), ("com", "", "block"), (None, "/", "block"), ("c.com", None, "allow"), ("a.com", "/x", "block")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["http://a.com/xy", "http://b.a.com/xy", "http://b.a.com/z", "http://c.com", "http://d.com/", "http://q.b.a.com/x"])], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in R.judge_urls(pages, frame, buckets=5).collect()}
    assert got == {0: ("a.com/x", "block"), 1: ("b.a.com/x", "allow"), 2: ("a.com/", "allow"), 3: ("c.com", "allow"), 4: ("com", "block"), 5: ("b.a.com/x", "allow")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert R.judge_urls(none, R.rules_frame(spark)).count() == 0
    pages = spark.createDataFrame([(1, "http://net/es/")], "page_id long, url string")
    r = R.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block").first()
    assert (r.rule, r.verdict) == (None, "block")


@needs_data
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted(map(str, con.execute(R.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in R.judge_urls(spark.read.parquet(f"{DATA}/pages.parquet"), R.rules_frame(spark)).collect()) == want


def test_rows_with_one_hash_keep_their_own_verdicts(spark, monkeypatch):
    """All rows share the row hash: hosts and paths tell them apart."""
    monkeypatch.setattr(R.F, "xxhash64", lambda *c: R.F.lit(7).cast("long"))
    pages = spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, "http://www.example.com/en/x"), (3, "http://a.net/es/"), (3, "http://a.net/es/"), (4, None)], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in R.judge_urls(pages, R.rules_frame(spark)).collect())
    assert got == [(1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, "net/es/", "block"), (3, "net/es/", "block"), (4, None, "allow")]
