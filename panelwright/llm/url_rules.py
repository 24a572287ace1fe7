"""URL rules by a sort-merge range join.

A host is written label by label from its end, each label followed by a low character, so that a rule's host becomes a
prefix and all hosts below it an interval. Rules and urls are dealt by sampled splitters of that order (a rule goes to
every bucket its interval meets: at most one per bucket and nesting level besides its first), sorted in each bucket and
swept once; the sweep keeps a stack of the rules whose interval is open and asks each for its path, longest rule first.

A verdict follows from host and path alone, and rows meet it by these and a hash of the row: rows that share a hash have
distinct hosts or paths or equal verdicts. Splitters cover host, path and that hash, so that one host, or one url, with a
third of the rows is spread over buckets.

Nulls and odd cases: a null url or one without :// has empty host and path and no rule; null hosts of rules are skipped;
urls of any length are compared whole; repeated rows each get their verdict; ties between rules of equal length go to the
longer host, then to the smaller verdict; an empty table of urls gives an empty result, an empty table of rules the default
verdict throughout.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import need

END, TOP = "\x01", "\U0010ffff"
#: Sampled keys kept for the splitters, and buckets at most.
SAMPLE, BUCKETS = 20_000, 4_000


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a low character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


def splitters(keys: DataFrame, buckets: int) -> list[str]:
    """At most ``buckets`` - 1 keys that cut a bounded sample into equal parts."""
    n = keys.count()
    share = min(1.0, SAMPLE / max(1, n))
    got = sorted(r[0] for r in keys.sample(share, seed=7).limit(2 * SAMPLE).collect())
    if not got:
        return []
    return sorted({got[len(got) * k // buckets] for k in range(1, buckets)})


def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of buckets, rules before urls of the same key; yields (row, rule, verdict)."""
    stack: list[tuple] = []  # (bucket, key, host, path, verdict)
    for part in rows:
        out = []
        for bucket, key, is_url, host, path, verdict, row in zip(part["_bucket"], part["_key"], part["_url"], part["_host"], part["_path"], part["_verdict"], part["_row"]):
            while stack and (stack[-1][0] != bucket or not key.startswith(stack[-1][1])):
                stack.pop()
            if not is_url:
                stack.append((bucket, key, host, path, verdict))
                continue
            best = None
            for _, _, h, p, v in stack:
                if path.startswith(p) and (host == h or host.endswith("." + h)):
                    rank = (-len(h + p), -len(h), v)
                    if best is None or rank < best[0]:
                        best = (rank, h + p, v)
            if best is not None:
                out.append((row, host, path, best[1], best[2]))
        yield pd.DataFrame(out, columns=["_row", "host", "path", "_rule", "_found"]).astype({"_row": "int64"})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (host and path of the longest fitting rule, else null), verdict.

    ``rules``: host, path, verdict; a rule fits its host and all subdomains if the url's path starts with its path."""
    spark = pages.sparkSession
    p = need(pages, page_id="long", url="string")
    p = p.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.xxhash64("page_id", "url").alias("_row"))
    r = need(rules, host="string", path="string", verdict="string").where("host is not null").select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
    urls = p.select(host_key(F.col("host")).alias("_key"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("_row")).distinct()
    place = F.concat(F.col("_key"), F.col("_path"), F.lit("\x00"), F.hex("_row"))
    n = min(BUCKETS, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(urls.select(place.alias("_place")), n)
    cuts_b = spark.sparkContext.broadcast(cuts)  # at most BUCKETS short strings

    @F.pandas_udf("int")
    def bucket_of(s: pd.Series) -> pd.Series:
        at = cuts_b.value
        return s.map(lambda x: bisect_right(at, x)).astype("int32")

    left = urls.select(bucket_of(place).alias("_bucket"), "_key", F.lit(True).alias("_url"), "_host", "_path", F.lit(None).cast("string").alias("_verdict"), "_row")
    right = r.distinct().select(host_key(F.col("host")).alias("_key"), "host", "path", "verdict")
    right = right.select(F.explode(F.sequence(bucket_of(F.col("_key")), bucket_of(F.concat("_key", F.lit(TOP))))).alias("_bucket"), "_key", F.lit(False).alias("_url"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"), F.lit(0).cast("long").alias("_row"))
    dealt = left.unionByName(right).repartition(n, "_bucket").sortWithinPartitions("_bucket", "_key", "_url", "_path")
    found = dealt.mapInPandas(sweep, "_row long, host string, path string, _rule string, _found string")
    return p.join(found, ["_row", "host", "path"], "left").select("page_id", "host", "path", F.col("_rule").alias("rule"), F.coalesce("_found", F.lit(default)).alias("verdict"))


#: The rules of the registered query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rules_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


SQL = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
