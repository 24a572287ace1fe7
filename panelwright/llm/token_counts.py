"""Token counts from a digest cache.

1. Every row gets the digest of its normalised content: the text, a null counting as empty; where the tokenizer drops white
   space, runs of spaces and line breaks count as one space and those at the ends as none.
2. The distinct digests are the grouped rows (copies merge before the shuffle), each with one text. Those that the cache
   holds under the tokenizer's version digest (contents of its file, library, version) drop out by an anti-join; the rest,
   the misses, are encoded once each and appended to the cache as a new part.
3. The rows' digests are joined to the cache's counts. Rows carry no text here, and a digest that many rows share is split
   by the adaptive skew join, since both sides come from shuffles of their own.

The cache is a folder of Parquet parts with columns version, digest, n_tokens. Parts are only added, by Spark's committed
appends; two writers that meet may add one digest twice, with the same count, so reading takes one per digest.

Inside a task, a miss is counted piece by piece where that gives the library's count (``subwords``); a bounded table per
worker keeps the counts of short pieces.

Nulls and odd cases: a null or empty text has no bytes and no tokens; texts of any length are counted whole; every row has a
result, repeated rows and null ids included; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import subwords
from panelwright.llm.common import column, map_slices, need, new_path, texts

#: Pieces a worker keeps at most, and the length of the longest kept.
KEPT, KEPT_CHARS = 500_000, 64
CACHE = "version string, digest binary, n_tokens long"


class Counts:
    """Counts texts of one tokenizer, piece by piece where its file allows."""

    def __init__(self, library: subwords.Library):
        self.library = library
        self.table: dict[str, int] = {}

    def of(self, texts_: list[str]) -> list[int]:
        if not self.library.cuts:
            return self.library.counts(texts_)
        parts = [self.pieces(t) for t in texts_]
        if len(self.table) > KEPT:
            self.table = {}
        table = self.table
        fresh = list({p for ps in parts for p in ps if p not in table})
        counts = dict(zip(fresh, self.library.counts(fresh)))
        table.update((p, n) for p, n in counts.items() if len(p) <= KEPT_CHARS)
        long = {p: n for p, n in counts.items() if len(p) > KEPT_CHARS}
        get = (table | long if long else table).__getitem__
        return [sum(map(get, ps)) for ps in parts]

    def pieces(self, text: str) -> list[str]:
        """A space before a piece is part of it, unless the tokenizer drops spaces or adds them by itself."""
        first, *rest = subwords.cut(text)
        return [first, *(rest if self.library.drops_spaces or not self.library.is_json else [" " + p for p in rest])]


_counts: dict[int, Counts] = {}


def counts_for(library: subwords.Library) -> Counts:
    """The worker's table of this tokenizer."""
    if id(library) not in _counts:
        _counts[id(library)] = Counts(library)
    return _counts[id(library)]


def content(text: str, drops_spaces: bool) -> Column:
    """What of a text decides its count."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.trim(F.regexp_replace(t, "[ \n]+", " ")) if drops_spaces else t


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stored(spark, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer: one row per digest."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def add_misses(docs: DataFrame, path: str, cache: str) -> str:
    """Encode what the cache does not hold yet and append it; the tokenizer's version digest."""
    spark = docs.sparkSession
    library = subwords.shared_library(spark, path, plain=False)
    drops = subwords.read(path).drops_spaces
    version = subwords.version(path, "content without outer and repeated spaces" if drops else "content")
    d = need(docs, text="string").withColumn("text", content("text", drops))
    distinct = d.groupBy(digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"))
    misses = distinct.join(stored(spark, cache, version), "digest", "left_anti")

    def run(batch: pa.RecordBatch):
        return {"version": [version] * batch.num_rows, "digest": column(batch, "digest"), "n_tokens": counts_for(library()).of(texts(batch))}

    map_slices(misses, run, CACHE).write.mode("append").parquet(cache)
    return version


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a .json file of tokenizers or a .model file of sentencepiece. ``cache``: a folder that all executors share; a
    new one if not given."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = add_misses(docs, path, cache)
    drops = subwords.read(path).drops_spaces
    d = need(docs, doc_id="long", text="string")
    rows = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(content("text", drops)).alias("digest"))
    counted = rows.join(stored(spark, cache, version), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

