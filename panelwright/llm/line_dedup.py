"""Line dedup against levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least ``min_chars``
code points that several documents hold stays only in the smallest doc_id holding it. Documents are taken in batches of
ascending doc_id: each batch is reduced to (hash, smallest id), merge-anti-joined with every run and written as a new
sorted run; when a level holds more than ``fanout`` runs they are merged into one run of the next level. A hash is thus
in exactly one run, beside the id that keeps it.

Nulls and odd cases: a null or empty text is one empty line; a null doc_id counts as the largest id, all such rows as one
document; rows that repeat a doc_id are one document and each is judged; an empty table gives an empty result; further
columns are carried along. Hashes have 128 bits (two independent 64-bit ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NULL_ID, id_or_last, new_path, remove, shared_dir, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["_h1", "_h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def staged_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_did, _tid, _pos, _h1, _h2) of every line whose key is long enough; _tid tells rows of one id apart."""
    lines = docs.select(id_or_last(docs["doc_id"].cast("long")).alias("_did"), F.xxhash64(docs["text"]).alias("_tid"), F.posexplode(split_lines(docs["text"])).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    return keyed.select("_did", "_tid", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def batch_of(bounds: list[int]) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (F.col("_did") > F.lit(b).cast("long")).cast("int")
    return out


def build_runs(lines: DataFrame, n_batches: int, fanout: int) -> list[str]:
    """Paths of the runs (_h1, _h2, _owner) after all batches of ``lines`` (which has a column _batch)."""
    spark = lines.sparkSession
    levels: list[list[str]] = [[]]

    def write(df: DataFrame) -> str:
        path = new_path(spark, "run")
        df.sortWithinPartitions(*HASH).write.parquet(path)
        return path

    for b in range(n_batches):
        fresh = lines.where(F.col("_batch") == b).groupBy(*HASH).agg(F.min("_did").alias("_owner"))
        for path in [p for level in levels for p in level]:
            fresh = fresh.join(spark.read.parquet(path).select(*HASH).hint("merge"), HASH, "left_anti")
        levels[0].append(write(fresh))
        at = 0
        while len(levels[at]) > fanout:
            merged = write(spark.read.parquet(*levels[at]).repartition(*HASH))
            remove(spark, *levels[at])
            levels[at] = []
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(merged)
            at += 1
    return [p for level in levels for p in level]


def dropped_lines(docs: DataFrame, min_chars: int, n_batches: int, fanout: int) -> DataFrame:
    """(_did, _tid, _at): ascending positions of the lines to drop, for the rows that lose any."""
    spark = docs.sparkSession
    staged = staged_lines(docs, min_chars)
    # Of ids that are not null: null ids are in the last batch, whatever their share.
    bounds = docs.select(docs["doc_id"].cast("long").alias("_did")).where(F.col("_did").isNotNull()).approxQuantile("_did", [k / n_batches for k in range(1, n_batches)], 0.01) if n_batches > 1 else []
    bounds = sorted({min(int(b), NULL_ID - 1) for b in bounds})
    lines = written(staged.withColumn("_batch", batch_of(bounds)), "lines")
    runs = build_runs(lines, len(bounds) + 1, fanout)
    owners = spark.read.parquet(*runs)
    drop = lines.join(owners, HASH).where(F.col("_did") > F.col("_owner"))
    return drop.groupBy("_did", "_tid").agg(F.sort_array(F.collect_set("_pos")).alias("_at"))


def kept_lines(lines: Column, at: Column) -> Column:
    """The lines between the dropped positions, in time proportional to their number."""
    before = F.concat(F.array(F.lit(-1)), at)
    after = F.concat(at, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(before.alias("b"), after.alias("a")), lambda r: F.slice(lines, r["b"] + 2, r["a"] - r["b"] - 1)))


def judged(docs: DataFrame, min_chars: int = 10, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """_row (all columns of ``docs``) and _at (ascending positions of the lines to drop, null if none)."""
    shared_dir(docs.sparkSession)
    drop = dropped_lines(docs, min_chars, n_batches, fanout)
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), id_or_last(docs["doc_id"].cast("long")).alias("_did"), F.xxhash64(docs["text"]).alias("_tid"))
    return keyed.join(drop, ["_did", "_tid"], "left").select("_row", "_at")


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; untouched rows keep text (and n_chars) as they were."""
    text = F.col("_row.text")
    kept = F.when(F.col("_at").isNull(), text).otherwise(F.array_join(kept_lines(split_lines(text), F.col("_at")), "\n"))
    out = judged(docs, **how).select("_row", "_at", kept.alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_at").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    j = judged(docs.select("doc_id", "text"), **how).select("_row.*", "_at")
    lines = split_lines(F.col("text"))
    kept = F.when(F.col("_at").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines(lines, F.col("_at")), "\n"))
    return j.select(F.col("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(F.col("_at")), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, i, s[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) t(i)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, i, line, coalesce(k.doc_id > owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
