"""Passages of WORDS words that also stand in another row, whatever their length in bytes.

Words are runs without ASCII white space. Every window of WORDS words is represented by its anchor, the place of the window's
smallest hash of GRAM words (leftmost of equals); consecutive windows with one anchor are a *run*. Equal windows have equal
anchor grams, so only runs whose gram stands in several rows are looked at, equal runs once. A run that stands in several rows
is repeated as a whole; where a gram has several distinct runs, their windows are counted one by one over all tasks.
Words and windows are compared by 64-bit hashes.

Nulls and odd cases: texts with fewer than WORDS words have no passage; a passage that stands in one row only, however often,
is none; equal rows are rows of their own.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, map_slices, new_path, remove, texts, written
from panelwright.llm.tokens import U, mix, powers, window_minima, word_hashes

WORDS, GRAM = 50, 20


def word_sums(w: np.ndarray) -> np.ndarray:
    """Sums of word hash * BASE**place over every prefix, modulo 2**64."""
    out = np.zeros(len(w) + 1, U)
    np.cumsum(w * powers(len(w))[0], out=out[1:], dtype=U)
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``start`` to before ``end``."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def word_runs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window of each run, its number of windows, the hashes of its anchor gram and of all its words."""
    if len(w) < WORDS:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, U), np.empty(0, U)
    sums = word_sums(w)
    n = len(w) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(w))[1][:n])
    keys = (grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    at = (window_minima(keys, WORDS - GRAM + 1) & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    return first, n, grams[at[first]], stretch_hashes(sums, first, first + n + WORDS - 1)


def run_frame(docs: DataFrame) -> DataFrame:
    """_did, _tid, _rid (row), _at (first word), _n (windows), _g (anchor gram), _h (words of the run)."""

    def run(batch):
        out = {n: [np.empty(0, np.int64)] for n in ("_did", "_tid", "_rid", "_at", "_n", "_g", "_h")}
        for did, tid, rid, t in zip(*(column(batch, c).to_pylist() for c in ("_did", "_tid", "_rid")), texts(batch)):
            first, n, g, h = word_runs(word_hashes(t or ""))
            for c, v in (("_did", did), ("_tid", tid), ("_rid", rid)):
                out[c].append(np.full(len(first), v))
            for c, v in (("_at", first), ("_n", n), ("_g", g.view(np.int64)), ("_h", h.view(np.int64))):
                out[c].append(v)
        return {n: np.concatenate(v) for n, v in out.items()}

    rows = docs.withColumn("_rid", F.monotonically_increasing_id())
    return map_slices(rows, run, "_did long, _tid long, _rid long, _at int, _n int, _g long, _h long")


def window_rows(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """_w (hash), _run, _k (place in the run), _a and _b (first and last row of the run), one row per window."""
    of = runs.groupBy("_did", "_tid").agg(F.collect_list(F.struct("_at", "_n", "_run", "_a", "_b")).alias("_runs"))

    def run(batch):
        out = {n: [np.empty(0, np.int64)] for n in ("_w", "_run", "_k", "_a", "_b")}
        for t, found in zip(texts(batch), column(batch, "_runs").to_pylist()):
            sums = word_sums(word_hashes(t or ""))
            n = np.array([r["_n"] for r in found])
            k = np.concatenate([np.arange(x) for x in n])
            at = np.repeat([r["_at"] for r in found], n) + k
            out["_w"].append(stretch_hashes(sums, at, at + WORDS).view(np.int64)), out["_k"].append(k)
            for c in ("_run", "_a", "_b"):
                out[c].append(np.repeat([r[c] for r in found], n))
        return {n: np.concatenate(v) for n, v in out.items()}

    return map_slices(docs.join(of, ["_did", "_tid"]), run, "_w long, _run long, _k int, _a long, _b long")


def covered(of: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """How many places the spans of each of ``n`` rows cover; ``of``: the row of a span."""
    if not len(of):
        return np.zeros(n, np.int64)
    shift = of * (int(end.max()) + 1)
    order = np.argsort(start + shift, kind="stable")
    first, last = (start + shift)[order], (end + shift)[order]
    reached = np.maximum.accumulate(np.append(0, last))[:-1]
    return np.bincount(of[order], np.maximum(0, last - np.maximum(first, reached)), n).astype(np.int64)


def covered_words(spans: DataFrame) -> DataFrame:
    """_did, _tid, n_repeat_words of _did, _tid, _from and _to (arrays)."""

    def run(batch):
        start, end = column(batch, "_from"), column(batch, "_to")
        of = np.repeat(np.arange(len(start)), start.value_lengths().to_numpy(zero_copy_only=False))
        values = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, end)]
        return {"_did": column(batch, "_did"), "_tid": column(batch, "_tid"), "n_repeat_words": covered(of, *values, len(start))}

    return map_slices(spans, run, "_did long, _tid long, n_repeat_words long")


def passage_words(docs: DataFrame) -> DataFrame:
    """_did, _tid, n_repeat_words of the documents with passages; ``docs``: _did, _tid, text."""
    spark = docs.sparkSession
    path = new_path(spark, "word-runs")
    every = written(run_frame(docs), "word-runs", path)
    again = written(every.groupBy("_g").agg(F.min("_rid").alias("_a"), F.max("_rid").alias("_b")).where("_a <> _b").select("_g"), "word-grams")
    places = written(every.select("_rid", "_at", "_n", "_g", "_h").join(again, "_g"), "word-places")
    ids = written(every.groupBy("_rid").agg(F.min("_did").alias("_did"), F.min("_tid").alias("_tid")), "word-rows")
    remove(spark, path)
    runs = places.groupBy("_g", "_h").agg(F.min("_rid").alias("_a"), F.max("_rid").alias("_b"), F.min(F.struct("_rid", "_at", "_n")).alias("_p"))
    runs = written(runs.select("_g", "_h", "_a", "_b", "_p.*", F.monotonically_increasing_id().alias("_run")), "word-distinct")
    several = written(runs.groupBy("_g").count().where("count > 1").select("_g"), "word-several")
    rows = window_rows(runs.join(several, "_g").join(ids, "_rid"), docs)
    shared = rows.groupBy("_w").agg(F.min("_a").alias("_x"), F.max("_b").alias("_y")).where("_x <> _y").select("_w")
    parts = rows.where("_a = _b").join(shared, "_w").groupBy("_run").agg(F.collect_set("_k").alias("_ks"))
    parts = runs.select("_run", "_g", "_h").join(parts, "_run").select("_g", "_h", F.transform("_ks", lambda k: F.struct(k.alias("from"), (k + WORDS).alias("to"))).alias("_s"))
    whole = runs.where("_a <> _b").select("_g", "_h", F.array(F.struct(F.lit(0).alias("from"), (F.col("_n") + WORDS - 1).alias("to"))).alias("_s"))
    spans = F.transform("_s", lambda s: F.struct((s["from"] + F.col("_at")).alias("from"), (s["to"] + F.col("_at")).alias("to")))
    hits = places.join(parts.unionByName(whole), ["_g", "_h"]).select("_rid", spans.alias("_s"))
    # Rows equal in id and text have equal spans: one of them tells, every row meets them.
    told = ids.groupBy("_did", "_tid").agg(F.min("_rid").alias("_rid"))
    spans = hits.join(told, "_rid").groupBy("_did", "_tid").agg(F.flatten(F.collect_list("_s")).alias("_s"))
    return covered_words(spans.select("_did", "_tid", F.col("_s")["from"].alias("_from"), F.col("_s")["to"].alias("_to")))


def brute(texts_: list[str | None]) -> list[int]:
    """Words of each text in windows that stand in another one too, by counting every window; for tests."""
    words = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in texts_]
    rows: dict[tuple, set] = {}
    for i, w in enumerate(words):
        for k in range(len(w) - WORDS + 1):
            rows.setdefault(tuple(w[k : k + WORDS]), set()).add(i)
    return [len({j for k in range(len(w) - WORDS + 1) if len(rows[tuple(w[k : k + WORDS])]) > 1 for j in range(k, k + WORDS)}) for w in words]
