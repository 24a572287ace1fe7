"""Quality rules: base counts, and robust multivariate outliers per language and source.

Every text gets five counts. Texts that pass the base rules are turned into a vector of transformed statistics; per
language and source the minimum-covariance-determinant estimate of centre and scatter is searched from three
deterministic starts (medians with interquartile ranges, spatial signs, hyperbolic tangents of standardised values). Each
concentration step keeps the ``share`` of the group's rows with the smallest Mahalanobis distance and estimates anew from
these; a start is done when the log determinant of its scatter moves by less than SETTLED, and the start with the smallest
determinant gives the group's estimate. A text farther away than the chi-square limit (0.999) is rejected.

Steps are grouped aggregates over all rows (sums combine before the shuffle, so a source with a third of the rows is no
hot task). The distance that cuts off the share is the exact one at every size (``at_ranks``): rows are counted in narrow
bins, and only the bin that holds the wanted rank is looked into. Rows meet their group's few numbers without being dealt
by group. Scatter is scaled by the consistency factor of the share; in no direction is it taken for smaller than the
floors' own (a lower bound, nothing is added to larger scatter), which keeps statistics that are constant in most of a
group from rejecting every other value. Groups under ``min_group`` rows use their language's estimate, languages under it
the estimate of all rows; where even that has fewer rows nothing is rejected.

Nulls and odd cases: a null text has no words and fails the base rules; a null lang or source is a value of its own;
repeated rows and null ids are judged row by row; rows at the cut's distance are all kept in a step, ties of determinants
go to the first start; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import distributions as D
from panelwright.llm.common import column, map_slices, need, texts, written
from panelwright.llm.tokens import windows, word_hashes

#: Smallest standard deviation taken for: log words, letters per word, roots of the shares of symbols, repeated lines, repeated words.
FLOOR = (0.5, 0.5, 0.15, 0.1, 0.15)
DIMS = len(FLOOR)
WINDOW = 8
BROADCAST_GROUPS, SALTS = 100_000, 32
#: A start is done when its log determinant moves by less.
SETTLED = 1e-9
#: Bins of a rank search per unit of the logarithm: a bin's values differ by a thousandth.
BINS = 1024


def repeat_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words in windows of ``k`` words that occur twice or more."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(again)
    cover[at] += 1
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    h = word_hashes(text)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(h), chars, symbols, len(lines) - len(set(lines)), repeat_words(h)


def count_frame(docs: DataFrame) -> DataFrame:
    def run(batch):
        rows = [counts(t) for t in texts(batch)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return {c: column(batch, c) for c in ("doc_id", "lang", "source")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_slices(need(docs, doc_id="long", text="string", lang="string", source="string"), run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if D.pchisq(mid, df) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    return share / D.pchisq(chi2_quantile(share, DIMS), DIMS + 2)


def bounded(cov: np.ndarray) -> np.ndarray:
    """Scatter that in no direction is smaller than the floors' own."""
    f = np.array(FLOOR)
    size, axes = np.linalg.eigh(cov / np.outer(f, f))
    return (axes * np.maximum(size, 1.0)) @ axes.T * np.outer(f, f)


def solved(sums: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse scatter and log determinant of each group and start from its sums."""

    def run(parts):
        for part in parts:
            out = []
            for g, k, n, s, c in zip(part["_g"], part["_k"], part["_n"], part["_s"], part["_c"]):
                m = np.array(s) / n
                cov = (np.array(c).reshape(DIMS, DIMS) / n - np.outer(m, m)) * factor
                cov = bounded((cov + cov.T) / 2)
                out.append((g, k, m.tolist(), np.linalg.inv(cov).ravel().tolist(), np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame(out, columns=["_g", "_k", "_m", "_i", "_det"])

    return sums.mapInPandas(run, FIT)


FIT = "_g string, _k int, _m array<double>, _i array<double>, _det double"


def starts(rows: DataFrame) -> DataFrame:
    """Three starts a group: a centre of medians, and as scatter the interquartile ranges alone, the spatial signs' second
    moments, and the tangents' covariance, the last two on values standardised by median and interquartile range."""
    xs = [f"_x{k}" for k in range(DIMS)]
    long = rows.select("_g", "doc_id", "n_words", "word_chars", F.posexplode(F.array(*xs)).alias("_p", "_x"))
    q = at_ranks(long, ["_g", "_p"], F.col("_x"), [0.25, 0.5, 0.75])
    pick = lambda p, k: F.max(F.when((F.col("_p") == p) & (F.col("_q") == k), F.col("_v")))
    scale = lambda p: F.greatest((pick(p, 2) - pick(p, 0)) / 1.349, F.lit(FLOOR[p]))
    mid = q.groupBy("_g").agg(F.array(*[pick(p, 1) for p in range(DIMS)]).alias("_m"), F.array(*[scale(p) for p in range(DIMS)]).alias("_sc"))
    mid = written(mid, "mcd-medians")
    z = [(F.col(x) - F.col("_m")[p]) / F.col("_sc")[p] for p, x in enumerate(xs)]
    d = beside(rows, mid, ["_g"]).select("_g", *[c.alias(f"_z{p}") for p, c in enumerate(z)])
    zs = [F.col(f"_z{p}") for p in range(DIMS)]
    square = reduce(Column.__add__, [c * c for c in zs])
    t = [F.tanh(c) for c in zs]
    pairs = [(a, b) for a in range(DIMS) for b in range(DIMS)]
    sign = [F.sum(F.when(square > 0, zs[a] * zs[b] / square).otherwise(0.0)) for a, b in pairs]
    sums = d.groupBy("_g").agg(F.count("*").alias("_n"), F.array(*sign).alias("_u"), F.array(*[F.sum(c) for c in t]).alias("_t"), F.array(*[F.sum(t[a] * t[b]) for a, b in pairs]).alias("_tt"))

    def run(parts):
        for part in parts:
            out = []
            for g, m, sc, n, u, s, ss in zip(*[part[c] for c in ("_g", "_m", "_sc", "_n", "_u", "_t", "_tt")]):
                tanh = np.array(ss).reshape(DIMS, DIMS) / n - np.outer(np.array(s) / n, np.array(s) / n)
                for k, v in enumerate((np.eye(DIMS), np.array(u).reshape(DIMS, DIMS) / n, tanh)):
                    out.append((g, k, list(m), start_inverse(v, np.array(sc)).ravel().tolist(), float("inf")))
            yield pd.DataFrame(out, columns=["_g", "_k", "_m", "_i", "_det"])

    return sums.join(mid, "_g").mapInPandas(run, FIT)


def start_inverse(v: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inverse of a standardised scatter, no axis under a hundredth of the mean one, on the scale of the statistics."""
    size, axes = np.linalg.eigh((v + v.T) / 2)
    size = np.maximum(size, max(size.mean(), 1e-12) / 100)
    return (axes / size) @ axes.T / np.outer(scale, scale)


def distance():
    """Squared Mahalanobis distance of _x1.. from _m under _i."""
    x = [F.col(f"_x{k}") - F.col("_m")[k] for k in range(DIMS)]
    out = F.lit(0.0)
    for a in range(DIMS):
        for b in range(DIMS):
            out = out + x[a] * x[b] * F.col("_i")[a * DIMS + b]
    return out


def beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with one row per group, without dealing the rows by group: the small side is broadcast up to
    BROADCAST_GROUPS counted rows, beyond that copied SALTS times so that a large group is spread."""
    if small.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(small), keys)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
    return rows.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "_salt"]).drop("_salt")


def at_ranks(rows: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(keys, _q, _v): per group and share, numbered from 0, the smallest of the values that has at least this share of the
    group's values, none negative, up to it. Bins are counted before anything is shuffled; the values of the bin that
    holds the rank are counted once more, one by one."""
    v = rows.withColumn("_v", value).withColumn("_b", F.floor(F.ln(F.col("_v") + 1e-9) * BINS))
    whole = Window.partitionBy(*keys)
    bins = v.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumns({"_top": F.sum("_c").over(whole.orderBy("_b")), "_all": F.sum("_c").over(whole)})
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_all") - 1e-9), F.lit(1))
    bins = bins.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(k).alias("q"), rank(p).alias("rank")) for k, p in enumerate(shares)])))
    below = F.col("_top") - F.col("_c")
    want = written(bins.where((F.col("_w.rank") > below) & (F.col("_w.rank") <= F.col("_top"))).select(*keys, "_b", F.col("_w.q").alias("_q"), (F.col("_w.rank") - below).alias("_r")), "mcd-bins")
    inside = beside(v, want, [*keys, "_b"]).groupBy(*keys, "_q", "_r", "_v").agg(F.count("*").alias("_c"))
    top = F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v"))
    return inside.withColumn("_top", top).where((F.col("_r") > F.col("_top") - F.col("_c")) & (F.col("_r") <= F.col("_top"))).select(*keys, "_q", "_v")


def with_groups(rows: DataFrame, min_group: int) -> DataFrame:
    """_g: the group whose estimate a row uses, null where even all rows are too few."""
    fine = rows.groupBy("_l", "_s").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_n"))
    sizes = written(fine, "groups")
    by_lang = sizes.groupBy("_l").agg(F.sum("_n").alias("_nl"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    g = F.when(F.col("_n") >= min_group, F.concat(F.lit("s"), F.to_json(F.struct("_l", "_s")))).when(F.col("_nl") >= min_group, F.concat(F.lit("l"), F.to_json(F.struct("_l"))))
    g = g.otherwise(F.lit("all")) if total >= min_group else g
    keys = written(sizes.join(by_lang, "_l").select("_l", "_s", g.alias("_g")), "group-keys")
    return beside(rows, keys, ["_l", "_s"])


def robust_fit(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """(_g, _m, _i): the smallest determinant among the starts of each group after concentration steps until these are
    settled, over the rows that pass the base rules."""
    xs = [f"_x{k}" for k in range(DIMS)]
    fit, factor, settled = written(starts(rows), "mcd"), consistency(share), []
    for _ in range(steps):
        d = beside(rows, fit.select("_g", "_k", "_m", "_i"), ["_g"]).withColumn("_d", distance())
        cut = at_ranks(d, ["_g", "_k"], F.col("_d"), [share]).select("_g", "_k", F.col("_v").alias("_cut"))
        near = beside(d, written(cut, "mcd-cut"), ["_g", "_k"]).where(F.col("_d") <= F.col("_cut"))
        sums = near.groupBy("_g", "_k").agg(F.count("*").alias("_n"), F.array(*[F.sum(x) for x in xs]).alias("_s"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]).alias("_c"))
        old = fit.select("_g", "_k", F.col("_det").alias("_det0"))
        new = written(solved(sums, factor).join(old, ["_g", "_k"]).withColumn("_same", F.abs(F.col("_det0") - F.col("_det")) < SETTLED), "mcd")
        settled.append(new.where("_same").drop("_det0", "_same"))
        fit = new.where("not _same").drop("_det0", "_same")
        if not fit.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, [*settled, fit])
    return every.groupBy("_g").agg(F.min(F.struct("_det", "_k", "_m", "_i")).alias("_f")).select("_g", "_f._m", "_f._i")


def quality(docs: DataFrame, share: float = 0.75, steps: int = 50, tail: float = 1e-3, min_group: int = 100) -> DataFrame:
    """``steps`` bounds the concentration steps. Per row: doc_id, the five counts, base_failed, kept, distance (squared; null if base_failed or no estimate)."""
    n = F.col("n_words")
    rate = lambda c: F.sqrt(F.col(c) / F.greatest(n, F.lit(1)))
    xs = [F.log(F.greatest(n, F.lit(1)).cast("double")), F.col("word_chars") / F.greatest(n, F.lit(1)), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    rows = count_frame(docs).withColumns({"base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n), "_l": F.coalesce("lang", F.lit("\x00")), "_s": F.coalesce("source", F.lit("\x00"))} | {f"_x{k}": x for k, x in enumerate(xs)})
    rows = written(rows.drop("lang", "source"), "stats")
    rows = with_groups(rows, min_group)
    every = rows.where(~F.col("base_failed") & F.col("_g").isNotNull())
    # Rows also count for the wider groups that smaller ones fall back on.
    langs, alls = every.withColumn("_g", F.concat(F.lit("l"), F.to_json(F.struct("_l")))), every.withColumn("_g", F.lit("all"))
    used = written(rows.where("_g is not null").select("_g").distinct(), "mcd-groups")
    levels = every.where(F.col("_g").startswith("s")).unionByName(langs).unionByName(alls)
    levels = levels.select("_g", "doc_id", "n_words", "word_chars", *[f"_x{k}" for k in range(DIMS)])
    fit = robust_fit(written(beside(levels, used, ["_g"]), "mcd-rows"), share, steps)
    limit = chi2_quantile(1 - tail, DIMS)
    alone = rows.where("_g is null").withColumns({"_m": F.lit(None).cast("array<double>"), "_i": F.lit(None).cast("array<double>")})
    # Every group in use has an estimate unless all its rows fail the base rules.
    known = fit.join(used, "_g", "right")
    out = beside(rows.where("_g is not null"), written(known, "mcd-all"), ["_g"]).unionByName(alone).withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"), "distance")
