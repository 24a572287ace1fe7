"""Suffix-array dedup of byte strings.

Every byte covered by a string of WIDTH bytes that also starts anywhere else is found and taken out. Suffixes are not
sorted at every byte: each window of WIDTH bytes is represented by its anchor, the position of the window's smallest
GRAM-byte hash (leftmost of equals). Equal windows have their anchor at the same offset, so it is enough to compare
windows with the same anchor text, and consecutive windows share an anchor: they are one *run* text[first window ..
end of the last window), split at the anchor into a suffix to the right and a reversed prefix to the left.

1. Anchors of all documents; those whose gram stands nowhere else go (a grouped count).
2. Equal runs collapse into one with a flag, before any text moves.
3. The runs' texts are dealt by sampled splitters over the leading bytes of their suffixes, gram by gram, and each bucket
   is sorted by a multikey quicksort over eight-byte tokens, once by suffixes and once by reversed prefixes. Neighbours'
   common prefixes give, for each split WIDTH = l + r, the classes of runs that agree on r bytes to the right and l to the
   left: two runs in the same pair of classes hold the same window. All suffixes that begin with one gram lie in one
   bucket, so nothing has to be compared over a bucket's boundary;
   a gram with more than HOT distinct runs is the exception: its windows are counted one by one over all tasks by two
   independent 64-bit hashes, whatever bucket they would be in.
4. Repeated windows go back to all places of their runs and are merged per document.

A place is a position in a row: a run that stands in two rows stands in two places even if the rows are equal in id and text.

Nulls and odd cases: a null text is empty; texts under WIDTH bytes lose nothing; rows equal in doc_id and text are documents
of their own, so each loses what the others hold too; null ids are told apart by their rows and come back as null;
texts of any length are used whole; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NULL_ID, column, id_or_last, map_slices, need, new_path, remove, texts, written
from panelwright.llm.passages import passage_words
from panelwright.llm.tokens import U, mix, powers, prefix_sums, window_minima

WIDTH, GRAM = 400, 100
SPAN = WIDTH - GRAM + 1  # grams in a window
#: Distinct runs of one gram that one task compares, runs per bucket, sampled keys and buckets at most.
HOT, BUCKET, SAMPLE, BUCKETS = 100_000, 20_000, 50_000, 20_000
RUN = ["_g", "_h", "_low", "_high"]


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first and last window of each, and the hash of its gram; the windows of a text in ascending order."""
    n = len(raw)
    if n < WIDTH:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U)
    sums = prefix_sums(raw)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    keys = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    at = (window_minima(keys, SPAN) & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    p = at[first]
    return p, first, last, grams[p]


def anchor_frame(docs: DataFrame) -> DataFrame:
    """_did, _tid, _p (anchor), _low and _high (bytes from a window's start to its anchor: last and first window), _g (gram
    hash), _h (hash of the run), _lead (first bytes of the suffix as a number)."""

    def run(batch):
        out = {n: [] for n in ("_did", "_tid", "_p", "_low", "_high", "_g", "_h", "_lead")}
        for did, tid, t in zip(column(batch, "_did").to_pylist(), column(batch, "_tid").to_pylist(), texts(batch)):
            raw = bytes_of(t)
            p, a, b, g = anchors(raw)
            if not len(p):
                continue
            view = memoryview(raw)
            h = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + WIDTH]) for x, y in zip(a.tolist(), b.tolist())), U, len(p))
            lead = raw[p[:, None] + np.arange(8)].astype(np.uint8).view(">u8").ravel().astype(U) ^ U(1 << 63)
            out["_did"].append(np.full(len(p), did)), out["_tid"].append(np.full(len(p), tid))
            for n, v in (("_p", p), ("_low", p - b), ("_high", p - a), ("_g", g.view(np.int64)), ("_h", h.view(np.int64)), ("_lead", lead.view(np.int64))):
                out[n].append(v)
        return {n: np.concatenate(v) if v else np.empty(0, np.int64) for n, v in out.items()}

    return map_slices(docs, run, "_did long, _tid long, _p long, _low long, _high long, _g long, _h long, _lead long")


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows: ranges of rows that agree so far are partitioned by their next eight-byte token, all ranges of
    one depth at once; ranges of one row are done."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8")
    order, start = np.arange(n), np.zeros(n, np.int64)  # start: where the range of a place begins
    live = np.arange(n)  # places in ranges of several rows
    for depth in range(words.shape[1]):
        if len(live) < 2:
            break
        token = words[order[live], depth].astype(U)
        by = np.lexsort((token, start[live]))
        order[live] = order[live[by]]
        token, begin = token[by], start[live]
        new = np.ones(len(live), bool)
        new[1:] = (token[1:] != token[:-1]) | (begin[1:] != begin[:-1])
        start[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        alone = new & np.append(new[1:], True)
        live = live[~alone]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with its predecessor in ``order`` (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        a, b = rows[order[at : at + 4096]], rows[order[at - 1 : at - 1 + len(order[at : at + 4096])]]
        differ = a != b
        out[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def repeated_windows(runs: list[bytes], low: np.ndarray, high: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Of each run and each l: whether the window that begins l bytes before the anchor also stands elsewhere.

    ``runs`` are texts around anchors (``high`` bytes before, WIDTH - ``low`` from it on), ``several``: in several places."""
    n = len(runs)
    right = padded([r[h:] for r, h in zip(runs, high.tolist())], WIDTH)
    left = padded([r[:h][::-1] for r, h in zip(runs, high.tolist())], max(1, SPAN - 1))
    classes = []
    for rows in (right, left):
        order = multikey_sort(rows)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((common_prefixes(rows, order), place))
    (rp, r_at), (lp, l_at) = classes
    found = np.zeros((n, SPAN), bool)
    for offset in range(SPAN):
        here = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(here):
            continue
        found[here, offset] = several[here]
        if len(here) > 1:
            r_class, l_class = np.cumsum(rp < WIDTH - offset), np.cumsum(lp < offset) if offset else np.ones(n, np.int64)
            key = r_class[r_at[here]] * (n + 1) + l_class[l_at[here]]
            _, at, times = np.unique(key, return_inverse=True, return_counts=True)
            found[here, offset] |= times[at] > 1
    return found


def intervals(found: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Covered bytes relative to the anchor, per run: starts and ends."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    starts, ends = [[] for _ in found], [[] for _ in found]
    for k, x in zip(*(v.tolist() for v in np.nonzero(edge == 1))):
        ends[k].append(WIDTH - x)
    for k, x in zip(*(v.tolist() for v in np.nonzero(edge == -1))):
        starts[k].append(1 - x)
    return starts, ends


SPANS = "_g long, _h long, _low long, _high long, _from array<int>, _to array<int>"


def sort_buckets(parts):
    """mapInPandas over runs sorted by bucket: (RUN, _from, _to) of the runs with repeated windows."""

    def close(rows: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(rows) if len(rows) > 1 else rows[0]
        d = d.drop_duplicates(RUN)  # sent by several tasks
        found = repeated_windows(d["_text"].tolist(), d["_low"].to_numpy(), d["_high"].to_numpy(), d["_several"].to_numpy(bool))
        starts, ends = intervals(found)
        return d[RUN].assign(_from=starts, _to=ends)[found.any(axis=1)]

    bucket, held = None, []
    for part in parts:
        for b, d in part.groupby("_bucket", sort=True):
            if b != bucket and held:
                yield close(held)
                held = []
            bucket = b
            held.append(d)
            if len(held) > 64:
                held = [pd.concat(held).drop_duplicates(RUN)]
    if held:
        yield close(held)


def window_hashes(batch: pa.RecordBatch):
    """One row per window of a hot gram's run."""
    for g, h, low, high, several, text in zip(*(column(batch, c).to_pylist() for c in ("_g", "_h", "_low", "_high", "_several", "_text"))):
        offsets = list(range(low, high + 1))
        parts = [text[high - o : high - o + WIDTH] for o in offsets]
        n = len(offsets)
        yield {
            "_g": [g] * n, "_h": [h] * n, "_low": [low] * n, "_high": [high] * n, "_several": [several] * n, "_offset": offsets,
            "_w1": np.array([xxhash.xxh3_64_intdigest(p) for p in parts], U).view(np.int64), "_w2": np.array([xxhash.xxh3_64_intdigest(p, 1) for p in parts], U).view(np.int64),
        }


def hot_windows(hot: DataFrame) -> DataFrame:
    """The same result for runs of hot grams, by counting windows over all tasks."""
    run_schema = "_g long, _h long, _low long, _high long, _several boolean, _offset int, _w1 long, _w2 long"
    rows = map_slices(hot, window_hashes, run_schema)
    window = ["_g", "_offset", "_w1", "_w2"]
    key = F.struct("_h", "_low", "_high")
    again = rows.groupBy(*window).agg(F.min(key).alias("_a"), F.max(key).alias("_b"), F.max("_several").alias("_s")).where("_a <> _b or _s").select(*window)
    hits = rows.join(again, window).groupBy(*RUN).agg(F.collect_set("_offset").alias("_offsets"))

    def run(batch):
        off = column(batch, "_offsets").to_pylist()
        found = np.zeros((len(off), SPAN), bool)
        for k, o in enumerate(off):
            found[k, o] = True
        starts, ends = intervals(found)
        return {c: column(batch, c) for c in RUN} | {"_from": starts, "_to": ends}

    return map_slices(hits, run, SPANS)


def with_texts(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of every run, cut from the document of its smallest place."""
    places = runs.groupBy("_did", "_tid").agg(F.collect_list(F.struct("_p", *RUN, "_several", "_bucket")).alias("_runs"))
    joined = docs.join(places, ["_did", "_tid"])
    done: set[tuple[int, int]] = set()  # of a task: repeated rows send their runs once

    def run(batch):
        names = [*RUN, "_several", "_bucket"]
        out = {n: [] for n in [*names, "_text"]}
        for did, tid, t, found in zip(*(column(batch, c).to_pylist() for c in ("_did", "_tid", "text", "_runs"))):
            if (did, tid) in done:
                continue
            done.add((did, tid))
            raw = (t or "").encode("utf-8", "replace")
            for r in found:
                out["_text"].append(raw[r["_p"] - r["_high"] : r["_p"] - r["_low"] + WIDTH])
                for n in names:
                    out[n].append(r[n])
            if len(out["_text"]) > 4000:
                yield out
                out = {n: [] for n in out}
        yield out

    return map_slices(joined, run, "_g long, _h long, _low long, _high long, _several boolean, _bucket int, _text binary")


def removed_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """_did, _tid, _spans (array of from, to; overlapping) of the documents that lose bytes."""
    spark = docs.sparkSession
    path = new_path(spark, "anchors")
    every = written(anchor_frame(docs), "anchors", path)
    # Written first: both sides of the join then come from a shuffle of their own, and a frequent gram's side can be split.
    again = written(every.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1").select("_g"), "repeated")
    places = written(every.join(again, "_g"), "places")
    remove(spark, path)
    loc = F.struct("_did", "_tid", "_p")
    runs = places.groupBy(*RUN).agg(F.min(loc).alias("_a"), F.count("*").alias("_k"), F.min("_lead").alias("_lead"))
    runs = written(runs.select(*RUN, "_lead", "_a.*", (F.col("_k") > 1).alias("_several")), "runs")
    size = runs.groupBy("_g").agg(F.count("*").alias("_n"), F.max("_several").alias("_any"))
    hot_grams = written(size.where(F.col("_n") > hot).select("_g"), "hot")
    n_hot, total = hot_grams.count(), runs.count()
    n = int(min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)))
    sample = sorted((r._lead, r._g) for r in runs.sample(min(1.0, SAMPLE / max(1, total)), seed=11).select("_lead", "_g").limit(2 * SAMPLE).collect())
    cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    sent = spark.sparkContext.broadcast(cuts)  # at most BUCKETS pairs of numbers

    @F.pandas_udf("int")
    def bucket_of(lead: pd.Series, g: pd.Series) -> pd.Series:
        at = sent.value
        return pd.Series([bisect_right(at, x) for x in zip(lead.tolist(), g.tolist())], dtype="int32")

    placed = runs.withColumn("_bucket", bucket_of("_lead", "_g"))
    text = with_texts(placed, docs)
    calm = text.join(hot_grams.hint("broadcast") if n_hot < 10_000 else hot_grams, "_g", "left_anti") if n_hot else text
    found = calm.repartition(n, "_bucket").sortWithinPartitions("_bucket").mapInPandas(sort_buckets, SPANS)
    if n_hot:
        hot_text = text.join(hot_grams.hint("broadcast") if n_hot < 10_000 else hot_grams, "_g", "left_semi")
        found = found.unionByName(hot_windows(hot_text.drop("_bucket")))
    # Rows equal in id and text hold their runs at the same places: they are told once here, and met by every row at the end.
    at = places.select("_did", "_tid", "_p", *RUN).distinct()
    # ``found`` has a run once: its rows come straight from a shuffle, so that a frequent run's places can be split.
    hits = at.join(found, RUN)
    spans = F.zip_with("_from", "_to", lambda a, b: F.struct((F.col("_p") + a).alias("from"), (F.col("_p") + b).alias("to")))
    return hits.select("_did", "_tid", spans.alias("_s")).groupBy("_did", "_tid").agg(F.flatten(F.collect_list("_s")).alias("_spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def dedup_bytes(docs: DataFrame, hot: int = HOT, passages: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay), removed (merged spans); with ``passages`` also
    n_repeat_words (words in 50-word windows that stand in another row too; they stay unless their bytes go)."""
    d = need(docs, doc_id="long", text="string")
    d = d.select(id_or_last("doc_id").alias("_did"), F.xxhash64("text").alias("_tid"), "text")
    joined = d.join(removed_spans(d, hot), ["_did", "_tid"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<from: long, to: long>>"
    if passages:
        joined = joined.join(passage_words(d), ["_did", "_tid"], "left")
        schema += ", n_repeat_words long"

    def run(batch):
        out = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed")}
        if passages:
            out["n_repeat_words"] = column(batch, "n_repeat_words").fill_null(0)
        for did, t, spans in zip(*(column(batch, c).to_pylist() for c in ("_did", "text", "_spans"))):
            raw = (t or "").encode("utf-8", "replace")
            m = merged([(s["from"], s["to"]) for s in spans or []])
            kept = cut(raw, m)
            for n, v in zip(out, (None if did == NULL_ID else did, len(raw), len(raw) - len(kept), len(m), kept, [{"from": a, "to": b} for a, b in m])):
                out[n].append(v)
        return out

    return map_slices(joined, run, schema)


def dedup_digests(docs: DataFrame, hot: int = HOT, passages: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``passages`` also n_repeat_words."""
    more = ["n_repeat_words"] if passages else []
    return dedup_bytes(docs, hot, passages).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def brute(texts_: list[str | None]) -> list[list[tuple[int, int]]]:
    """What is removed of each text, by counting every window; for tests."""
    times: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts_]
    for r in raws:
        for i in range(len(r) - WIDTH + 1):
            h = hashlib.blake2b(r[i : i + WIDTH], digest_size=16).digest()
            times[h] = times.get(h, 0) + 1
    return [merged([(i, i + WIDTH) for i in range(len(r) - WIDTH + 1) if times[hashlib.blake2b(r[i : i + WIDTH], digest_size=16).digest()] > 1]) for r in raws]
