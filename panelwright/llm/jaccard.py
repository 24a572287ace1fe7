"""N-gram Jaccard join by MinHash banding.

Texts become sets of ``k``-word shingles (ASCII white space separates words, A-Z lower-cased; a text of fewer words is one
shingle). Texts with equal sets form a class, of which one representative goes on, so copies never meet. Bands and rows
are the cheapest pair that finds a link at the threshold with probability ``recall``. Band hashes are shuffled; buckets
with one representative are dropped, and of buckets with the same members (most near copies share many bands) one stays.
The members' full shingle sets meet bucket by bucket: sets are compared by products of presence matrices, a pair only in
the first band that it shares, so each link counts once. Buckets over BLOCK members are cut into pairs of blocks, so that
no group is one task's work; a task emits sums per member and a spanning star per linked part, never the pairs.

Result: one row per document with class_id (smallest doc_id of all texts linked with it, directly or over others),
copy_id (smallest doc_id with the same shingle set) and n_links (documents linked directly, copies included).

Nulls and odd cases: null and wordless texts have no shingle and stay alone; a null doc_id counts as the largest id and
comes back as null; rows that share a doc_id (or have none) are told apart by their texts: each gets a row and the class
of its own text, and they count as copies where their sets agree; very long texts are used whole; further columns are left out by the join and kept by the
filter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NULL_ID, column, id_or_last, map_slices, need, new_path, remove, texts, written
from panelwright.llm.tokens import U, mix, windows, word_hashes
from panelwright.session import small_batches

K, THRESHOLD, RECALL, BLOCK = 5, 0.8, 0.9995, 512
#: What tells rows apart: id and text.
ROW = ["_did", "_t1", "_t2"]


def with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_did": id_or_last(docs["doc_id"].cast("long")), "_t1": F.xxhash64(docs["text"]), "_t2": F.xxhash64(F.lit(1), docs["text"])})


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows per band, which keeps false candidates rare, within ``most`` hash functions."""
    best = None
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if best is None or bands * rows <= most:
            best = bands, rows
    return best


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return x[:n] | U(1), x[n:]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    h = word_hashes((text or "").translate(_LOWER) if text and not text.islower() else text or "")
    return np.unique(windows(h, min(k, len(h)))) if len(h) else np.empty(0, U)


_LOWER = {c: c + 32 for c in range(65, 91)}
STEP = 1 << 14


def signature(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band."""
    a, b = seeds(bands * rows)
    low = np.full(bands * rows, 2**64 - 1, U)
    for at in range(0, len(s), STEP):
        part = s[at : at + STEP]
        for j in range(len(a)):
            low[j] = min(low[j], ((part ^ b[j]) * a[j]).min())
    out = np.zeros(bands, U)
    for r in range(rows):
        out = mix(out * U(31) + low.reshape(bands, rows)[:, r])
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """_did, _t1, _t2 (hash of the text), _k1, _k2 (hash of the shingle set, null without shingles), _bands."""

    def run(batch):
        k1, k2, sig = [], [], []
        for t in texts(batch):
            s = shingles(t, k)
            if len(s):
                k1.append(int(mix(s).sum(dtype=U).view(np.int64)))
                k2.append(int((mix(s * U(0xD6E8FEB86659FD93) + U(len(s)))).sum(dtype=U).view(np.int64)))
                sig.append(signature(s, bands, rows).view(np.int64))
            else:
                k1.append(None), k2.append(None), sig.append(None)
        return {c: column(batch, c) for c in ROW} | {"_k1": k1, "_k2": k2, "_bands": sig}

    return map_slices(docs, run, "_did long, _t1 long, _t2 long, _k1 long, _k2 long, _bands array<long>")


def links_of(sets: list[np.ndarray], sigs: np.ndarray, left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) with a Jaccard of at least ``threshold`` whose first shared band is this bucket's.

    ``left``: members before it are one block and the rest another (0: one block, all pairs)."""
    m, size = len(sets), np.array([len(s) for s in sets], np.float64)
    if m == 2:
        inter = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]], np.float64)
    else:
        value, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), size.astype(int))
        common = np.bincount(at, minlength=len(value)) > 1
        keep = common[at]
        column_of = np.cumsum(common) - 1
        at, owner = column_of[at[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        inter = np.zeros((m, m), np.float32)
        for c in range(0, int(common.sum()), 4096):
            b, e = np.searchsorted(at, [c, c + 4096])
            p = np.zeros((m, min(4096, int(common.sum()) - c)), np.float32)
            p[owner[b:e], at[b:e] - c] = 1
            inter += p @ p.T
    union = size[:, None] + size[None, :] - inter
    a, b = np.nonzero(np.triu(inter >= threshold * union - 1e-9, 1))
    if left:
        across = (a < left) & (b >= left)
        a, b = a[across], b[across]
    return a, b


def bucket_work(threshold: float):
    """mapInArrow over rows sorted by unit (a bucket, or two blocks of a large one)."""

    names = ["_did", "_k1", "_links", "_near", "_near_k1"]

    def finish(rows: list[tuple]) -> tuple[list[int], ...]:
        rows.sort(key=lambda r: (r[1], r[2], r[8]))  # block, id, set
        rows = [r for n, r in enumerate(rows) if not n or (r[2], r[8]) != (rows[n - 1][2], rows[n - 1][8])]  # repeated rows
        ids = [(r[2], r[8]) for r in rows]
        weight = np.array([r[3] for r in rows])
        sigs = np.array([r[4] for r in rows])
        sets = [np.frombuffer(r[5], U) for r in rows]
        band = rows[0][6]
        left = sum(r[1] == rows[0][1] for r in rows) if rows[0][1] != rows[-1][1] else 0
        if rows[0][7] and not left:
            return tuple([] for _ in names)  # a unit of two blocks of which one is missing
        a, b = links_of(sets, sigs, left, threshold)
        if len(a) and band:
            first = ~(sigs[a, :band] == sigs[b, :band]).any(axis=1)
            a, b = a[first], b[first]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root = list(range(len(ids)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        hit = np.flatnonzero(links)
        least: dict[int, tuple[int, int]] = {}
        for x in hit:
            r = find(int(x))
            least[r] = min(least.get(r, ids[x]), ids[x])
        near = [least[find(int(x))] for x in hit]
        return [ids[x][0] for x in hit], [ids[x][1] for x in hit], [int(links[x]) for x in hit], [i for i, _ in near], [k for _, k in near]

    def run(batches):
        unit, rows, out = None, [], tuple([] for _ in names)

        def close():
            if len(rows) > 1:
                for o, g in zip(out, finish(rows)):
                    o.extend(g)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols):
                if row[0] != unit:
                    close()
                    unit, rows = row[0], []
                rows.append(row)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
                out = tuple([] for _ in names)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

    return run


def buckets_of(reps: DataFrame) -> DataFrame:
    """(_did, _k1, _unit, _part, _band, _two): the units of work each representative takes part in."""
    rows = reps.select("_did", "_k1", F.posexplode("_bands").alias("_band", "_hash"))
    sizes = rows.groupBy("_band", "_hash").agg(F.count("*").alias("_m"), F.sum(F.xxhash64("_did", "_k1").cast("decimal(20,0)")).cast("string").alias("_sum"), F.min("_did").alias("_least")).where("_m > 1")
    # Buckets with the same members: the one of the first band stays.
    chosen = sizes.groupBy("_m", "_sum", "_least").agg(F.min(F.struct("_band", "_hash")).alias("_b"))
    chosen = chosen.select("_b.*", "_m", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_n"))
    members = rows.join(chosen, ["_band", "_hash"])
    part = F.pmod(F.xxhash64("_did", "_k1", F.lit(3)), F.col("_n").cast("long")).cast("int")
    members = members.withColumn("_part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    members = members.withColumn("_other", other)
    low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
    unit = F.concat_ws("/", "_band", "_hash", low, high)
    return members.select("_did", "_k1", unit.alias("_unit"), "_part", "_band", (F.col("_part") != F.col("_other")).alias("_two"))


def components(edges: DataFrame) -> DataFrame:
    """(_did, _root): smallest vertex reachable from every vertex of ``edges`` (_a, _b). Labels jump over labels, so the
    number of rounds is about the logarithm of the longest path; each round is a written table."""
    spark = edges.sparkSession
    both = written(edges.select("_a", "_b").union(edges.select(F.col("_b"), F.col("_a"))).where("_a <> _b").distinct(), "edges")
    path = new_path(spark, "labels")
    labels = written(both.groupBy(F.col("_a").alias("_did")).agg(F.min("_b").alias("_l")).select("_did", F.least("_did", "_l").alias("_root")), "labels", path)
    while True:
        seen = both.join(labels, both["_b"] == labels["_did"]).groupBy(F.col("_a").alias("_v")).agg(F.min("_root").alias("_m"))
        better = labels.join(seen, labels["_did"] == seen["_v"]).select("_did", F.least("_root", "_m").alias("_new"), F.col("_root").alias("_old"))
        up = labels.select(F.col("_did").alias("_u"), F.col("_root").alias("_up"))
        jumped = better.join(up, better["_new"] == up["_u"], "left").select("_did", F.least("_new", F.coalesce("_up", "_new")).alias("_root"), "_old")
        new_at = new_path(spark, "labels")
        new = written(jumped, "labels", new_at)
        changed = new.where("_root <> _old").limit(1).count()
        remove(spark, path)
        labels, path = new.select("_did", "_root"), new_at
        if not changed:
            return labels


def classified(docs: DataFrame, k: int, threshold: float, recall: float) -> DataFrame:
    """Per row of ``docs``: _did, _t1, _t2, _k1, _k2, and where there are shingles copy_id, _links and _root, the smallest
    (_did, _k1) of the row's class."""
    bands, rows = banding(threshold, recall)
    d = with_row(need(docs, doc_id="long", text="string"))
    sig = written(signatures(d.select(*ROW, "text"), k, bands, rows), "signatures")
    full = sig.where(F.col("_k1").isNotNull())
    classes = written(full.groupBy("_k1", "_k2").agg(F.min(F.struct(*ROW, "_bands")).alias("_r"), F.count("*").alias("_size")).select("_k1", "_k2", "_r.*", "_size"), "classes")
    # One id may carry several texts (repeated rows, null ids); each keeps its own set.
    units = buckets_of(classes.select("_did", "_k1", "_bands"))
    work = classes.select(*ROW, "_k1", "_k2", "_bands", "_size").join(units.groupBy("_did", "_k1").agg(F.collect_list(F.struct("_unit", "_part", "_band", "_two")).alias("_units")), ["_did", "_k1"])
    work = written(work, "work")
    pairs = d.select(*ROW, "text").join(work, ROW)

    def run(batch):
        out = {n: [] for n in ("_unit", "_part", "_did", "_size", "_bands", "_set", "_band", "_two", "_k1")}
        cols = {n: column(batch, n).to_pylist() for n in ("_did", "_k1", "_bands", "_size", "_units", "text")}
        for did, k1, sigs, size, units_, text in zip(*cols.values()):
            s = shingles(text, k)
            for u in units_:
                for n, v in zip(out, (u["_unit"], u["_part"], did, size, sigs, s.tobytes(), u["_band"], u["_two"], k1)):
                    out[n].append(v)
            if len(out["_unit"]) > 2000:
                yield out
                out = {n: [] for n in out}
        yield out

    schema = "_unit string, _part int, _did long, _size long, _bands array<long>, _set binary, _band int, _two boolean, _k1 long"
    sets = map_slices(pairs, run, schema)
    dealt = sets.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_unit").sortWithinPartitions("_unit")
    found = written(small_batches(dealt).mapInArrow(bucket_work(threshold), "_did long, _k1 long, _links long, _near long, _near_k1 long"), "links")
    vertex = F.struct("_did", "_k1")
    roots = components(found.select(vertex.alias("_a"), F.struct(F.col("_near").alias("_did"), F.col("_near_k1").alias("_k1")).alias("_b")))
    linked = found.groupBy("_did", "_k1").agg(F.sum("_links").alias("_links")).join(roots.select("_did._did", "_did._k1", "_root"), ["_did", "_k1"], "left")
    by_class = classes.select("_k1", "_k2", "_did", "_size").join(linked, ["_did", "_k1"], "left").select("_k1", "_k2", F.col("_did").alias("copy_id"), F.coalesce("_root", vertex).alias("_root"), (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    return sig.select(*ROW, "_k1", "_k2").join(by_class, ["_k1", "_k2"], "left")


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id, copy_id, n_links."""
    out = classified(docs, k, threshold, recall)
    back = lambda c: F.when(c != NULL_ID, c)
    return out.select(back(F.col("_did")).alias("doc_id"), back(F.coalesce("_root._did", "_did")).alias("class_id"), back(F.coalesce("copy_id", "_did")).alias("copy_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Of ``docs``, all columns, one row per class: that with the smallest doc_id, of several such the one with the smallest
    hashes of shingle set, text and row. Rows without shingles all stay."""
    found = classified(docs, k, threshold, recall).where("_root is not null")
    texts_of = written(found.groupBy(*ROW, "_k1").agg(F.first("_root").alias("_root"), F.count("*").alias("_n")), "class-texts")
    # Two levels: the smallest text of the class's smallest vertex, then one of the rows that hold it.
    first = texts_of.where("_did = _root._did and _k1 = _root._k1").groupBy("_did", "_k1").agg(F.min(F.struct("_t1", "_t2", "_n")).alias("_f"))
    chosen = written(first.select("_did", "_f.*"), "class-chosen")
    rows = with_row(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "doc_id", "text")).select("_row", *ROW)
    once = chosen.where("_n = 1").select(*ROW)
    out = rows.join(texts_of.select(*ROW).join(once, ROW, "left_anti"), ROW, "left_anti").select("_row")
    several = chosen.where("_n > 1").select(*ROW)
    if several.limit(1).count():
        held = rows.join(several, ROW)
        out = out.union(held.groupBy(*ROW).agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
