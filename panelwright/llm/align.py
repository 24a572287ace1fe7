"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (tokenizers, byte-level) encodes a space and the text, tokenizer B (sentencepiece) the text, to which it adds the
space itself. Both give character offsets of their tokens: *coarse* cuts. A token of part of a multibyte character, or one of
several byte-fallback tokens of a character, has the offsets of the whole character or none; there the cut follows from the
decoded bytes of the tokens. The installed sentencepiece has no immutable proto any more; its offset mapping gives the same
spans.

1. ``Pair.spans``: bytes that both cut alike end a *group*; each stretch between neighbouring cuts of either is a *link* of the
   A and the B token it lies in. One pass over the texts writes, per document, the group string's digest, the counts and its
   distinct linked id pairs with their times.
2. A grouped count of the documents per id pair, combined map-side, and the largest per A id.
3. The documents look up their pairs: in a sorted array in each task while the pairs number at most BOUND (16 bytes each),
   else by a shuffle join of the exploded pairs, summed per document. The result is the same.

Texts are encoded piece by piece where both files allow (``subwords``: every cut between pieces is one of both tokenizers);
a bounded table per worker keeps short pieces' groups and links.

Nulls and odd cases: a text that is null, empty, or does not come back from the tokens' bytes (one with U+2581) has no tokens:
zeros and an empty group string. Texts of any length are aligned whole; rows are independent, so repeated rows and rows
without id count as documents of their own; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import subwords
from panelwright.llm.common import column, map_slices, need, new_path, texts, written

#: Pieces a worker keeps at most, the longest kept; id pairs looked up in a task's array at most.
KEPT, KEPT_CHARS, BOUND = 250_000, 64, 2_000_000
#: Characters of pieces that are encoded in one call.
JOINED = 20_000
#: Fixed value of byte-level vocabularies: bytes shown as themselves; the others follow from U+0100 on, in order.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_level_bytes(token: str) -> bytes:
    return bytes(map(_BYTE.__getitem__, token))


_BYTE = {chr(b): b for b in SHOWN}
_BYTE |= {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class Pair:
    """Two tokenizers, the bytes of their tokens, and the worker's table of pieces."""

    def __init__(self, a: subwords.Library, b: subwords.Library):
        self.a, self.b = a.json, b.model
        vocabulary = a.json.get_vocab(with_added_tokens=True)
        names = dict(zip(vocabulary.values(), vocabulary))
        self.a_bytes = [byte_level_bytes(names[i]) if i in names and all(c in _BYTE for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [b.model.id_to_piece(i) for i in range(b.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        #: Written ids by (tokenizer, whether the token ends its side of a group).
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}{m}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for m in marks for i in range(n)]
        self.from_b = 2 * n_a
        self.cuts = a.cuts and b.cuts
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.strings: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.ends, self.links = array("q"), array("q"), array("q"), array("q", [0]), array("q")
        self.bad: set[int] = set()

    def spans(self, texts_: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]] | None:
        """Of the texts laid one after the other, each with a space before it: ids and byte ends of A's tokens and of B's;
        or, if tokens of some texts do not give back their bytes, those texts."""
        spaced = [" " + t for t in texts_]
        whole = "".join(spaced)
        raw = whole.encode("utf-8", "replace")
        at = np.arange(len(raw) + 1)
        if len(raw) != len(whole):
            code = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        size = np.array([len(t) for t in spaced])
        begin = np.cumsum(size) - size
        out, bad = [], set()
        coded_a = self.a.encode_batch(spaced, add_special_tokens=False)
        coded_b = self.b.encode(texts_, num_threads=1, return_type="offset_mapping")
        for ids, ends, extra, length, known in (
            ([np.array(e.ids, np.int64) for e in coded_a], [[o[1] for o in e.offsets] for e in coded_a], 0, self.a_length, self.a_bytes),
            ([np.array(e["ids"], np.int64) for e in coded_b], [[o[1] for o in e["offsets"]] for e in coded_b], 1, self.b_length, self.b_bytes),
        ):
            flat = np.concatenate(ids)
            if b"".join(map(known.__getitem__, flat.tolist())) != raw:
                bad |= {k for k, x in enumerate(ids) if b"".join(map(known.__getitem__, x.tolist())) != spaced[k].encode("utf-8", "replace")}
                continue
            coarse = at[np.repeat(begin, [len(x) for x in ids]) + np.concatenate([np.array(e, np.int64) for e in ends]) + extra]
            # The tokens' decoded bytes give each cut; they replace coarse cuts inside characters.
            exact = np.cumsum(length[flat])
            off = coarse != exact
            coarse[off] = exact[off]
            out.append((flat, coarse))
        return out, sorted(bad)

    def learn(self, pieces: list[str]) -> None:
        """Groups and links of pieces, appended to the table's arrays in order.

        Pieces are joined by the spaces they were cut at, up to JOINED characters; those with white space at an end, or of
        files that may not be cut, stay alone."""
        texts_, members, room = [], [], 0
        for k, p in enumerate(pieces):
            alone = not self.cuts or not p or p[0].isspace() or p[-1].isspace()
            if alone or room < len(p):
                texts_.append([])
                members.append([])
                room = 0 if alone else JOINED
            texts_[-1].append(p)
            members[-1].append(k)
            room -= len(p) + 1
        order = [k for m in members for k in m]
        good = [True] * len(pieces)
        found, bad = self.spans([" ".join(t) for t in texts_])
        if bad:
            single = [k for x in bad for k in members[x] if len(members[x]) > 1]
            lost = {k for x in bad for k in members[x] if len(members[x]) == 1}
            lost |= {single[x] for x in self.spans([pieces[k] for k in single])[1]} if single else set()
            good = [k not in lost for k in range(len(pieces))]
            rest = [k for k in order if good[k]]
            joined = [[pieces[k] for k in m if good[k]] for m in members]
            found = self.spans([" ".join(t) for t in joined if t])[0] if rest else []
            order = rest
        first = len(self.strings)
        self.bad.update(first + k for k, yes in enumerate(good) if not yes)
        self._append([pieces[k] for k in order], order, len(pieces), found)

    def _append(self, pieces: list[str], places: list[int], n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Entries for ``n`` pieces, of which those at ``places`` have tokens, in the order of the spans."""
        strings, start = [""] * n, len(self.links)
        counts = np.zeros((4, n), np.int64)
        if pieces:
            (a, a_end), (b, b_end) = found
            stop = np.cumsum([1 + len(p.encode("utf-8", "replace")) for p in pieces])
            a_cut, b_cut = np.zeros(stop[-1] + 1, bool), np.zeros(stop[-1] + 1, bool)
            a_cut[a_end] = b_cut[b_end] = True
            both = np.flatnonzero(a_cut & b_cut)
            every = np.flatnonzero(a_cut | b_cut)
            links = (a[np.searchsorted(a_end, every)] << 32) | b[np.searchsorted(b_end, every)]
            # Place of every token in the written form: A's tokens of a group, then B's.
            a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
            code = np.empty(len(a) + len(b), np.int64)
            code[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + len(self.a_bytes) * b_cut[a_end]
            code[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = self.from_b + b + len(self.b_bytes) * a_cut[b_end]
            text = list(map(self.written.__getitem__, code.tolist()))
            to = [np.searchsorted(x, stop, "right") for x in (a_end, b_end, both, every)]
            from_ = 0
            for k, end in zip(places, (to[0] + to[1]).tolist()):
                strings[k] = "".join(text[from_:end])
                from_ = end
            for row, ends in zip(counts, to):
                row[places] = np.diff(ends, prepend=0)
            if places != sorted(places):  # links in the order of the entries
                size = counts[3][places]
                begin = np.zeros(n, np.int64)
                begin[places] = np.cumsum(size) - size
                links = links[np.repeat(begin - np.cumsum(counts[3]) + counts[3], counts[3]) + np.arange(len(links))]
            self.links.frombytes(links.tobytes())
        self.strings += strings
        for mine, row in zip((self.n_a, self.n_b, self.n_groups, self.ends), (*counts[:3], start + np.cumsum(counts[3]))):
            mine.frombytes(row.tobytes())

    def forget(self, n: int) -> None:
        """Drop all entries after the first ``n``."""
        del self.strings[n:], self.n_a[n:], self.n_b[n:], self.n_groups[n:], self.ends[n + 1 :]
        del self.links[self.ends[n] :]
        self.bad = {k for k in self.bad if k < n}

    def documents(self, docs: list[str | None]) -> dict[str, list]:
        """Per text: n_a, n_b, n_groups, groups_sha256, _pairs (A id << 32 | B id, ascending), _times."""
        if len(self.table) > KEPT:
            self.clear()
        parts = [(subwords.cut(t) if self.cuts else [t]) if t else [] for t in docs]
        table = self.table
        fresh = list(set().union(*parts).difference(table))
        short = [p for p in fresh if len(p) <= KEPT_CHARS]
        long = [p for p in fresh if len(p) > KEPT_CHARS]
        if short:
            table.update(zip(short, range(len(self.strings), len(self.strings) + len(short))))
            self.learn(short)
        kept = len(self.strings)
        if long:
            table = table | dict(zip(long, range(kept, kept + len(long))))
            self.learn(long)
        get = table.__getitem__
        places = [list(map(get, ps)) for ps in parts]
        digest = [""] * len(docs)
        for k, at in enumerate(places):
            if at and self.bad and not self.bad.isdisjoint(at):
                places[k] = []
            elif at:
                digest[k] = hashlib.sha256("".join(map(self.strings.__getitem__, at))[:-1].encode()).hexdigest()
        n_a, n_b, n_g, ends, links = (np.array(x, np.int64) for x in (self.n_a, self.n_b, self.n_groups, self.ends, self.links))
        doc = np.repeat(np.arange(len(docs)), [len(p) for p in places])
        at = np.array([i for p in places for i in p], np.int64)
        out: dict[str, list] = {n: np.bincount(doc, v[at], len(docs)).astype(np.int64) for n, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_g))}
        # Distinct pieces of every document, then distinct pairs, both by one sort.
        key, times = counted(doc * (len(self.strings) + 1) + at, np.ones(len(at), np.int64))
        doc, at = np.divmod(key, len(self.strings) + 1)
        size = ends[at + 1] - ends[at]
        place = np.repeat(ends[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs, which = np.unique(links[place], return_inverse=True)
        key, hits = counted(np.repeat(doc, size) * (len(pairs) + 1) + which, np.repeat(times, size))
        doc, which = np.divmod(key, len(pairs) + 1)
        cuts = np.searchsorted(doc, np.arange(1, len(docs)))
        self.forget(kept)
        return out | {"groups_sha256": digest, "_pairs": np.split(pairs[which], cuts), "_times": np.split(hits, cuts)}


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


_pairs: dict[tuple, Pair] = {}


def pair_for(a: subwords.Library, b: subwords.Library) -> Pair:
    """The worker's pair of these tokenizers."""
    key = (id(a), id(b))
    if key not in _pairs:
        _pairs[key] = Pair(a, b)
    return _pairs[key]


def lists(values: list, kind: pa.DataType) -> pa.Array:
    """Arrays or lists of numbers as a list column."""
    sizes = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *map(np.asarray, values)]).astype(np.int64), kind))


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, groups_sha256, _pairs, _times."""
    spark = docs.sparkSession
    a, b = subwords.shared_library(spark, a_path, plain=True), subwords.shared_library(spark, b_path, plain=True)

    def run(batch):
        got = pair_for(a(), b()).documents(texts(batch))
        return {"doc_id": column(batch, "doc_id")} | got | {"_pairs": lists(got["_pairs"], pa.int64()), "_times": lists(got["_times"], pa.int32())}

    return map_slices(need(docs, doc_id="long", text="string"), run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, _pairs array<long>, _times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """_pair, _n (documents that hold it), _best (whether no other pair of its A id has more)."""
    n = rows.select(F.explode("_pairs").alias("_pair")).groupBy("_pair").agg(F.count("*").alias("_n"))
    n = written(n, "pair-counts")
    a = F.shiftright("_pair", 32)
    most = n.groupBy(a.alias("_a")).agg(F.max("_n").alias("_most"))
    return n.join(most, a == most["_a"]).select("_pair", "_n", (F.col("_n") == F.col("_most")).alias("_best"))


def align(docs: DataFrame, a_path: str, b_path: str, bound: int = BOUND) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    path = new_path(spark, "linked")
    rows = written(linked(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "linked", path)
    counts = written(pair_counts(rows), "pairs")
    total = counts.count()
    links = F.coalesce(F.aggregate("_times", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")).alias("n_links")
    columns = ["doc_id", "n_a", "n_b", "n_groups", links]
    if total > bound:
        each = rows.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_p")).select("_row", F.col("_p._pairs").alias("_pair"), F.col("_p._times").alias("_t"))
        sums = each.join(counts, "_pair").groupBy("_row").agg(F.sum(F.when(F.col("_best"), F.col("_t")).otherwise(0)).alias("n_best"), F.sum(F.col("_t") * F.col("_n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        return rows.join(sums, "_row", "left").select(*columns, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    known = counts.toArrow().sort_by("_pair")  # at most ``bound`` rows
    sent = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("_pair", "_n", "_best")))

    def run(batch):
        pair, n, best = sent.value
        p, t = column(batch, "_pairs"), column(batch, "_times")
        at = np.searchsorted(pair, p.flatten().to_numpy())
        times = t.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(p).to_numpy())])
        total = [np.concatenate([[0], np.cumsum(v)])[ends] for v in (times * best[at], times * n[at])] if len(times) else [np.zeros(len(ends), np.int64)] * 2
        same = {c: column(batch, c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        return same | {"n_best": np.diff(total[0]), "count_sum": np.diff(total[1])}

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_slices(rows.select(*columns, "groups_sha256", "_pairs", "_times"), run, schema)
