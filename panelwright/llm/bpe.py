"""Byte-level BPE by a hierarchical-bitmap rank queue.

The bytes of a pre-token form a linked list. Every adjacent pair that the ranks know goes into the bucket of its merge
rank, as a list position; a two-level bitmap marks the non-empty buckets, so the lowest rank is found by two
find-first-set steps. Positions of a bucket are taken in ascending order; an entry whose pair has changed since is stale
and skipped. A merge costs two find-first-set steps and a heap step in its bucket, logarithmic in the bucket's positions,
without the rescans that make the usual loop quadratic. Distinct pre-tokens are kept in a bounded table per worker. Digests
of decoded bytes are taken from the ids of the whole text.

Nulls and odd cases: a null text counts as empty and gives no ids; lone surrogates cannot occur in Spark strings; texts of
any length are encoded whole; rows are independent, so repeated rows and null ids pass through; further columns are left
out by the digest and kept by ``round_trips``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwright.llm.common import SLICE, column, map_slices, need, texts
from panelwright.session import small_batches

#: Half the distinct pre-tokens a worker keeps at most; longer ones are not kept.
CACHED, CACHED_CHARS = 400_000, 64


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        #: Recent pre-tokens, and those of the time before: the least recently used half goes when the table is full.
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        get = ranks.get
        end = list(range(1, n + 1))  # of the piece that begins at a position; 0: swallowed
        before = list(range(-1, n - 1))
        # Of rank r, bit r & 63 of fine[r >> 6] says that buckets[r] has positions, bit r >> 6 of coarse that fine has bits.
        coarse, fine, buckets = 0, {}, {}
        todo = [(r, i) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        while True:
            for r, i in todo:
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    h = r >> 6
                    if h in fine:
                        fine[h] |= 1 << (r & 63)
                    else:
                        fine[h] = 1 << (r & 63)
                        coarse |= 1 << h
            todo = []
            if not coarse:
                break
            h = (coarse & -coarse).bit_length() - 1
            bits = fine[h]
            rank = (h << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                if bits:
                    fine[h] = bits
                else:
                    del fine[h]
                    coarse &= coarse - 1
            mid = end[i]
            if not mid or mid >= n or get(raw[i : (stop := end[mid])]) != rank:
                continue  # stale
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    todo.append((r, i))
            if (p := before[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                todo.append((r, p))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.merge(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def known(self, piece: str) -> bytes:
        """Decimal ids of a pre-token, whose decoded bytes are compared with its own once."""
        got = self.older.get(piece)
        if got is None:
            raw = piece.encode()
            ids = self.merge(raw)
            if self.decode(ids) != raw:
                raise ValueError("the ranks do not cover all bytes")
            got = b" ".join([b"%d" % i for i in ids])
        if len(piece) <= CACHED_CHARS:
            if len(self.table) >= CACHED:
                self.older, self.table = self.table, {}
            self.table[piece] = got
        return got

    def joined(self, pieces: list[str]) -> bytes:
        """Decimal ids of a text's pre-tokens, joined by spaces."""
        get = self.table.get
        return b" ".join([get(p) or self.known(p) for p in pieces])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.fromstring(self.joined(self.find(text)), np.int32, sep=" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their digest, and that of the bytes they decode to."""
        ids = self.joined(self.find(text))
        numbers = np.fromstring(ids, np.int32, sep=" ").tolist()
        return len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(numbers)).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The driver's last broadcast by application and contents, and a worker's codecs by broadcast.
_sent: dict[tuple[str, str], Broadcast] = {}
_codecs: WeakKeyDictionary = WeakKeyDictionary()


def codec_for(sent) -> Codec:
    """The worker's codec of a broadcast. A function of the module, so that tasks share the module's table; a worker that
    goes on to tasks without the broadcast drops it, and the table of pre-tokens with it."""
    if sent not in _codecs:
        _codecs[sent] = Codec(*sent.value)
    return _codecs[sent]


def shared_codec(spark: SparkSession, path: str, pattern: str):
    """A function that gives a task its worker's codec; the ranks (a fixed file, about 1 MB) are read once by the driver.

    Calls with the same contents share one broadcast, so that later tasks of a worker find its table of pre-tokens filled."""
    ranks = read_ranks(path)
    key = spark.sparkContext.applicationId, hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    if key not in _sent:
        _sent.clear()
        _sent[key] = spark.sparkContext.broadcast((ranks, pattern))
    sent = _sent[key]

    return lambda: codec_for(sent)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    codec = shared_codec(docs.sparkSession, path, pattern)

    def run(batch):
        c = codec()
        rows = [c.digest(t or "") for t in texts(batch)]
        return {"doc_id": column(batch, "doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(["n_tokens", "ids_sha256", "decoded_sha256"])}

    return map_slices(need(docs, doc_id="long", text="string"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` with n_tokens, ids of ``text`` and decoded (the text that the ids stand for); clashing
    columns are replaced."""
    codec = shared_codec(docs.sparkSession, path, pattern)
    rest = docs.drop("n_tokens", "ids", "decoded")
    more = T._parse_datatype_string("n_tokens int, ids array<int>, decoded string")
    schema = T.StructType([*rest.schema.fields, *more.fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE // 4):
                part, c = batch.slice(at, SLICE // 4), codec()
                ids = [c.ids(t or "") for t in texts(part)]
                n = [len(i) for i in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
                back = pa.array([c.decode(i.tolist()).decode("utf-8", "replace") for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int32()), lists, back], names=[*part.schema.names, "n_tokens", "ids", "decoded"])

    return small_batches(rest).mapInArrow(run, schema)
