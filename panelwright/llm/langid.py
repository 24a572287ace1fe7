"""Language ID by string kernels.

The kernel of two texts counts the byte n-grams (n = 1, 2, 3 of the lower-cased text) that both contain, each once
(blended-spectrum presence kernel), normalised to 1 for a text with itself. A bounded sample of labelled texts gives the
landmarks; Nystroem features K(x, landmarks) K(landmarks, landmarks)^(-1/2) go into one kernel ridge regression per
language against the rest. Scoring is one matrix product per batch: presence of the landmarks' n-grams times their
presence matrix times the weights.

Sample (documented bounds): per language the ``per_language`` learnable documents with the smallest hash of doc_id, at
most SAMPLE in all languages; the first ``landmarks`` of each language's are landmarks, at most LANDMARKS in all.

Nulls and odd cases: null or letterless texts are ``und`` with score 0; null langs and ids are never learnt from; without
any learnable row every text is ``und``; rows are independent, so repeated rows pass through; whole texts are read in
blocks, however long; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, held_out, learnable, map_slices, need, smallest_hashes, texts

SAMPLE, LANDMARKS = 4096, 256
LETTER = regex.compile(r"\p{L}")
GRAMS = 1 << 24
BLOCK = 1 << 20
#: Cells of a batch's presence matrix at most.
CELLS = 4_000_000

_mark: list[np.ndarray] = []


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Each value once, without a sort: the last position that wrote a value wins."""
    if not _mark:
        _mark.append(np.zeros(GRAMS, np.int32))
    at = np.arange(len(ids), dtype=np.int32)
    _mark[0][ids] = at
    return ids[_mark[0][ids] == at]


def grams(text: str) -> np.ndarray:
    """Ids of the distinct n-grams; shorter ones are padded with zero bytes in front and a zero byte counts as a blank."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    found = []
    for at in range(0, max(1, len(raw)), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.int32)
        b[b == 0] = 32
        found.append(_distinct(np.concatenate([b, (b[:-1] << 8) + b[1:], (b[:-2] << 16) + (b[1:-1] << 8) + b[2:]])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    languages: list[str]
    ids: np.ndarray  # n-grams of the landmarks, ascending
    presence: np.ndarray  # ids x landmarks, each column divided by the root of its landmark's size
    weights: np.ndarray  # landmarks x languages

    def kernel(self, texts_: list[str], lookup: np.ndarray) -> np.ndarray:
        out, step = [], max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(texts_), step):
            part = texts_[at : at + step]
            p = np.zeros((len(part), len(self.ids) + 1), np.float32)
            norm = np.ones(len(part), np.float32)
            for k, t in enumerate(part):
                g = grams(t)
                norm[k] = max(1, len(g))
                p[k, lookup[g]] = 1
            out.append((p[:, 1:] @ self.presence) / np.sqrt(norm)[:, None])
        return np.concatenate(out) if out else np.zeros((0, self.presence.shape[1]), np.float32)


_lookups: list[tuple[Model, np.ndarray]] = []


def lookup_of(model: Model) -> np.ndarray:
    """From n-gram to column plus one, 0 if no landmark has it; a worker keeps the table of the model it used last."""
    if not _lookups or _lookups[0][0] is not model:
        table = np.zeros(GRAMS, np.int32)
        table[model.ids] = np.arange(1, len(model.ids) + 1)
        _lookups[:] = [(model, table)]
    return _lookups[0][1]


def start_model(texts_: list[str]) -> Model:
    sets = [grams(t) for t in texts_]
    ids = np.unique(np.concatenate(sets))
    p = np.zeros((len(ids), len(sets)), np.float32)
    for k, g in enumerate(sets):
        p[np.searchsorted(ids, g), k] = 1 / np.sqrt(max(1, len(g)))
    return Model([], ids, p, np.zeros((len(sets), 0)))


def ridge(model: Model, own: np.ndarray, kernel: np.ndarray, labels: list[str], strength: float) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features."""
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = np.hstack([kernel @ root, np.ones((len(labels), 1))])
    languages = sorted(set(labels))
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels])
    w = np.linalg.solve(phi.T @ phi + strength * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, model.ids, model.presence, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))


def fit(docs: DataFrame, per_language: int = 192, landmarks: int = 24, strength: float = 0.1) -> Model | None:
    """None if there is nothing to learn from."""
    d = need(docs, doc_id="long", text="string", lang="string")
    known = d.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = smallest_hashes(known, "lang", "doc_id", per_language)[0].orderBy("_k", "lang").limit(SAMPLE)
    chosen = [(r.doc_id, r.lang, r._k) for r in chosen.collect()]  # at most SAMPLE ids
    if not chosen:
        return None
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i, x, k) for i, x, k in chosen], "doc_id long, _lang string, _k int").dropDuplicates(["doc_id"])
    sample = d.join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("_lang")).dropDuplicates(["doc_id"])
    marks = sample.where(F.col("_k") <= landmarks).orderBy("_k", "lang").limit(LANDMARKS).select("text").collect()
    model = start_model([r.text for r in marks])
    rows = kernel_rows(sample, model).collect()  # SAMPLE short vectors
    labels = [r.lang for r in rows]
    own = model.presence.T.astype(np.float64) @ model.presence
    return ridge(model, own, np.array([r.k for r in rows]), labels, strength)


def kernel_rows(sample: DataFrame, model: Model) -> DataFrame:
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = sent.value
        k = m.kernel([t or "" for t in texts(batch)], lookup_of(m))
        return {"lang": column(batch, "lang"), "k": list(k.astype(np.float64))}

    return map_slices(sample, run, "lang string, k array<double>")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (half of one plus the winner's margin, kept in 0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS columns

    def run(batch):
        m, all_texts = sent.value, texts(batch)
        lang, score = ["und"] * len(all_texts), [0.0] * len(all_texts)
        at = [k for k, t in enumerate(all_texts) if m is not None and t and LETTER.search(t)]
        if at:
            s = m.kernel([all_texts[k] for k in at], lookup_of(m)) @ m.weights[:-1] + m.weights[-1]
            for k, row in zip(at, s):
                best = int(row.argmax())
                lang[k], score[k] = m.languages[best], float(min(1.0, max(0.0, (1 + row[best]) / 2)))
        return {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "lang_pred": lang, "score": score}

    d = need(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id")))
    return map_slices(d, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **how) -> DataFrame:
    return predict(docs, fit(docs, **how))
