"""Language identification with a string kernel.

The kernel of two texts is the cosine of the presence vectors of their
character n-grams, n = 1 to 3 blended (``features``): it counts the n-grams
that both hold, once each, whole texts, A-Z and other letters lower-cased.
N-grams hash to DIM places. Nystroem landmarks stand for the kernel's feature
map, and one-versus-rest kernel ridge regression is fitted in it. A batch of
texts is scored by two matrix products: presence times landmarks, and that
times the regression weights.

The fit reads a bounded sample: up to PER_CLASS texts of each language with
the least hashes of doc_id; LANDMARKS of them are landmarks, or one of each
language where there are more languages than that. Their presence vectors, not
their texts, come to the driver: PER_CLASS times 2 KB at most for each language.
The ids of the sample are broadcast up to BROADCAST_ROWS and joined beyond.

A text that is null or has no letter is ``und`` with score 0. Rows without
lang or doc_id teach nothing; without any training row every text is ``und``.
Repeated rows keep a row each, and teach with each language that they have;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sample_ids, tidied

DIM, LANDMARKS, PER_CLASS, RIDGE, BATCH, BROADCAST_ROWS = 1 << 14, 192, 400, 1e-2, 64, 500_000


def features(text: str) -> np.ndarray:
    """Places of the n-grams that a text holds, ascending."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    on = np.zeros(DIM, bool)
    gram = np.zeros(len(c), np.uint32)
    for n in range(3):
        gram = gram[: len(c) - n] * np.uint32(0x01000193) + c[n:]
        on[(gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x1B873593)) >> np.uint32(18)] = True
    return np.flatnonzero(on)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(places: list[np.ndarray]) -> np.ndarray:
    """Unit rows."""
    x = np.zeros((len(places), DIM), np.float32)
    for i, p in enumerate(places):
        x[i, p] = 1 / np.sqrt(len(p))
    return x


class KernelRidge:
    """One-versus-rest kernel ridge regression in the Nystroem feature space of its landmarks."""

    def __init__(self, places: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.classes = sorted(set(labels))
        # Landmarks take turns over the classes, so that each has its own.
        turn: dict[str, int] = {}
        order = []
        for i, y in enumerate(labels):
            turn[y] = turn.get(y, 0) + 1
            order.append((turn[y], y, i))
        marks = [i for _, _, i in sorted(order)[: max(landmarks, len(self.classes))]]
        self.landmarks = presence([places[i] for i in marks]).T.copy()
        values, vectors = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = np.concatenate([presence(places[s : s + 512]) @ self.landmarks for s in range(0, len(places), 512)]) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.classes)[None, :], 1.0, -1.0)
        # Classes weigh alike, however many samples each gave.
        weight = 1 / np.array([labels.count(c) for c in labels], float)
        w = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge / len(z) * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def margins(self, places: list[np.ndarray]) -> np.ndarray:
        return presence(places) @ self.landmarks @ self.weights + self.bias

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        margin = self.margins(places)
        e = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _sampled(batches):
    for b in batches:
        rows = [(lang.as_py(), features(t.as_py())) for lang, t in zip(b.column(0), b.column(1), strict=True) if has_letter(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([p.astype(np.uint16).tobytes() for _, p in rows], pa.binary())], names=["lang", "places"])


def fit(train: DataFrame, per_class: int = PER_CLASS) -> KernelRidge | None:
    """From rows (doc_id, lang, text)."""
    ids = Scratch(train.sparkSession, "langid").put(sample_ids(train.filter("lang is not null and doc_id is not null"), per_class, by="lang"), "ids")
    rows = train.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["doc_id", "lang"]).select("lang", "text", "doc_id").mapInArrow(lambda it: _sampled(b.select(["lang", "text"]) for b in it), "lang string, places binary").distinct().collect()
    rows = sorted((r["lang"], bytes(r["places"])) for r in rows)
    if not rows:
        return None
    order = np.random.default_rng(3).permutation(len(rows))
    rows = [rows[i] for i in order]
    return KernelRidge([np.frombuffer(p, np.uint16).astype(np.int64) for _, p in rows], [x for x, _ in rows])


def _predicted(model: KernelRidge | None):
    def run(batches):
        for b in batches:
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for s in range(0, b.num_rows, BATCH):
                texts = [(i, t) for i in range(s, min(s + BATCH, b.num_rows)) if has_letter(t := b.column(1)[i].as_py())]
                if not texts or model is None:
                    continue
                p = model.scores([features(t) for _, t in texts])
                for (i, _), c, v in zip(texts, p.argmax(1), p.max(1), strict=True):
                    lang[i], score[i] = model.classes[c], min(1.0, float(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return tidied(run)


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for each row of docs(doc_id, text, lang); learn_from picks the training rows."""
    model = fit(docs.filter(learn_from).select("doc_id", "lang", "text"))
    return docs.select("doc_id", "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")
