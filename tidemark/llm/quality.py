"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives (rows that the labels call
good) and unlabelled web text by the non-negative unbiased risk of Kiryo et
al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator": with
class prior p, positive risk p * R_p(+) and negative risk R_u(-) - p * R_p(-),
where a step that would push the negative risk below zero is undone instead.

The prior is estimated from the data: a first, biased network separates
trusted positives from unlabelled text. It is fitted briefly, on halves of the
rows, so that each row is scored by networks that have not seen it; the
averages of SPLITS such scores serve. The prior is the least share, over
thresholds, of unlabelled rows above one to positives above it (Elkan-Noto
estimates).

Logistic losses make the network's output the log-odds of the posterior, so its
sigmoid is the score as it is: no negative label is used anywhere. ENSEMBLE
networks from different starts are averaged.

Features are shares and ratios of whole texts (``features``), standardised on
the unlabelled sample. The fit reads bounded samples, POSITIVES and UNLABELLED
rows with the least hashes of doc_id; features, not texts, come to the driver.
A doc_id that the labels call good and bad counts as good; its rows, if several,
are all read.

Null and empty texts have the features of the empty text and a score like any
other. Rows without doc_id are scored and teach nothing. Without any trusted
positive every score is 0.5. Repeated rows keep a row each; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_ids, tidied
from .logistic import sigmoid

POSITIVES, UNLABELLED, HIDDEN, STEPS, RATE, ENSEMBLE, SPLITS = 3000, 6000, 24, 600, 0.01, 3, 5

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _BAR, _HIGH = range(9)
_KIND = np.full(256, _SYMBOL, np.int64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _KIND[_b] = _HIGH
    elif _c.isupper():
        _KIND[_b] = _UPPER
    elif _c.islower():
        _KIND[_b] = _LOWER
    elif _c.isdigit():
        _KIND[_b] = _DIGIT
    elif _c == "\n":
        _KIND[_b] = _LINE
    elif _c.isspace():
        _KIND[_b] = _SPACE
    elif _c in ".,;:'\"-?()":
        _KIND[_b] = _STOP
    elif _c in "|<>{}[]":
        _KIND[_b] = _BAR
N_FEATURES = 9 + 9


def features(text: bytes | None) -> np.ndarray:
    """What a whole text looks like: kinds of characters, lengths, repetition."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    n = max(len(raw), 1)
    kinds = np.bincount(_KIND[raw], minlength=9)
    words = text.split()
    w = max(len(words), 1)
    low = [x.lower() for x in words]
    # Word pairs, like word counts, are read to the end: a loop anywhere shows.
    pairs = len(set(zip(low, low[1:]))) / max(len(low) - 1, 1) if len(low) > 1 else 1.0
    same = sum(map(bytes.__eq__, low, low[1:])) / w
    return np.array(
        [
            *(kinds / n),
            np.log1p(len(raw)),
            np.log1p(len(words)),
            (kinds[_UPPER] + kinds[_LOWER] + kinds[_HIGH]) / w,
            len(set(low)) / w,
            pairs,
            same,
            (kinds[_SYMBOL] + kinds[_BAR]) / w,
            kinds[_LINE] / w,
            min(1.0, (len(zlib.compress(text, 1)) - 8) / n),
        ]
    )


def _featured(batches):
    for b in batches:
        x = [features(t.as_py()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["positive", "x"])


class Network:
    """One hidden layer; trained in full batches with Adam."""

    def __init__(self, d: int, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.p = [w.astype(np.float32) for w in (r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, decay: float = 1e-4) -> None:
        """One update along dLoss/doutput = g."""
        g = g.astype(np.float32)
        gh = np.outer(g, self.p[2]) * (1 - h * h)
        grads = [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]
        self.t += 1
        for i, (w, dw) in enumerate(zip(self.p, grads, strict=True)):
            dw = dw + decay * w
            self.m[i] = 0.9 * self.m[i] + 0.1 * dw
            self.v[i] = 0.999 * self.v[i] + 0.001 * dw * dw
            w -= RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unl, from scores of a network that tells pos from unl.

    Thresholds are those that most positives pass: of a few rows the least
    share would be chance. For the same reason half a standard deviation is added.
    """
    best = 1.0
    for t in np.quantile(pos, np.linspace(0.02, 0.25, 25)):
        up, uu = (pos >= t).mean(), (unl >= t).mean()
        share = uu / up
        best = min(best, share + 0.5 * np.sqrt(uu * (1 - uu) / len(unl) + share**2 * up * (1 - up) / len(pos)) / up)
    return float(np.clip(best, 0.05, 0.98))


def crossed_scores(xp: np.ndarray, xu: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of positives and unlabelled rows, from networks that were fitted on the other half of both; averages over halvings."""
    x, n, m = np.vstack([xp, xu]), len(xp), len(xu)
    y, z = np.arange(n + m) < n, np.zeros(n + m)
    g = np.where(y, 1 / n, 1 / m) * 2
    for seed in range(SPLITS):
        r = np.random.default_rng(seed)
        half = np.concatenate([r.permutation(n) % 2, r.permutation(m) % 2]) == 0
        for part in (half, ~half):
            net = Network(x.shape[1])
            for _ in range(steps):
                h, out = net.forward(x[part])
                net.step(x[part], h, g[part] * (sigmoid(out) - y[part]), 1e-3)
            z[~part] += net.forward(x[~part])[1]
    return z[:n], z[n:]


def nn_risk(z: np.ndarray, n: int, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the unbiased risk of outputs z, the first n of positives, under logistic losses."""
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
    return prior * plus[:n].mean(), minus[n:].mean() - prior * minus[:n].mean()


def nn_gradient(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """The step's direction in outputs: down the risk, or, where its negative part is below zero, up that part."""
    s, m = sigmoid(z), len(z) - n
    if nn_risk(z, n, prior)[1] >= 0:
        return np.concatenate([prior * ((s[:n] - 1) - s[:n]) / n, s[n:] / m])
    return np.concatenate([prior * s[:n] / n, -s[n:] / m])


class PuClassifier:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> None:
        self.mean, self.scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-6)
        xp, xu = self._z(positive), self._z(unlabelled)
        self.prior = estimate_prior(*crossed_scores(xp, xu, STEPS // 4)) if prior is None else prior
        x, n = np.vstack([xp, xu]), len(xp)
        self.nets = [Network(x.shape[1], seed) for seed in range(1, ENSEMBLE + 1)]
        for net in self.nets:
            for _ in range(STEPS):
                h, z = net.forward(x)
                net.step(x, h, nn_gradient(z, n, self.prior))

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = self._z(x)
        return sigmoid(sum(net.forward(x)[1].astype(np.float64) for net in self.nets) / len(self.nets))


def _read(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of the documents in ids(doc_id, positive), in an order of their own."""
    # ids is a bounded sample, so that the texts need no shuffle.
    rows = docs.join(F.broadcast(ids), "doc_id").select("positive", F.col("text").cast("binary").alias("text")).mapInArrow(_featured, "positive int, x binary").collect()
    x = sorted((r["positive"], bytes(r["x"])) for r in rows)
    order = np.random.default_rng(5).permutation(len(x))
    return np.array([np.frombuffer(x[i][1], np.float64) for i in order]).reshape(-1, N_FEATURES), np.array([x[i][0] for i in order], int)


def fit(docs: DataFrame, trusted: DataFrame, prior: float | None = None) -> PuClassifier | None:
    """From docs(doc_id, text) and the ids of trusted(doc_id): all other rows of docs are unlabelled."""
    good = trusted.filter("doc_id is not null").select("doc_id", F.lit(1).alias("positive")).distinct()
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().join(good, "doc_id", "left").select("doc_id", F.coalesce("positive", F.lit(0)).alias("positive"))
    x, y = _read(docs, sample_ids(ids, max(POSITIVES, UNLABELLED), by="positive"))
    pos, unl = x[y == 1], x[y == 0]
    if len(pos) < 2 or len(unl) < 2:
        return None
    return PuClassifier(pos[:POSITIVES], unl[:UNLABELLED], prior)


def _scored(model: PuClassifier | None):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([features(t.as_py()) for t in b.column(1)])
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return tidied(run)


def score(docs: DataFrame, trusted: DataFrame, prior: float | None = None) -> DataFrame:
    """Rows (doc_id, score) for each row of docs(doc_id, text): the probability that a text is like the trusted ones."""
    model = fit(docs.select("doc_id", "text"), trusted, prior)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


def _kept(model: PuClassifier | None, names: list[str], least: float):
    at = names.index("text")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([features(None if t.as_py() is None else t.as_py().encode()) for t in b.column(at)])
            good = model.scores(x) >= least if model else np.ones(len(x), bool)
            yield b.filter(pa.array(good))

    return tidied(run)


def kept(docs: DataFrame, model: PuClassifier | None, least: float) -> DataFrame:
    """The rows of docs whose texts score at least that much, without a join; without a model, all."""
    return docs.mapInArrow(_kept(model, docs.columns, least), docs.schema)
