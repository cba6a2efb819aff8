"""Quality classifier: naive Bayes support vectors (Wang and Manning, ACL 2012).

Features are indicators of hashed n-grams: 1 to 4 bytes (A-Z lowered; a second bit keeps their case) and 1 to 3
words by shape, where a word that repeats the one before it has a shape of its own. Each indicator is scaled by
its class log-count ratio, rows are scaled to length 1, and a linear squared-hinge model is fitted by dual
coordinate descent (Hsieh et al., ICML 2008). A logistic curve, fitted on rows the model didn't see, turns
margins into probabilities.

The model is fitted on a bounded sample of labelled rows: `per_class` rows of each class, those with the
smallest hashes of doc_id. Scoring covers all rows and whole texts; the model is two arrays of 2^`bits` entries,
whatever the corpus.

Results on unusual input: null and empty texts have no n-grams and get the score of an empty text. Labels that
are null, or of documents that don't exist, are ignored; a document labelled twice counts with its larger
label. Without rows of both classes every score is the share of label 1 (0.5 without labels). Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textscan
from quarry.llm.common import give_back, let_go, prepare

BITS = 17
_SHAPE = np.zeros(256, np.uint64)
for _c in range(256):
    _SHAPE[_c] = 1 if 97 <= _c < 123 or _c >= 128 else 2 if 65 <= _c < 91 else 4 if 48 <= _c < 58 else 8 if _c in b".,;:'\"?-" else 16


def _spread(codes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return ((codes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def features(ids: pa.Array, texts: pa.Array, bits: int = BITS):
    """(id, sorted distinct feature numbers) of each row."""
    present = np.zeros(1 << bits, np.bool_)
    for some, data, offsets in textscan.slices(ids, texts):
        h, start, end, first = textscan.words(data, offsets)
        low = textscan.LOWER[data]
        codes = low.astype(np.uint64)
        grams = [_spread(data.astype(np.uint64), 1 << 60, bits)]
        for n in range(2, 5):
            codes = codes[:-1] | (low[n - 1 :].astype(np.uint64) << np.uint64(8 * n - 8)) if len(codes) else codes
            grams.append(_spread(codes, n << 56, bits))
        shapes = np.bitwise_or.reduceat(_SHAPE[data], start) if len(start) else np.zeros(0, np.uint64)
        if len(start):  # reduceat runs up to the next word's start; what lies between are separators
            shapes &= ~np.uint64(16)
            marks = np.add.reduceat((_SHAPE[data] == 16) & ~textscan.SPACE[data], start)
            shapes |= (np.minimum(marks, 3).astype(np.uint64) + np.uint64(0)) << np.uint64(4)
            same = np.zeros(len(h), np.bool_)
            same[1:] = h[1:] == h[:-1]
            shapes |= same.astype(np.uint64) << np.uint64(6)
        shaped = [_spread(shapes, 11 << 56, bits)]
        chain = shapes
        for n in range(2, 4):
            chain = chain[:-1] | (shapes[n - 1 :] << np.uint64(8 * n - 8)) if len(chain) else chain
            shaped.append(_spread(chain, (10 + n) << 56, bits))
        for i, key in enumerate(some.to_pylist()):
            a, b, c, d = offsets[i], offsets[i + 1], first[i], first[i + 1]
            for n, g in enumerate(grams):
                present[g[a : max(a, b - n)]] = True
            for n, g in enumerate(shaped):
                present[g[c : max(c, d - n)]] = True
            yield key, np.flatnonzero(present)
            present[:] = False


class Model:
    """weights: of the scaled indicators, one per feature; a, b: of the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / max(1.0, len(found)) ** 0.5 + self.bias)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, epochs: int = 30) -> Model:
    """A model from feature rows and 0/1 labels. Every fourth row is kept for the logistic curve."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(labels), np.bool_)
    for c in (0, 1):
        own = np.flatnonzero(labels == c)
        held[own[3::4]] = True
    train = np.flatnonzero(~held)
    counts = np.ones((2, 1 << bits))
    for i in train:
        counts[labels[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    at = np.append(0, np.cumsum([len(rows[i]) for i in train]))
    flat = np.empty(at[-1])  # one block, which is given back when the fit is over
    x = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    for v, i in zip(x, train, strict=True):
        v[:] = ratio[rows[i]] / max(1.0, len(rows[i])) ** 0.5
    sign = 2.0 * labels[train] - 1
    lift = [1 / (2 * cost * len(train) / (2 * (sign == s).sum())) for s in (-1, 1)]  # squared hinge; classes weigh alike
    diagonal = np.where(sign > 0, lift[1], lift[0])
    square = np.array([v @ v + 1 for v in x]) + diagonal
    w, bias, alpha = np.zeros(1 << bits), 0.0, np.zeros(len(train))
    order, rng = np.arange(len(train)), np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            at = rows[train[i]]
            slope = sign[i] * (w[at] @ x[i] + bias) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - slope / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(step))
                w[at] += step * x[i]
                bias += step
                alpha[i] = new
        if moved < 1e-4:
            break
    model = Model(w * ratio, bias, 1.0, 0.0)
    some = np.flatnonzero(held) if all((labels[held] == c).any() for c in (0, 1)) else np.arange(len(labels))
    model.a, model.b = _curve(np.array([model.margin(rows[i]) for i in some]), labels[some])
    return model


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve by Newton steps, with his smoothed targets; classes weigh alike."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    theta, z = np.zeros(2), np.stack([margin, np.ones_like(margin)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ z, -50, 50)))
        step = np.linalg.solve((z * (weight * p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (weight * (target - p)) - 1e-6 * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _collect(bits: int):
    def run(batches):
        let_go()
        for batch in batches:
            found = list(features(batch.column(0), batch.column(1), bits))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in found], pa.int64()), "found": pa.array([f.astype("<u4").tobytes() for _, f in found], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, bits: int = BITS) -> Model:
    """Fit on at most per_class rows of each class. labels: (doc_id, label 0 or 1)."""
    prepare(docs.sparkSession)
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    chosen = []
    for c in (0, 1):  # each a top-k, so that the driver gets 2 * per_class ids
        chosen += [(r.doc_id, c) for r in known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    sample = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([k for k, _ in chosen], pa.int64())}))  # by Arrow: rows of Python would start workers of another kind
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left_semi")
    got = texts.mapInArrow(_collect(bits), "doc_id long, found binary").toArrow().sort_by([("doc_id", "ascending"), ("found", "ascending")])
    label = dict(chosen)
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in got["found"]]
    model = fit(rows, np.array([label[k] for k in got["doc_id"].to_pylist()]), bits)
    del rows, got
    give_back()
    return model


def _apply(model: Model, bits: int):
    def run(batches):
        let_go()
        for batch in batches:
            scores = [model.score(model.margin(f)) for _, f in features(batch.column(0), batch.column(1), bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def _slim(model: Model, bits: int):
    """As _apply, but without the text."""

    def run(batches):
        for batch in batches:
            scores = [model.score(model.margin(f)) for _, f in features(batch.column(0), batch.column(1), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_slim(model, bits), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, bits: int = BITS) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns."""
    prepare(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes
    plain = docs.toDF(*names)
    text = f"c{[c.lower() for c in docs.columns].index('text')}"
    rows = plain.select(F.lit(0).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"), *names)
    kept = rows.mapInArrow(_apply(model, bits), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).where(F.col("score") >= threshold)
    return kept.select(*names).toDF(*docs.columns)
