"""Quality classifier by positive-unlabelled learning.

A linear model over shape features of whole texts is fitted to trusted positives and
to unlabelled text alone: it minimises the non-negative unbiased risk

    prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)])

with the logistic loss, so the score estimates the probability of the label. The class
prior is estimated from the same two sets; labelled negatives are used nowhere.
Features are computed where the texts are, the fit sees a bounded sample of different
texts, and every text is scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .textnp import WORD, Texts, mix, padded, span_keys

#: Bounds of the sample the model is fitted on.
POSITIVE_ROWS = 4_000
UNLABELLED_ROWS = 8_000
#: Text bytes and rows whose features are computed at a time: some 60 bytes for each byte,
#: 14 KB for each row.
FEATURE_BYTES, FEATURE_ROWS = 1 << 20, 512

# Byte classes, told apart by their use in running text.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:",
           b"'\"-()", b"!?", b"|<>{}[]=/\\_~`", b"*#%&$@^+"]
CLASSES = 12
CLASS = np.full(256, 10, np.int64)  # control characters
for _k, _group in enumerate(_GROUPS):
    CLASS[list(_group)] = _k
CLASS[128:] = 11
TRIGRAMS = CLASSES ** 3
LINE = np.ones(256, bool)
LINE[[10, 13]] = False
SHAPES = 8
WIDTH = TRIGRAMS + SHAPES


def _distinct(owner: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    both = np.unique((key & ~np.uint64((1 << 20) - 1)) | owner.astype(np.uint64))
    return np.bincount((both & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=n)


def shape_features(texts: Texts) -> np.ndarray:
    """A row of ``WIDTH`` features per text (all zero for an empty one): the frequencies
    of byte-class trigrams, on a log scale, and how much words and lines repeat."""
    n, lengths = len(texts), texts.lengths
    out = np.zeros((n, WIDTH), np.float32)
    size = len(texts.buf)
    if size > 2:
        c = CLASS[texts.buf]
        code = c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:]
        own = texts.owner()
        inside = own[:-2] == own[2:]
        cells = own[:-2][inside].astype(np.int64) * TRIGRAMS + code[inside]
        counts = np.bincount(cells, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.log1p(1e4 * counts / np.maximum(lengths, 1)[:, None]) / 5
    doc, start, end = texts.spans(WORD)
    buf = padded(texts.buf, lower=True)
    key = span_keys(buf, start, end)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    pair = mix(key[:-1] * np.uint64(3) + key[1:])
    joint = doc[:-1] == doc[1:]
    again = joint & (key[:-1] == key[1:])
    ldoc, lstart, lend = texts.spans(LINE)
    lines = np.maximum(np.bincount(ldoc, minlength=n), 1)
    shapes = [
        _distinct(doc, key, n) / words,
        _distinct(doc[:-1][joint], pair[joint], n) / words,
        np.bincount(doc[:-1][again], minlength=n) / words,
        np.log1p(1e3 * np.bincount(doc[:-1][again], minlength=n) / words) / 5,
        np.bincount(doc, weights=end - start, minlength=n) / words / 10,
        _distinct(ldoc, span_keys(buf, lstart, lend), n) / lines,
        np.log1p(words) / 10,
        np.log1p(lengths / lines) / 10,
    ]
    out[:, TRIGRAMS:] = np.stack(shapes, 1)
    out[lengths == 0] = 0
    return out


def feature_rows(rows: DataFrame, keep: str) -> DataFrame:
    """``keep`` (a long) and the feature row, as float16 bytes, of each ``_text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "_text", FEATURE_BYTES, FEATURE_ROWS):
            x = shape_features(Texts(batch.column("_text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), pa.array([r.tobytes() for r in x], pa.binary())], names=[keep, "x"])

    return rows.mapInArrow(work, f"{keep} long, x binary")


def _matrix(rows: DataFrame) -> np.ndarray:
    """The feature rows of ``_text`` in the order of ``_h``, filled in place batch by batch."""
    got = feature_rows(rows, "_h").toArrow()
    place = np.argsort(np.argsort(got.column("_h").to_numpy(), kind="stable"))
    out = np.empty((len(place), WIDTH), np.float32)
    for at, x in zip(place.tolist(), (v for chunk in got.column("x").chunks for v in chunk)):
        out[at] = np.frombuffer(x.as_buffer(), np.float16)
    return out


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def fit_non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000,
                          rate: float = 0.05, decay: float = 1e-5) -> Linear:
    """Full-batch Adam on the non-negative risk. Where the negative part of the risk falls
    below zero, a step is taken that raises that part alone."""
    used = np.flatnonzero((positive != 0).any(0) | (unlabelled != 0).any(0))  # the others get no weight
    whole, positive, unlabelled = np.zeros(positive.shape[1]), positive[:, used], unlabelled[:, used]
    width = len(used)
    w, b = np.zeros(width, np.float32), np.float32(0)
    m, v = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # d loss(z) = sigmoid(z) - 1; d loss(-z) = sigmoid(z)
        gp_neg, gu_neg = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        gp_pos = prior * (sigmoid(zp) - 1) / len(zp)
        if negative >= 0:
            gp, gu = gp_pos + gp_neg, gu_neg
        else:
            gp, gu = -gp_neg, -gu_neg
        g = np.concatenate([positive.T @ gp + unlabelled.T @ gu + decay * w, [gp.sum() + gu.sum()]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    whole[used] = w
    return Linear(whole, float(b), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from the two sets alone.

    Above any threshold the unlabelled rows hold at least prior times the positives'
    share, so the least ratio of the two shares bounds the prior from above, and meets
    it where few others score that high. Each half of the rows is scored by a model
    fitted to the other half; both estimates are averaged, and taken a standard error
    lower: a prior that is too high makes negatives of the unlabelled rows positive.
    """
    found = []
    for k in range(2):
        p, u = positive[1 - k::2], unlabelled[1 - k::2]
        if len(positive) > 1 and len(unlabelled) > 1:
            rough = fit_non_negative_risk(positive[k::2], unlabelled[k::2], 0.5, steps=200)
        else:
            p, u, rough = positive, unlabelled, fit_non_negative_risk(positive, unlabelled, 0.5, steps=200)
        p, u = rough.score(p), rough.score(u)
        for t in np.quantile(p, np.linspace(0.02, 0.5, 13)):
            over, under = (u >= t).mean(), (p >= t).mean()
            error = np.sqrt(over * (1 - over) / len(u) + (over / under) ** 2 * under * (1 - under) / len(p)) / under
            found.append((k, over / under - error))
    return float(np.clip(np.mean([min(r for j, r in found if j == k) for k in range(2)]), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Linear:
    """Fits the model. ``docs`` and ``labels`` are what may be learned from.

    Trusted positives are the texts of documents whose labels all say 1. Unlabelled text
    is a sample of ``docs`` whatever their labels. Equal texts count once in each set (null
    as empty), and the sets hold at most ``positive_rows`` and ``unlabelled_rows`` texts,
    those that come first by a hash, however often rows, ids or texts repeat. Without
    positives or without text the model scores every text alike.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_doc")).agg(F.min(label).cast("int").alias("label"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_doc"), body.alias("_text"))

    def first(seed: int, bound: int, ids: DataFrame | None = None) -> DataFrame:
        hashed = F.xxhash64("_text", F.lit(seed)).alias("_h")
        keys = rows.select("_doc", hashed)  # hashes are shuffled, not texts
        if ids is not None:
            keys = keys.join(ids, "_doc", "left_semi")
        # At most the sample's bound of hashes: small enough to send to every executor.
        lead = keys.select("_h").distinct().orderBy("_h").limit(bound)
        return rows.select(hashed, "_text").join(F.broadcast(lead), "_h", "left_semi").dropDuplicates(["_h"])

    positive = _matrix(first(1, positive_rows, marks.where("label = 1")))
    unlabelled = _matrix(first(2, unlabelled_rows))
    if not len(positive) or not len(unlabelled):
        return Linear(np.zeros(WIDTH), 0.0, 0.5)
    return fit_non_negative_risk(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Linear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc`` and ``score`` (0 to 1) of each row; null and empty texts get the score of no features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "_text", FEATURE_BYTES, FEATURE_ROWS):
            s = model.score(shape_features(Texts(batch.column("_text"))))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(s, pa.float64())], names=["_doc", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(work, "_doc long, score double")


def keep_good(docs: DataFrame, model: Linear, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, text, FEATURE_BYTES, FEATURE_ROWS):
            s = model.score(shape_features(Texts(batch.column(text))))
            yield batch.filter(pa.array(s >= threshold))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(work, docs.schema)
