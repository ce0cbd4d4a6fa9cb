"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary classifier over hashed
byte trigrams tells which side a text is on. A text's language is the one whose
codeword has the least summed loss against the bits' margins (loss-weighted
decoding), so single wrong bits are corrected. A text between two codewords is
flagged as ambiguous. Texts are scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows
from .textnp import LOWER, Texts

#: Bound of the sample the classifiers are fitted on, shared evenly by the languages (each has a text at least).
SAMPLE_ROWS = 3_000
BUCKETS = 4096
UNDECIDED = "und"
#: Below this share of the decoded weight a text counts as ambiguous.
CLEAR = 0.6


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """A matrix of +1 and -1 with a row per class: for up to 7 classes every way to split
    them in two, for more of them the random code of several with the greatest distance."""
    if k <= 1:
        return np.zeros((k, 0))
    if k <= 7:
        rest = list(itertools.product([1, -1], repeat=k - 1))
        return np.array([(1, *r) for r in rest if -1 in r]).T.astype(float)
    rng, best, bits = np.random.default_rng(seed), None, int(np.ceil(15 * np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = (code.shape[1] - (code @ code.T + 2 * bits * np.eye(k)).max()) / 2
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


def trigram_features(texts: Texts) -> np.ndarray:
    """Square roots of the frequencies of a text's lower-cased byte trigrams, hashed."""
    n = len(texts)
    counts = np.zeros((n, BUCKETS), np.float32)
    if len(texts.buf) > 2:
        b = LOWER[texts.buf].astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        code = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(20)).astype(np.int64)
        own = texts.owner()
        inside = own[:-2] == own[2:]
        cells = own[:-2][inside].astype(np.int64) * BUCKETS + code[inside]
        counts = np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's language, and its share of the decoded weight."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        weight = np.exp(loss.min(1, keepdims=True) - loss)
        weight /= weight.sum(1, keepdims=True)
        best = weight.argmax(1)
        return best, weight[np.arange(len(best)), best]


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 200, rate: float = 0.3,
             decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """A logistic classifier per bit, all at once, by full-batch Adam. Classes weigh the same."""
    goal = code[y].astype(np.float32)
    share = (1 / np.bincount(y, minlength=len(code))[y] / len(np.unique(y))).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -goal * share / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30)))
        gw, gb = x.T @ g + decay * w, g.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> CodeModel:
    """Learns every non-null language of ``docs`` from a bounded sample of its different texts;
    null and blank texts teach nothing."""
    body = F.col(text).cast("string")
    known = docs.where(F.col(lang).isNotNull() & body.rlike(r"\S")).select(F.col(lang).alias("_lang"), body.alias("_text"))
    known = known.withColumn("_hash", F.xxhash64("_text"))
    different = known.select("_lang", "_hash").distinct()
    sizes = {r["_lang"]: r["count"] for r in different.groupBy("_lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if len(languages) < 2:
        return CodeModel(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(1, sample_rows // len(languages))
    spare = each + 5 * each ** 0.5 + 10  # so many are drawn that ``each`` are left
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("_lang") == name, F.lit(min(1.0, spare / sizes[name]))).otherwise(share)
    drawn = F.pmod("_hash", F.lit(1 << 30)) / float(1 << 30) < share
    index = F.array_position(F.array(*[F.lit(n) for n in languages]), F.col("_lang")) - 1
    rows = known.where(drawn).select(index.cast("long").alias("y"), "_hash", "_text").distinct()
    # The window holds what is drawn of one language, about ``spare`` rows.
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash", "_text"))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= each).select("y", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "_text"):
            x = trigram_features(Texts(batch.column("_text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(work, "y long, x binary").toArrow()
    raw = got.column("x").to_pylist()
    x = np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), BUCKETS).astype(np.float32)
    y = got.column("y").to_numpy()
    order = np.lexsort((x[:, 0], x[:, 1], x.sum(1), y))  # the same rows in the same order in each run
    code = codewords(len(languages))
    w, b = fit_bits(x[order], y[order], code)
    return CodeModel(languages, code, w, b)


def identify(docs: DataFrame, model: CodeModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc``, ``lang_pred``, ``score`` and ``ambiguous`` of each row.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is
    every text if no language was learned. A single learned language is every other
    text's, with score 1.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDECIDED], dtype=object)
        for batch in arrow_rows(batches, "_text"):
            best, share = model.decode(trigram_features(Texts(batch.column("_text"))))
            spoken = batch.column("_letters").to_numpy(zero_copy_only=False)
            best, share = np.where(spoken, best, len(names) - 1), np.where(spoken, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(names[best], pa.string()), pa.array(share, pa.float64()),
                 pa.array(spoken & (share < CLEAR))], names=["_doc", "lang_pred", "score", "ambiguous"])

    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        letters = F.lit(False)
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"),
                       letters.alias("_letters"))
    if not model.languages:
        return rows.select("_doc", F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("ambiguous"))
    return rows.mapInArrow(work, "_doc long, lang_pred string, score double, ambiguous boolean")
