"""Toxicity scoring behind a noisy-channel deobfuscator.

Words that may be disguised (digits and signs for letters, letters spelled out one by
one, repeated letters) become lattices of letters; Viterbi search under a character
language model finds the likeliest reading, and the restored words are scored along
with the plain ones. Every other word has a lattice with a single path, so nothing is
to be decoded there.

* The language model holds letter trigram counts over all documents, added up by Spark
  (at most 64 ** 3 counters, however large the corpus): a-z and the most frequent
  other letters have symbols of their own, the rest share one.
* The lexicon holds words and word beginnings that toxic training texts have far more
  often than others; its weights are log odds.
* A logistic model on a text's lexicon matches gives the score; it is fitted on
  labelled texts that the lexicon used has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize_table
from .near_dedup import shingles
from .textnp import WORD, Texts, mix, padded, span_keys

#: Bound of the toxic texts that the model is fitted on; of the others, twice as many.
SAMPLE_ROWS = 4_000
#: What a text's score rests on, see ``ToxicModel.evidence``.
EVIDENCE = 6
#: Bound of the lexicon.
LEXICON = 4_096
#: Least log-likelihood ratio and log odds of an entry.
LEAST_RATIO, LEAST_ODDS = 12.0, 1.5
#: Beginnings of words that are features beside the words, in bytes.
PREFIXES = (4, 5, 6)

# -- the channel -------------------------------------------------------------

# Signs and the letters that they may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Signs that end a word rather than belong to it.
PUNCTUATION = b"!|+"
SEPARATORS = " ._-*"
#: Characters by class. Letters are those of any script.
LETTER, SIGN, GAP, END = 1, 2, 4, 8
#: Letters spelled out: at least so many in a row, or so many letters and signs.
SPELLED_LETTERS, SPELLED = 3, 4
#: Signs that stand for letters also where only three are spelled out (digits may be numbers).
LETTER_LIKE = "@$"
#: Costs, in nats, of reading a sign as a letter, and of dropping a repeated letter or a gap.
SIGN_COST, DROP_COST, KEEP_GAP_COST = 0.5, 0.1, 1.0

ALPHABET = 28  # 0: no letter, 1-26: a-z, 27: a byte of another letter, or another letter without a symbol
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 27
#: Bound of the letters that have symbols besides.
MORE_LETTERS = 36
CODES = 0x110000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.array([chr(c).isalpha() for c in range(CODES)]).astype(np.uint8) * LETTER
    for chars, kind in (("".join(LEET), SIGN), (SEPARATORS, GAP), (PUNCTUATION.decode(), END)):
        for c in chars:
            out[ord(c)] |= kind
    return out


def chars(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each character's first byte, code point (ASCII letters in lower case) and text."""
    b = padded(texts.buf, lower=True)
    n = len(texts.buf)
    if not (texts.buf > 127).any():
        return np.arange(n), b[:n].astype(np.int32), texts.owner()
    at = np.flatnonzero((b[:n] & 0xC0) != 0x80)
    code = b[at].astype(np.int32)
    for least, upto, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        wide = np.flatnonzero((code >= least) & (code < upto) & (b[at] >= least))
        value = code[wide] & bits
        for k in range(1, more + 1):
            value = value << 6 | b[at[wide] + k] & 0x3F
        code[wide] = np.minimum(value, CODES - 1)
    return at, code, texts.owner()[at]


def more_letters(docs: DataFrame, text: str = "text") -> str:
    """The most frequent letters of all texts besides a-z, in lower case."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for batch in arrow_rows(batches, "_text"):
            _, code, _ = chars(Texts(batch.column("_text")))
            code, n = np.unique(code[code > 127], return_counts=True)
            total[code] += n
        some = np.flatnonzero(total)
        some = some[char_classes()[some] == LETTER]
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in some], pa.string()), pa.array(total[some])], names=["letter", "n"])

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(work, "letter string, n long")
    most = rows.groupBy(F.lower("letter").alias("letter")).agg(F.sum("n").alias("n")).where(
        F.char_length("letter") == 1).orderBy(F.desc("n"), "letter").limit(MORE_LETTERS).collect()
    return "".join(sorted(r["letter"] for r in most))


def symbols(more: str) -> np.ndarray:
    """The symbol of each code point."""
    out = np.where(char_classes() == LETTER, 27, 0).astype(np.int64)
    out[:128] = SYMBOL[:128]
    for k, c in enumerate(more):
        for same in (c, c.upper()):
            if len(same) == 1:
                out[ord(same)] = ALPHABET + k
    return out


@dataclass(frozen=True)
class Letters:
    """The letter model, and the letters besides a-z that have symbols in it."""

    table: np.ndarray
    more: str = ""

    @cached_property
    def costs(self) -> list:
        return self.table.tolist()

    @cached_property
    def codes(self) -> dict[str, int]:
        known = {c: ALPHABET + k for k, c in enumerate(self.more)}
        return known | {chr(96 + k): k for k in range(1, 27)} | {" ": 0}


def letter_counts(docs: DataFrame, text: str = "text", more: str | None = None) -> DataFrame:
    """``code``, ``n``: how often each letter trigram occurs in all texts. Without ``more`` the
    bytes of letters outside ASCII are counted, with it the letters."""
    size = ALPHABET + len(more or "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size ** 3, np.int64)
        table = None if more is None else symbols(more)
        for batch in arrow_rows(batches, "_text"):
            texts = Texts(batch.column("_text"))
            if more is None:
                found, own = SYMBOL[texts.buf], texts.owner()
            else:
                _, code, own = chars(texts)
                found = table[code]
            s = np.zeros(len(found) + len(texts) + 2, np.int64)  # a boundary between texts
            s[np.arange(len(found)) + own + 1] = found
            counts += np.bincount(s[:-2] * size ** 2 + s[1:-1] * size + s[2:], minlength=size ** 3)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["code", "n"])

    rows = docs.select(F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame, size: int = ALPHABET) -> np.ndarray:
    """log P(third letter | first two), interpolated with lower orders."""
    c = np.zeros(size ** 3)
    for r in counts.collect():  # at most size ** 3 rows
        c[r["code"]] = r["n"]
    c = c.reshape(size, size, size)
    one = (c.sum((0, 1)) + 1) / (c.sum() + size)
    two = (c.sum(0) + 20 * one) / (c.sum(0).sum(1, keepdims=True) + 20)
    three = (c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)
    return np.log(three)


def _slots(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of a disguised run: for each place the readings and their costs."""
    slots: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(run):
        c = run[k]
        same = 1
        while k + same < len(run) and (run[k + same] == c or c in SEPARATORS and run[k + same] in SEPARATORS):
            same += 1  # a gap may be several characters
        k += same
        if c in SEPARATORS:
            slots.append([("", DROP_COST), (" ", KEEP_GAP_COST)])
            continue
        readings = [(a, SIGN_COST) for a in LEET[c]] if c in LEET else [(c, 0.0)]
        options = [(a, cost + DROP_COST * (same - 1)) for a, cost in readings]
        if same > 1:
            options += [(a * 2, cost * 2 + DROP_COST * (same - 2)) for a, cost in readings]
        slots.append(options)
    return slots


def decode(run: str, model: np.ndarray | Letters) -> str:
    """The likeliest reading of a disguised run (Viterbi over the last two letters), however long it is."""
    letters = model if isinstance(model, Letters) else Letters(model)
    costs, codes = letters.costs, letters.codes
    # A path is a chain (path before, reading), so paths share what they have in common.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*_slots(run), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for reading, cost in options:
                x, y, s = a, b, score - cost
                for letter in reading:
                    z = codes.get(letter, 27)
                    s += costs[x][y][z]
                    x, y = y, z
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, reading))
        states = after
    path, said = max(states.values(), key=lambda found: found[0])[1], []
    while path:
        path, reading = path
        said.append(reading)
    return "".join(reversed(said)).strip()


def disguised(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that may hide a word: text, start, end (byte positions).

    Tokens of both letters and signs (``PUNCTUATION`` counts before a letter only) or
    with a letter twice in a row; and at least ``SPELLED_LETTERS`` single letters, or
    ``SPELLED`` single letters and signs, with gaps of one or more characters between.
    """
    at, code, own = chars(texts)
    n = len(at)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    kind = char_classes()[code]
    letter, sign, gap = kind & LETTER > 0, kind & SIGN > 0, kind & GAP > 0
    either = letter | sign
    edge = np.append(own[1:] != own[:-1], True)  # the last character of a text
    first, last = either.copy(), either.copy()
    first[1:] &= ~either[:-1] | edge[:-1]
    last[:-1] &= ~either[1:] | edge[:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return none, none, none
    after = np.append(at[1:], len(texts.buf))  # each character's end

    def any_of(marked: np.ndarray) -> np.ndarray:
        # reduceat sums up to the next run's start; what lies between two runs is never marked
        return np.add.reduceat(marked.astype(np.int64), start) > 0

    hides = sign & (kind & END == 0)
    hides[:-1] |= sign[:-1] & letter[1:] & ~edge[:-1]
    double = np.zeros(n, bool)
    double[:-1] = letter[:-1] & (code[:-1] == code[1:]) & ~edge[:-1]
    hit = any_of(letter) & any_of(hides) | any_of(double)
    token = own[start[hit]], at[start[hit]], after[end[hit] - 1]
    # single letters: runs of length 1, each followed by gaps only up to the next
    single = end - start == 1
    other = np.concatenate([[0], np.cumsum(~gap)])
    link = np.zeros(len(start), bool)
    link[:-1] = (single[:-1] & single[1:] & (own[start[:-1]] == own[start[1:]])
                 & (other[start[1:]] == other[end[:-1]]))
    lo = np.flatnonzero(link & ~np.concatenate([[False], link[:-1]]))
    hi = np.flatnonzero(np.concatenate([[False], link[:-1]]) & ~link)
    like = np.concatenate([[0], np.cumsum((letter | np.isin(code, [ord(c) for c in LETTER_LIKE]))[start])])
    plain = np.concatenate([[0], np.cumsum(letter[start])])
    long = (plain[hi + 1] > plain[lo]) & (
        (hi - lo + 1 >= SPELLED) | (like[hi + 1] - like[lo] >= SPELLED_LETTERS))
    lo, hi = lo[long], hi[long]
    return (np.concatenate([token[0], own[start[lo]]]).astype(np.int64), np.concatenate([token[1], at[start[lo]]]),
            np.concatenate([token[2], after[end[hi] - 1]]))


class Restorer:
    """Decodes disguised runs; remembers those it has seen."""

    ENTRIES = 200_000

    def __init__(self, model: np.ndarray | Letters):
        self.model, self.seen = model if isinstance(model, Letters) else Letters(model), {}

    def read(self, run: bytes) -> str:
        if run not in self.seen:
            self.seen[run] = decode(run.decode(errors="replace").lower(), self.model)
        return self.seen[run]

    def __call__(self, texts: Texts) -> tuple[np.ndarray, list[str]]:
        """Restored strings and the text that each belongs to."""
        doc, start, end = disguised(texts)
        raw = texts.buf.tobytes().lower()
        if len(self.seen) > self.ENTRIES:
            self.seen = {}
        return doc, [self.read(raw[a:b].strip(PUNCTUATION)) for a, b in zip(start.tolist(), end.tolist())]

    def restore(self, text: str) -> str:
        """A text in lower case with its disguised runs put back."""
        raw = text.encode()
        texts = Texts(pa.array([text]))
        _, start, end = disguised(texts)
        out, at = b"", 0
        for a, b in sorted(zip(start.tolist(), end.tolist()), key=lambda s: (s[0], -s[1])):
            while a < b and raw[a] in PUNCTUATION:
                a += 1
            while a < b and raw[b - 1] in PUNCTUATION:
                b -= 1
            if a >= at:
                out += raw[at:a] + self.read(raw[a:b].lower()).encode()
                at = b
        return (out + raw[at:]).decode().lower()


# -- lexicon features --------------------------------------------------------


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Owner and key of each word and each of its beginnings (lower case)."""
    doc, start, end = texts.spans(WORD)
    buf = padded(texts.buf, lower=True)
    owners, keys = [doc], [span_keys(buf, start, end)]
    for n in PREFIXES:
        some = end - start > n
        owners.append(doc[some])
        keys.append(mix(span_keys(buf, start[some], start[some] + n) ^ np.uint64(n)))
    return np.concatenate(owners), np.concatenate(keys)


def features(texts: Texts, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    owner, key = word_features(texts)
    doc, said = restorer(texts)
    if not len(said):
        return owner, key
    more_owner, more_key = word_features(Texts(pa.array(said, pa.string())))
    return np.concatenate([owner, doc[more_owner]]), np.concatenate([key, more_key])


@dataclass(frozen=True)
class ToxicModel:
    letters: Letters
    keys: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0] + [0.0] * (EVIDENCE - 1)))

    def evidence(self, texts: Texts, restorer: Restorer) -> np.ndarray:
        """Per text: 1, the largest weight, the log of the summed weights, the log of the number
        of different lexicon entries, the log of the number of words (chance entries come with
        length), and the weights of the words that carry any, per root of the number of words."""
        n = len(texts)
        out = np.zeros((n, EVIDENCE))
        out[:, 0] = 1
        if not len(self.keys):
            return out
        owner, key = features(texts, restorer)
        words = np.bincount(texts.spans(WORD)[0], minlength=n)
        filled = np.zeros(1 << 16, bool)  # most words are told apart from the lexicon here
        filled[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        maybe = filled[(key >> np.uint64(48)).astype(np.int64)]
        owner, key = owner[maybe], key[maybe]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        every = np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=n)
        pairs = np.unique(owner[hit].astype(np.int64) * len(self.keys) + at[hit])
        owner, weight = pairs // len(self.keys), self.weights[pairs % len(self.keys)]
        np.maximum.at(out[:, 1], owner, weight)
        out[:, 2] = np.log1p(np.bincount(owner, weights=weight, minlength=n))
        out[:, 3] = np.log1p(np.bincount(owner, minlength=n))
        out[:, 4] = np.log1p(words)
        out[:, 5] = every / np.sqrt(np.maximum(words, 1))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.coefficients, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, decay: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = decay * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` (label, _text) with most near copies merged: of texts that share one of three
    min-hashes of their shingles one stays, or a text with many copies would fill the lexicon."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "_text"):
            owner, key, _ = shingles(Texts(batch.column("_text")))
            least = np.full((3, batch.num_rows), np.iinfo(np.uint64).max, np.uint64)
            for k in range(3):
                np.minimum.at(least[k], owner, mix(key ^ np.uint64(0x9E37 + k)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "half", "_text")), *(pa.array(h.view(np.int64)) for h in least)],
                names=["label", "half", "_text", "h0", "h1", "h2"])

    schema = "label long, half long, _text string, h0 long, h1 long, h2 long"
    out = rows.select("label", "half", "_text").mapInArrow(hashes, schema)
    for h in ("h0", "h1", "h2"):
        whole = F.struct(*out.columns)
        out = out.groupBy("label", h).agg(F.max(whole).alias("row")).select("row.*")
    return out.select("label", "half", "_text")


def learn_lexicon(rows: DataFrame, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the features that toxic texts of ``rows`` (label, _text) have far
    more often than others: log odds, of those whose log-likelihood ratio leaves little to chance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in arrow_rows(batches, "_text"):
            texts = Texts(batch.column("_text"))
            y = batch.column("label").to_numpy()
            owner, key = features(texts, restorer)
            key, inverse = np.unique(key, return_inverse=True)
            pair = np.unique(inverse.astype(np.int64) * len(texts) + owner)
            feature, bad = pair // len(texts), y[pair % len(texts)] == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.bincount(feature[bad], minlength=len(key))),
                 pa.array(np.bincount(feature[~bad], minlength=len(key)))], names=["feature", "bad", "good"])

    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_good:
        return np.zeros(0, np.uint64), np.zeros(0)
    counted = rows.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = n_bad / (n_bad + n_good)
    seen, bad, good = F.col("bad") + F.col("good"), F.col("bad"), F.col("good")
    ratio = 2 * (bad * F.log(bad / (seen * share))
                 + F.when(good > 0, good * F.log(good / (seen * (1 - share)))).otherwise(0.0))
    odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
    chosen = counted.where("bad >= 2").withColumn("ratio", ratio).withColumn("weight", odds).where(
        (F.col("ratio") >= LEAST_RATIO) & (F.col("weight") >= LEAST_ODDS)
    ).orderBy(F.desc("ratio"), "feature").limit(LEXICON).select("feature", "weight").toPandas()
    keys = chosen["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], chosen["weight"].to_numpy(float)[order]


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Learns from ``docs`` and ``labels``; ``corpus`` only gives the letter counts.

    The logistic model sees each text through a lexicon learned from the other half of
    the texts; the lexicon that is kept is learned from all of them. Of copies and most
    near copies one is used. Without both labels no lexicon is learned, and every
    text scores low.
    """
    more = more_letters(corpus, text)
    letters = Letters(language_model(letter_counts(corpus, text, more), ALPHABET + len(more)), more)
    empty = ToxicModel(letters, np.zeros(0, np.uint64), np.zeros(0))
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return empty
    drawn = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    bound = {1: sample_rows, 0: 2 * sample_rows}
    share = F.when(F.col("label") == 1, F.lit(bound[1] / sizes[1])).otherwise(F.lit(bound[0] / sizes[0]))
    chosen = marks.where(drawn < share)  # bounded by sample_rows
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    half = F.pmod(F.xxhash64("_text"), F.lit(2)).cast("long")
    rows = materialize_table(one_of_each(
        rows.select(F.col("label").cast("long").alias("label"), half.alias("half"), "_text")))
    found, columns = [], [f"e{c}" for c in range(1, EVIDENCE)]
    for k in (0, 1):
        model = ToxicModel(letters, *learn_lexicon(rows.where(F.col("half") != k), letters))

        def weigh(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(letters)
            for batch in arrow_rows(batches, "_text"):
                e = model.evidence(Texts(batch.column("_text")), restorer)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), *(pa.array(e[:, c]) for c in range(1, EVIDENCE))], names=["label", *columns])

        found.append(rows.where(F.col("half") == k).mapInArrow(
            weigh, ", ".join(["label long", *(f"{c} double" for c in columns)])).toPandas())
    y = np.concatenate([f["label"].to_numpy(float) for f in found])
    x = np.concatenate([np.column_stack([np.ones(len(f)), f[columns].to_numpy()]) for f in found])
    if len(np.unique(y)) < 2:
        return empty
    weight = np.where(y == 1, max(1.0, sizes[1] / bound[1]), max(1.0, sizes[0] / bound[0]))
    order = np.lexsort((*x.T, y))  # the same sums in each run
    return ToxicModel(letters, *learn_lexicon(rows, letters), _logistic(x[order], y[order], weight[order]))


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc``, ``score`` (0 to 1) and ``restored`` (how many runs were read as disguised words) of each row.

    Null and empty texts score as texts without any lexicon entry.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in arrow_rows(batches, "_text"):
            texts = Texts(batch.column("_text"))
            s = model.score(model.evidence(texts, restorer))
            runs = np.bincount(disguised(texts)[0], minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(s, pa.float64()), pa.array(runs.astype(np.int64))],
                names=["_doc", "score", "restored"])

    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(work, "_doc long, score double, restored long")
