"""Suffix sorting and repeat removal against plain byte loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from shipyard.llm import suffix_dedup as sd
from shipyard.llm.textnp import Texts, padded

DOCS = "doc_id long, text string, row string, marks int, route string"


def plain(rows, length=50):
    """One result row per row: a string goes if it starts in a document with a smaller id."""
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            first[s] = min(first.get(s, float("inf")), order(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < order(i):
                gone[p:p + length] = True
        spans = int(gone[:1].sum() + (~gone[:-1] & gone[1:]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_sort_windows():
    rng = np.random.default_rng(0)
    for t in range(30):
        buf = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(60, 300))).astype(np.uint8)
        buf = np.tile(buf[:70], 4) if t % 3 == 0 else buf
        at = rng.permutation(len(buf) - 49)
        order, starts = sd.sort_windows(padded(buf), at)
        raw = buf.tobytes()
        windows = [raw[at[i]:at[i] + 50] for i in order]
        assert windows == sorted(windows)
        assert starts.tolist() == [i for i in range(len(windows)) if i == 0 or windows[i] != windows[i - 1]]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = "".join(rng.choices("ab", k=90))
    a, b = "x" * 33 + shared + "y" * 9, "zz" + shared
    doc, key, first, last = sd.stretches(Texts(pa.array([a, b])))
    of = {}
    for d, k, f, n in zip(doc, key, first, last):
        for p in range(f, n + 1):
            of[(d, (a + b)[p:p + 50])] = k
    for p in range(len(shared) - 49):
        assert of[(0, shared[p:p + 50])] == of[(1, shared[p:p + 50])]


def cases():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(30) for _ in range(4)]
    rows = [(i, " ".join(rng.sample([prose(rng.randint(0, 60)), *rng.sample(passages, rng.randint(0, 3))], 1)
                         + rng.sample(passages, rng.randint(0, 2)) + [prose(8)])) for i in range(60)]
    long = prose(900)
    rows += [(100, long), (101, long), (102, long[:2000] + "!" + long[2000:]), (99, "é" + long[500:900])]
    rows += [(103, "ab" * 400), (104, "ab" * 300), (105, "a" * 50), (106, "a" * 49), (107, "a" * 51), (108, None), (109, "")]
    rows += [(110, long[:400]), (110, long[:400]), (110, long[300:800]), (None, long[:700]), (None, "q" * 80)]
    rng.shuffle(rows)
    return rows


def test_remove_repeats(spark):
    rows = cases()
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(5)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain(rows), key=key)
    got = sorted((tuple(r) for r in sd.remove_repeats(table).collect()), key=key)
    assert got == want
    assert sum(r[2] for r in want) > 5000


def test_small_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(sd, "SORT_WINDOWS", 100)
    rows = cases()
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).coalesce(1)
    assert sorted(r["n_removed"] for r in sd.remove_repeats(table).collect()) == sorted(r[2] for r in plain(rows))
    assert sd.remove_repeats(table.limit(0)).count() == 0


def line_everywhere(n):
    rng = random.Random(11)
    prose = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    shared = [prose(40) for _ in range(6)]
    return [(i, prose(60) + "Licensed under the same terms." + (rng.choice(shared) if i % 3 else prose(40)) + prose(60))
            for i in range(n)]


def test_hot_anchors_are_spread(spark):
    rows = line_everywhere(400)
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).coalesce(1)
    base = sd._base(table, "doc_id", "text")
    hot = sd.hot_anchors(base, 50)
    assert len(hot)
    texts = pa.array([t for _, t in rows])
    all_of = [list(range(200))] * len(rows)  # every stretch is wanted
    ids = pa.array(range(len(rows)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, texts, pa.array(all_of, pa.list_(pa.int32()))],
                                       names=["row", "doc_id", "doc", "text", "anchors"])
    at_once = []
    for keys in (np.zeros(0, np.uint64), hot):
        seen = {}
        for out in sd._cut_stretches(7, keys)(iter([batch])):
            for r in out.to_pylist():
                for k in np.frombuffer(r["keys"], "<u4").tolist():
                    seen[r["route"], k] = seen.get((r["route"], k), 0) + 1
        at_once.append(max(seen.values()))
    assert at_once[0] > 100 and at_once[1] <= 50


def test_hot_anchors_keep_the_result(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_STRETCHES", 9)
    for rows in (line_everywhere(120), cases()):
        table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(3)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted((tuple(r) for r in sd.remove_repeats(table).collect()), key=key) == sorted(plain(rows), key=key)


def repeated_row(n):
    """``n`` copies of one row, texts of other rows that share its strings, and unlike ones."""
    rng = random.Random(13)
    prose = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    said = prose(400)
    return [(5, said)] * n + [(9, prose(30) + said[100:300]), (2, said[250:] + prose(40)), (5, prose(80)), (None, said)]


def test_a_repeated_row_counts_once(spark, monkeypatch):
    sent = []
    for n in (100, 400):
        table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in repeated_row(n)], DOCS).coalesce(1)
        sent.append(sd.marked_bytes(sd._base(table, "doc_id", "text")).count())
    assert sent[0] == sent[1]
    rows = repeated_row(5000)
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(6)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in sd.remove_repeats(table).collect()), key=key) == sorted(plain(rows), key=key)
