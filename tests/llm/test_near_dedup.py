"""Near-duplicate classes against all pairs on small tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from shipyard.llm import near_dedup as nd
from shipyard.llm.textnp import Texts

DOCS = "doc_id long, text string, id string, hash string, comp int, sig string"


def plain_weights(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    n = len(words)
    grams = Counter(tuple(words[k:k + 5]) for k in range(max(1, n - 4))) if n else Counter()
    return {g: 1 + math.log(c) for g, c in grams.items()}


def plain_similarity(a, b):
    x, y = plain_weights(a), plain_weights(b)
    least = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
    most = sum(x.values()) + sum(y.values()) - least
    return least / most if x and y else 0.0


def plain_classes(rows):
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, s), (j, t) in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if (s or "") == (t or "") or i == j or plain_similarity(s, t) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    n = 400
    key = rng.integers(1, 1 << 62, n).astype(np.uint64)
    wa, wb = rng.gamma(1.0, 2.0, n) + 0.01, rng.gamma(1.0, 2.0, n) + 0.01
    wb = np.where(rng.random(n) < 0.7, wa, wb)
    owner = np.repeat([0, 1], n)
    got = nd.dart_minhash(owner, np.tile(key, 2), np.concatenate([wa, wb]), 2, 3000)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((got[0] == got[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 3000)


def test_similarities_follow_the_definition():
    a = ["a b c d e f g", "A, b! c", "", "x " * 40, "one two three four five six", "é à ü ö ß é à"]
    b = ["a b c d e f h", "a b C", "q", "x " * 30 + "y", None, "é à ü ö ß é a"]
    got = nd.similarities(Texts(pa.array(a)), Texts(pa.array(b)))
    assert np.allclose(got, [plain_similarity(x, y) for x, y in zip(a, b)])


def test_near_classes(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(25):  # neighbours are near, the ends are not
        rows.append((len(rows), " ".join(chain)))
        chain[(k * 8) % 200] = "new%d" % k
    rows += [(900 + k, rows[0][1]) for k in range(5)] + [(950, None), (951, ""), (952, "!!"), (953, "one two"), (954, "One, two")]
    rows += [(None, rows[0][1]), (953, "one two")]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in rows], DOCS)
    got = nd.near_classes(table).collect()
    assert len(got) == len(rows)
    want = plain_classes(rows)
    sizes = Counter(want[i] for i, _ in rows if i is not None)
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["class_size"] == 1 and r["kept"]
        else:
            c = want[r["doc_id"]]
            assert (r["class_id"], r["class_size"], r["kept"]) == (c, sizes[c], r["doc_id"] == c)
    kept = nd.keep_first(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}
    assert nd.near_classes(table.limit(0)).count() == 0 and nd.keep_first(table.limit(0)).count() == 0


def test_banding_follows_the_similarity():
    assert nd.banding(0.8) == (32, 6) and math.ceil(nd.least_agreement(0.8) * 384) == 276
    for s in (0.1, 0.3, 0.5, 0.6, 0.9, 0.99, 1.0):
        bands, rows = nd.banding(s)
        assert bands * rows <= 192 and (1 - s ** rows) ** bands <= 1 / nd.MISSED


def test_lower_similarity_finds_its_links(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):  # pairs of a similarity between 0.6 and 0.8
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(100)]
        other = list(base)
        for k in (10, 40, 70):
            other[k] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    assert all(0.6 <= plain_similarity(rows[2 * g][1], rows[2 * g + 1][1]) < 0.8 for g in range(25))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(table, similarity=0.6).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_pairs_between_blocks(spark, monkeypatch):
    # every pair of different components is met once, and within salted blocks pairs grow with the rows only
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 4)
    sig = bytes(384)
    for comps in ([0] * 30 + list(range(1, 12)), list(range(23)), [0] * 9 + [1] * 9):
        top = max(set(comps), key=comps.count)
        rows = [(7, len(comps), len(comps) - comps.count(top), top, k, c, [7], sig) for k, c in enumerate(comps)]
        members = spark.createDataFrame(
            rows, "bucket long, n long, others long, top long, id long, comp long, buckets array<long>, sig binary")
        got = [(r["a"], r["b"]) for r in nd.close_pairs(members, 0.7, None).collect()]
        assert sorted(got) == [(a, b) for a in range(len(comps)) for b in range(a) if comps[a] != comps[b]]
        some = nd.close_pairs(members, 0.7, 1).collect()
        assert len(some) < len(comps) and {(r["a"], r["b"]) for r in some} <= set(got)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["comp"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got}
    assert all(n in got for a, b in edges if a != b for n in (a, b))


def test_components_end_in_one_task(spark, monkeypatch):
    # whether all edges, those that the first passes leave or none are joined in one task
    edges = [(k, k + 1) for k in range(0, 40, 2)] + [(1 + k, 2 + k) for k in range(0, 38, 2)] + [(100, 100 + k) for k in range(1, 9)]
    edges += edges[::3] + [(7, 7)]
    want = {n: 0 if n < 100 else 100 for e in edges for n in e}
    for last in (0, 50, 1 << 14):
        monkeypatch.setattr(nd, "LAST_EDGES", last)
        got = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r["id"], r["comp"]) for r in got) == sorted(want.items())
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_passes(spark, monkeypatch):
    # every pass costs its tasks, however few rows there are: they are most of the time on many partitions
    rng = random.Random(41)
    rows = []
    for g in range(10):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
        for k in range(6):  # a chain of near texts
            rows.append((len(rows), " ".join(base)))
            base[(17 * k + g) % 100] = "new%d" % k
    written = []
    plain = nd.materialize_table
    monkeypatch.setattr(nd, "materialize_table", lambda df: (written.append(df.columns), plain(df))[1])
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
    assert len(written) <= 15, written


def test_a_second_draw_is_made_for_large_buckets(spark, monkeypatch):
    rng = random.Random(17)
    base = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(70):
        own = list(base)
        for at in rng.sample(range(0, 300, 5), rng.choice([2, 5])):
            own[at] = "own%d" % rng.randrange(10 ** 9)
        rows.append((k, " ".join(own)))
    salts = []
    plain = nd.close_pairs
    monkeypatch.setattr(nd, "close_pairs", lambda members, agreement, salt, *a: (salts.append(salt), plain(members, agreement, salt, *a))[1])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for members, draws in ((4, [1, 2, None]), (256, [1])):  # one draw over whole buckets leaves nothing here
        monkeypatch.setattr(nd, "BLOCK_MEMBERS", members)
        salts.clear()
        assert {r["doc_id"]: r["class_id"] for r in nd.near_classes(table).collect()} == plain_classes(rows)
        assert salts == draws


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(21)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    first = [prose() for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(first)]
    # each further id bears a near copy of an earlier text and a text of its own
    rows += [(100 + k, t + " end") for k, t in enumerate(first)] + [(100 + k, prose()) for k in range(12)]
    table = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS)
    got = {(r["doc_id"], r["class_id"]) for r in nd.near_classes(table).collect()}
    assert got == {(i, plain_classes(rows)[i]) for i, _ in rows}
    kept = {(r["doc_id"], r["text"]) for r in nd.keep_first(table).collect()}
    assert kept == {(i, t) for i, t in rows if not t.endswith(" end")}


def test_bins_bound_the_similarity(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    texts = []
    for n in (3, 40, 150, 700):
        base = [rng.choice(words) for _ in range(n)]
        for share in (0, 0.02, 0.04, 0.3):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base * rng.choice([1, 1, 3])))
    true = {(x, y): plain_similarity(texts[x], texts[y]) for x in range(len(texts)) for y in range(x)}
    x, y = (np.array(c) for c in zip(*true))
    for size in (2048, 64):  # in few bins nearly all share one: a weaker bound, but still a bound
        monkeypatch.setattr(nd, "BINS", size)
        bins, total = nd.binned_weights(Texts(pa.array(texts)))
        for least in (0.3, 0.8):
            may = nd.may_link(bins, total, x, y, least)
            assert all(m for m, s in zip(may, true.values()) if s >= least)
            assert size == 64 or not any(m for m, s in zip(may, true.values()) if s < least - 0.1)
    # a sum beyond a byte gives no bound
    monkeypatch.setattr(nd, "BINS", 2)
    bins, total = nd.binned_weights(Texts(pa.array(texts)))
    assert total[-1] == 0 < total[0] and nd.may_link(bins, total, np.array([15]), np.array([0]), 0.8).all()


def test_texts_that_are_nearly_near_are_not_read_in_pairs(spark, monkeypatch):
    rng = random.Random(31)
    base = ["w%d" % k for k in range(1000)]
    rows = []
    for k in range(60):  # one passage, changed in places of their own: signatures come close, no two are near
        own = list(base)
        for at in rng.sample(range(0, 1000, 5), 14):
            own[at] = "own%d" % rng.randrange(10 ** 9)
        rows.append((k, " ".join(own)))
    rows.append((100, rows[7][1] + " end"))
    near = {(i, j) for (i, s), (j, t) in itertools.combinations(rows, 2) if plain_similarity(s, t) >= 0.8}
    read = []
    plain = nd.verified
    monkeypatch.setattr(nd, "verified", lambda pairs, *a: (read.append(pairs.count()), plain(pairs, *a))[1])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(table).collect()}
    assert got == plain_classes(rows)
    assert sum(read) <= 3 * (len(rows) + len(near)), (read, len(near))
