"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from shipyard.llm import variants as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def by_loops(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def plain_counts(rows):
    upper = {i: i + 32 for i in range(65, 91)}
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def by_spark(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abé"), (3, "abcdefgÿ×")])
def test_variants_equal_loops(spark, seed, letters):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice([7, 7, 8, 8, 9, 10, 12]))) for _ in range(150)}
    for w in list(words):
        k = rnd.randrange(len(w))
        words.add(rnd.choice([w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1:], w + w[-1]]))
    counts = {w: rnd.choice([2, 3, 20, 30, 300, 4000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert by_spark(V.variants(df)) == by_loops(counts)


def test_runs_and_chains_of_long_words(spark):
    words = ["a" * n for n in (7, 8, 9, 11, 4000, 4001)] + ["ab" * 6, "ab" * 6 + "a", "ba" * 6, "b" + "ab" * 5 + "a"]
    counts = {w: 2 * 11 ** (k % 5) for k, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert by_spark(V.variants(df)) == by_loops(counts)


def test_words_of_texts(spark):
    rnd = random.Random(9)
    pool = ["MÜNCHEN", "münchen", "Müncheñs", "wörtlich", "wörtlch", "Straße×x", "kurz", "ABCDEFG", "abcdefgh"]
    rows = [(k, " ".join(rnd.choice(pool) + rnd.choice(["", "1", "_x", ".", "İ"]) for _ in range(60))) for k in range(40)]
    rows += [(None, "wörtlich abcdefg"), (3, None), (4, ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as word", "1 as n", "2 as way")
    assert by_spark(V.spelling_variants(df)) == by_loops(plain_counts(rows))
    assert by_spark(V.spelling_variants(df.where("false"))) == []
