"""The trie by Euler tour against plain loops."""

import hashlib
import random
import zlib

import pytest

from shipyard.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def by_loops(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0, key), (role, text)))
    turns = {c: [x for _, x in sorted(ts)] for c, ts in turns.items()}
    members = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    out = []
    for path, ms in members.items():
        below = [q for q in members if q[:len(path)] == path]
        ends = sorted(c for c, last in ms if last)
        out.append((min(c for c, _ in ms), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(ms),
                    sum(len(q) == len(path) + 1 for q in below),
                    sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def by_spark(spark, rows, base_arcs=P.BASE_ARCS):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as k1", "2 as digest", "3 as c")
    return sorted(tuple(r) for r in P.prefix_trie(df, base_arcs).collect())


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-120, 420), n):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["", "é", "ab", None])))
    return rows + [(None, 0, "user", "no id")] + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_loops(spark, seed):
    rows = random_rows(seed, 60)
    assert by_spark(spark, rows, base_arcs=150) == by_loops(rows)


def test_one_long_conversation_and_many_children(spark):
    rows = [(1, k, "user", f"t{k % 3}") for k in range(400)] + [(1000 + c, 0, "user", f"only {c}") for c in range(150)]
    assert by_spark(spark, rows, base_arcs=300) == by_loops(rows)


def test_empty_and_turnless(spark):
    assert by_spark(spark, []) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "x")]
    assert by_spark(spark, rows) == by_loops(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
