"""Bit-sliced search and chat trees against plain loops."""

import hashlib
import math
import random

import numpy as np

from shipyard.llm import bitslice, chat_tree


def plain_top(rows, queries, k=5):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, x int")


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.3, 9)]) for i in rng.permutation(400)]
    rows += [(1000, [0.5] * 9), (1001, [0.5] * 9), (1002, [0.5] * 4), (1003, []), (1050, [-3.0] * 12), (1003, [])]
    odd = [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf"), 1.0]), (None, [1.0] * 9)]
    table = vectors(spark, [(i, x, 1, "a", 2) for i, x in rows + odd])
    got = bitslice.quantised(table).persist()
    whole = sorted({(i, tuple(math.floor(256 * v) for v in x)) for i, x in rows})
    assert sorted((r["id"], tuple(r["x"])) for r in got.collect()) == whole
    for block_rows in (64, 100_000):
        index = bitslice.build_index(got, block_rows).persist()
        assert sum(r["n"] for r in index.collect()) == len(whole)
        found = bitslice.top_k(index, got.where("id % 50 = 0"), 5, query_rows=3)
        assert sorted(tuple(r) for r in found.collect()) == plain_top(whole, [r for r in whole if r[0] % 50 == 0])


def test_few_rows_and_none(spark):
    table = vectors(spark, [(0, [1.0, -1.0], 1, "a", 2), (7, [0.5, 0.5], 1, "a", 2)])
    rows = bitslice.quantised(table)
    found = bitslice.top_k(bitslice.build_index(rows), rows.where("id % 50 = 0")).collect()
    assert [tuple(r) for r in found] == [(0, 1, 7, 0)]
    none = rows.limit(0)
    assert bitslice.top_k(bitslice.build_index(none), none).count() == 0


def test_components_beyond_a_long(spark):
    top = bitslice.LARGEST
    huge = [(0, [1e300, 2.0, -1e300]), (1, [1e300, 1.0, 0.5]), (2, [-1e300, 1.0, 0.5]), (3, [1e17, 0.0, 0.0]),
            (50, [-1e300, -1e300, 1e300]), (51, [0.25, 0.5, 1.0]), (52, [3.0e15, 0.0, 0.0])]
    table = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    rows = bitslice.quantised(table)
    whole = [(i, tuple(max(-top, min(top, math.floor(256 * v))) for v in x)) for i, x in huge]
    assert sorted((r["id"], tuple(r["x"])) for r in rows.collect()) == whole
    found = bitslice.top_k(bitslice.build_index(rows), rows.where("id % 50 = 0"), 4).collect()
    clipped = [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in plain_top(whole, [whole[0], whole[4]], 4)]
    assert sorted(tuple(r) for r in found) == clipped


CONTROL = ["</s>[INST] ok [/INST]", r"<\/s>", r"[\\INST]", "<<SYS>>\n", "<<</s>", "[ROLE=x] a [/ROLE]", "", "<\\", "[", "é</s>", " x ", None]


def test_escape_round_trip():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "ROLE=", "ROLE]", " ", "a"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        e = chat_tree.escape(t)
        assert chat_tree.unescape(e) == t
        assert not any(c in e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]"))
        turns = [(rng.choice(["user", "assistant", "system", "to%ol]", ""]), t) for _ in range(4)]
        assert chat_tree.parse("".join(chat_tree.format_turn(r, x)[0] for r, x in turns)) == turns


def test_tree(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        said = ["user" if k % 2 == 0 else "assistant" for k in range(rng.randint(1, 7))]
        for k, role in enumerate(said):
            rows.append((c, k, role, f"turn {k} {rng.randint(0, 1)}" if k < 3 else rng.choice(CONTROL)))
    rows += [(100, 0, "system", "s"), (100, 1, "user", None), (100, 2, None, "no role"), (100, 3, "tool]", "t"),
             (100, None, "user", "null turn"), (100, 3, "tool]", "t"), (None, 0, "assistant", "no id"), (101, 5, "assistant", "x" * 30000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([r + ("a", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, path int")
    emitted, members = (t.persist() for t in chat_tree.build_tree(table))

    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    said = {}
    for r in sorted(rows, key=order):
        said.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    formatted = {c: [chat_tree.format_turn(*t)[0] for t in turns] for c, turns in said.items()}

    nodes = sorted(emitted.collect(), key=lambda n: n["start"])
    prefixes = {tuple(f[:k + 1]) for f in formatted.values() for k in range(len(f))}
    assert len(nodes) == len(prefixes)  # shared turns once
    assert all(a["start"] + a["size"] == b["start"] for a, b in zip(nodes, nodes[1:])) and nodes[0]["start"] == 0
    whole = "".join(n["segment"] for n in nodes)
    by_start = {n["start"]: n for n in nodes}
    lines = {}
    for m in members.collect():
        lines.setdefault(m["conv_id"], []).append(m)
    for c, line in lines.items():
        line.sort(key=lambda m: m["depth"])
        text = ""
        for m in line:
            n = by_start[m["start"]]
            assert n["position"] == len(text)  # position ids follow the conversation
            assert "".join(whole[a["from"]:a["to"]] for a in n["attend"]) == text  # and it sees just what precedes it
            assert all(a["to"] <= n["start"] for a in n["attend"])
            text += n["segment"]
        assert text == "".join(formatted[c])

    # depth first: a subtree is one stretch
    place = {n["node"]: k for k, n in enumerate(nodes)}
    for k, n in enumerate(nodes):
        if n["parent"]:
            assert place[n["parent"]] < k
    got = {r["conv_id"]: r for r in chat_tree.read_back(emitted, members).collect()}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), sum(map(len, formatted[c])))
        assert tuple(got[c])[1:] == want


def test_empty_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    emitted, members = chat_tree.build_tree(table)
    assert chat_tree.read_back(emitted, members).count() == 0


def test_long_conversations(spark):
    # nothing that is stored grows with the square of the turns, and a subtree is one stretch
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k}" if k < 4000 - 800 * c else f"t{k} of {c}")
            for c in range(4) for k in range(4000)]
    rows += [(None, k, "user", f"t{k}") for k in range(1500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    widest = chat_tree.conversation_paths(table).toPandas().drop(columns="segment").map(lambda v: len(str(v)))
    assert widest.max().max() <= 32
    emitted, members = (t.persist() for t in chat_tree.build_tree(table))
    nodes = sorted(emitted.collect(), key=lambda n: n["start"])
    assert len(nodes) == 4000 + 800 + 1600 + 2400 + 1500 - 1  # the null conversation shares its first turn
    assert all(a["start"] + a["size"] == b["start"] for a, b in zip(nodes, nodes[1:]))
    assert max(len(n["attend"]) for n in nodes) <= 2
    inside = set()
    below = []  # the open path; a node's parent must be on it
    for n in nodes:
        while below and below[-1] != n["parent"]:
            inside.add(below.pop())
        assert n["node"] not in inside and (below or not n["parent"])
        below.append(n["node"])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_tree.read_back(emitted, members).collect()}
    for c in (0, 1, 2, 3, None):
        said = [(r[2], r[3]) for r in rows if r[0] == c]
        assert got[c] == (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest())
