"""Exact de-duplication, mixing and packing against plain loops on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipyard.llm import exact_dedup, mixing, packing
from shipyard.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hash string, row string, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows], DOCS)


ROWS = [(1, "a b", "s1"), (2, "a b", None), (3, None, "s1"), (4, "", "s2"), (5, "a b ", "s2"), (6, "x " * 5000, "s1"),
        (7, "é ü", "s3"), (8, "x " * 5000, None), (None, "null id", "s1"), (9, "a b", "s1"), (9, "a b", "s1")]


def test_exact_classes(spark):
    for hash128 in (exact_dedup.content_hash, lambda body: F.substring(F.md5(body.cast("binary")), 1, 0)):
        got = exact_dedup.exact_classes(docs(spark, ROWS), hash128=hash128).collect()
        assert len(got) == len(ROWS)
        groups = {}
        for i, t, _ in ROWS:
            groups.setdefault(t or "", []).append(i)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_sha[r["text_sha256"]]
            assert r["doc_id"] in ids and r["group_size"] == len(ids)
            assert r["keep_id"] == (max(ids) if None not in ids else None)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_keep_last_keeps_one_row_and_all_columns(spark):
    got = exact_dedup.keep_last(docs(spark, ROWS))
    assert got.columns == docs(spark, ROWS).columns
    rows = sorted((r["doc_id"] or -1, r["text"]) for r in got.collect())
    assert [r[0] for r in rows] == [-1, 4, 5, 7, 8, 9]
    assert exact_dedup.keep_last(docs(spark, [])).count() == 0
    assert exact_dedup.exact_classes(docs(spark, [])).count() == 0


def plain_targets(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > repeats * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in above}


def test_targets_follow_the_loop(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        sizes = {f"s{k}": int(rng.integers(0, 1000) ** 2) for k in range(12)} | {None: 7, "Z": 0, "é": 50}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), f"s{k % 40 and k % 4}") for k in range(800)]
    rows += [(None, "n " * 3, None), (900, None, "s1")]
    table = docs(spark, rows)
    got = mixing.mix_report(table).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_report(table).collect()}
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", dict((i, t) for i, t, _ in rows)[r["doc_id"]] or ""))
        assert r["size"] == size and r["taken"] <= 3 * size and again[r["doc_id"]] == r["taken"]
        source = dict((i, s) for i, _, s in rows)[r["doc_id"]]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in taken)
    whole = mixing.mixed(table)
    assert whole.columns == table.columns
    assert whole.select(F.sum(mixing.word_count("text"))).first()[0] == sum(taken.values())
    assert mixing.mix_report(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def one_key_rows():
    """A third of the rows without an id, and a third one row repeated."""
    rng = np.random.default_rng(8)
    said = lambda k: " ".join([f"w{k}"] * int(rng.integers(1, 60)))
    return ([(k, said(k), f"s{k % 3}") for k in range(5000)] + [(None, said(k), f"s{k % 3}") for k in range(5000)]
            + [(7, "one row again and again", "s0")] * 5000)


def test_mix_meets_targets_with_null_ids_and_a_repeated_row(spark):
    rows = one_key_rows()
    tables = [docs(spark, rows).repartition(7), docs(spark, [r for r in rows if r[0] != 7]),
              docs(spark, [(7, "one row again and again", "s0")] * 5000 + [(8, "b " * 9000, "s1"), (9, "c " * 9000, "s2")])]
    for table in tables:
        wide = table.select("doc_id", "source", mixing.word_count("text").alias("size"))
        sizes = {r["source"]: r["n"] for r in wide.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        want = plain_targets(sizes)
        report = mixing.mix_report(table)
        assert report.count() == table.count()
        assert report.where("taken > 3 * size").isEmpty()
        whole = mixing.mixed(table)
        assert whole.columns == table.columns
        got = whole.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n"))
        got = {r["source"]: r["n"] for r in got.collect()}
        longest = {"s0": 60, "s1": 9000, "s2": 9000} if len(rows) - 1 > table.count() and table.count() < 6000 else {}
        for s in want:
            assert abs(got.get(s, 0) - want[s]) <= max(0.02 * want[s], longest.get(s, 0) / 2)
        assert report.agg(F.sum("taken")).first()[0] == sum(got.values())


def test_mix_splits_equal_rows_as_the_sql_does(spark, tmp_path):
    import duckdb

    rows = one_key_rows()[-6000:]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    mix, _ = mixing.plan_mix(table)
    assert mix.split
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r)[:3] + tuple(r)[4:] for r in mixing.mix_report(table).collect()]
    want = [r[:3] + r[4:] for r in con.execute(mixing.ORACLE).fetchall()]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_bounds_and_bins():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = rng.integers(1, 9)
        lengths = rng.integers(1, 21, n)
        bins, offsets = packing.best_fit_decreasing(lengths, 20)
        for b in set(bins.tolist()):
            inside = sorted((int(offsets[i]), int(lengths[i])) for i in np.flatnonzero(bins == b))
            assert all(a + k == c for (a, k), (c, _) in zip(inside, inside[1:])) and inside[0][0] == 0
            assert sum(k for _, k in inside) <= 20
        assert packing.bins_needed(lengths, 20) <= best_possible(lengths.tolist(), 20) <= bins.max() + 1


def best_possible(lengths, capacity):
    def fits(k, left, items):
        if not items:
            return True
        return any(fits(k, left[:b] + [left[b] - items[0]] + left[b + 1:], items[1:])
                   for b in {left.index(x): 0 for x in set(left) if x >= items[0]})
    k = 1
    while not fits(k, [capacity] * k, sorted(lengths, reverse=True)):
        k += 1
    return k


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    rows = [(k, t, "s") for k, t in enumerate([
        None, "", "It's a TEST's end, don't! ÉÀ é é ́x 12 3.5 x\x1cy z", "<|endoftext|> a <|STARTOFTEXT|>b",
        "word " * 9000, "ΑΣ ΣΑΣ İi ǅ", "x" * 700, "\t\n", " lead and trail ", "日本語 の テキスト"])]
    rows += [(None, "null id", None), (3, "same id", None)]
    table = docs(spark, rows)
    got = packing.pack_documents(table, path).collect()
    want = []
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a:a + 4096], "<u4")
            want.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in bins.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))
        assert sum(n for _, n in inside) <= 4096
    assert len(bins) == packing.bins_needed(np.array([r["length"] for r in got]))
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_gaps_are_repacked(spark):
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 4097, 3000)
    table = spark.createDataFrame([(k, 0, k, int(n)) for k, n in enumerate(lengths)], "doc_id long, piece int, copy long, length long")
    got = packing.pack_pieces(table, deal_rows=300).toPandas()
    assert sorted(got.copy_ if hasattr(got, "copy_") else got["copy"]) == list(range(3000))
    assert (got.groupby("sequence_id")["length"].sum() <= 4096).all()
    alone = packing.best_fit_decreasing(lengths)[0].max() + 1
    assert got["sequence_id"].nunique() <= alone * 1.02


def test_sequences_hold_the_ids(spark):
    table = docs(spark, [(k, f"text number {k} " * (k * 40), "s") for k in range(30)])
    pieces = packing.tokenize_pieces(table, tokenizer_path(), keep_ids=True).withColumn("copy", F.lit(0).cast("long"))
    placed = packing.pack_pieces(pieces)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, placed).collect()}
    for r in pieces.join(placed, ["doc_id", "piece", "copy", "length"]).collect():
        part = made[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert list(part) == list(r["ids"]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]


@pytest.fixture(autouse=True)
def _small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
