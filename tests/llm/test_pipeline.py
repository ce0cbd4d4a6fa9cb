"""The pipeline's stages, each against a plain version on what its predecessor kept."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_near_dedup import plain_similarity

import corpus_pipeline
from shipyard.llm import near_dedup, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize_table(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_the_columns(results):
    assert all(r.columns == results[0].columns for r in results[:-1])
    assert all(r.dtypes == results[0].dtypes for r in results[:-1])


def test_quality_keeps_good_documents(spark, results):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in results[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.95 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in bad) < 0.5 * len(bad)


def test_exact_copies(results):
    last = {}
    for r in results[1].collect():
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in results[2].collect()) == sorted(last.values())


def test_near_copies(results):
    rows = [(r["doc_id"], r["text"]) for r in results[2].collect()]
    kept = {r["doc_id"] for r in results[3].select("doc_id").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(results[2]).collect()}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if plain_similarity(s, t) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert classes == {i: find(i) for i in root} and kept == set(classes.values())


def test_mix_repeats_whole_documents(results):
    before = {r["doc_id"]: r for r in results[3].collect()}
    after = Counter(r["doc_id"] for r in results[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    taken, size = defaultdict(int), defaultdict(int)
    for i, r in before.items():
        words = len((r["text"] or "").split())
        taken[r["source"]] += after[i] * words
        size[r["source"]] += words
    assert all(taken[s] <= 3 * size[s] for s in size) and sum(taken.values()) > 0.7 * sum(size.values())


def test_pack_places_every_document(spark, results):
    counts = Counter(r["doc_id"] for r in results[4].select("doc_id").collect())
    packed = results[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == counts
    used = defaultdict(int)
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY
    assert "pipeline" in __import__("__spark_entry__").queries() and len(queries.QUERIES) == 13


def odd_documents(spark):
    """The documents with columns of clashing names, and rows with nulls, empty, long and repeated texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fields = {f.name: f.dataType for f in docs.schema}
    blank = dict.fromkeys(fields)
    long = " ".join(f"word{k}" for k in range(60_000))
    odd = [blank, blank, {**blank, "doc_id": 900_001}, {**blank, "doc_id": 900_002, "text": ""},
           {**blank, "text": "no id but a text of some words", "source": "s"},
           *[{**blank, "doc_id": 900_003, "text": "one row again and again and again", "source": "s"}] * 40,
           {**blank, "doc_id": 900_004, "text": long}]
    more = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema)
    clashing = {c: F.lit(1) for c in ("_doc", "_text", "_id", "_size", "_key", "row", "hash", "copy", "piece", "score", "class_id")}
    return docs.unionByName(more).withColumns(clashing)


def test_stages_take_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark)
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(corpus_pipeline.materialize_table(stage(spark, results[-1], SF)))
    assert all(r.columns == docs.columns for r in results[:-1])
    quality, exact, near, mix, pack = results[1:]
    assert exact.count() == exact.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact.count() == quality.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert near.exceptAll(exact).isEmpty() and mix.select("doc_id", "text").distinct().exceptAll(near.select("doc_id", "text")).isEmpty()
    assert pack.where("piece = 0").count() == mix.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "pack":
            assert out.columns == docs.columns
