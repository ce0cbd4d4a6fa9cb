"""Held-out accuracy and edge cases of the three classifiers."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shipyard.llm import language, quality, queries, toxicity
from shipyard.llm.textnp import Texts

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, _text string, score string, label int"
ODD = [(1, None), (2, ""), (3, "?!  12\n"), (4, "the and of " * 30000), (5, "a"), (5, "a"), (None, "no id here")]


def docs(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x", "y", 3) for i, t in rows], DOCS)


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def held_out(spark, name, label, sf=SF):
    got = queries.QUERIES[name](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    return both["score"].to_numpy(), both["predicted"].to_numpy(), both[label].to_numpy()


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).toPandas()
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = got.merge(docs_[["doc_id", "lang"]], on="doc_id")
    held = both[both["held_out"]]
    assert len(got) == len(docs_) and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_quality_held_out(spark):
    score, predicted, y = held_out(spark, "op5_quality_pu", "quality")
    assert auc(score, y) > 0.95 and (predicted == y).mean() > 0.9


def test_toxicity_held_out(spark):
    # sf0.01 has only 30 toxic texts to learn from, in four languages
    score, predicted, y = held_out(spark, "op10_toxicity", "toxic", "/root/testdata/sf0.1")
    assert auc(score, y) > 0.95 and (predicted == y).mean() > 0.97


def test_codewords_correct_a_bit():
    for k in (2, 3, 4, 7, 12, 30):
        code = language.codewords(k)
        gaps = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert min(gaps) >= (1 if k < 4 else 3)


def test_language_edge_cases(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the house and the {k}", "en"), (f"das haus und der {k}", "de"))]
    table = spark.createDataFrame([(i, t, lang, "x", "y", 3) for i, t, lang in rows] + [(99, "nobody", None, "x", "y", 3)], DOCS)
    model = language.train(table)
    assert model.languages == ["de", "en"]
    got = {(r["_doc"], r["lang_pred"]): r for r in language.identify(docs(spark, ODD), model).collect()}
    assert all((i, "und") in got and got[i, "und"]["score"] == 0 for i in (1, 2, 3))
    assert (4, "en") in got and len(got) == 6
    one = language.train(docs(spark, [(1, "one language")]))
    assert {r["lang_pred"] for r in language.identify(docs(spark, ODD), one).collect()} == {"en", "und"}
    none = language.train(docs(spark, [(1, "x")], lang=None))
    assert {r["lang_pred"] for r in language.identify(docs(spark, ODD), none).collect()} == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    # null and blank texts and copies neither pass the bound nor weigh on the classes
    rows = [(k, f"the house and the {k}", "en") for k in range(300)] + [(k, f"das haus und der {k}", "de") for k in range(300)]
    rows += [(k, t, "en") for k in range(400) for t in (None, "", " \n", "the very same text")]
    fitted = []
    monkeypatch.setattr(language, "fit_bits", lambda x, y, code, fit=language.fit_bits: fitted.append((x, y)) or fit(x, y, code))
    table = spark.createDataFrame([(i, t, lang, "x", "y", 3) for i, t, lang in rows], DOCS)
    language.train(table, sample_rows=100)
    x, y = fitted[-1]
    assert np.bincount(y).tolist() == [50, 50] and len(np.unique(x, axis=0)) > 60 and (x.sum(1) > 0).all()
    many = [(k, f"text {k} of language {k % 40}", f"l{k % 40}") for k in range(2000)]
    language.train(spark.createDataFrame([(i, t, lang, "x", "y", 3) for i, t, lang in many], DOCS), sample_rows=100)
    assert np.bincount(fitted[-1][1]).tolist() == [2] * 40


def test_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (4000, 5)).astype(np.float32), rng.normal(-1, 1, (1500, 5)).astype(np.float32)
    model = quality.fit_non_negative_risk(good[:1000], np.concatenate([good[1000:], bad]), 3000 / 4500)
    assert auc(np.concatenate([model.score(good), model.score(bad)]), np.repeat([1, 0], [4000, 1500])) > 0.98
    assert abs(model.score(np.concatenate([good[1000:], bad])).mean() - 3000 / 4500) < 0.1


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(k, k % 3 > 0, None) for k in range(60)], "doc_id long, q boolean, text string")
    labels = labels.select("doc_id", F.col("q").cast("int").alias("quality"), "text")
    rows = [(k, f"Plain words in a row, number {k}. " * 5 if k % 3 else "JUNK!! JUNK!! ||| " * 9) for k in range(60)]
    table = docs(spark, rows + ODD)
    model = quality.train(table, labels)
    got = quality.score(table, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(table, model, 0.3)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} >= {k for k in range(60) if k % 3}
    assert quality.score(docs(spark, []), model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 0")):
        flat = quality.train(table, none)
        assert {r["score"] for r in quality.score(table, flat).collect()} == {0.5}
    only = quality.train(table, labels.where("quality = 1"))  # labelled negatives are not needed
    assert only.prior == model.prior and 0 < only.prior < 1


def plain_risk(w, b, positive, unlabelled, prior):
    loss = lambda z: np.logaddexp(0, -z).mean()
    zp, zu = positive @ w + b, unlabelled @ w + b
    return prior * loss(zp) + max(0, loss(-zu) - prior * loss(-zp))


def test_fit_reaches_the_least_risk():
    # the non-negative part stays active here, so the risk is convex and a coarse search finds its least value
    rng = np.random.default_rng(5)
    positive = rng.normal(0.7, 1, (600, 2)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(0.7, 1, (400, 2)), rng.normal(-0.7, 1, (800, 2))]).astype(np.float32)
    model = quality.fit_non_negative_risk(positive, unlabelled, 1 / 3, steps=2000, rate=0.01)
    got = plain_risk(model.weights, model.bias, positive, unlabelled, 1 / 3)
    grid = np.linspace(-3, 3, 25)
    best = min(plain_risk(np.array([x, y]), b, positive, unlabelled, 1 / 3) for x in grid for y in grid for b in grid)
    assert got <= best + 1e-3


def test_shape_features_against_a_loop():
    texts = ["Plain words, in a row in a row.", "", "a a a b\nA a\na a a b\n", "|| 12 !! 12\r\nx"]
    got = quality.shape_features(Texts(pa.array(texts)))
    for text, row in zip(texts, got):
        raw = text.encode()
        counts = np.zeros(quality.TRIGRAMS)
        for k in range(len(raw) - 2):
            c = [int(quality.CLASS[raw[k + j]]) for j in range(3)]
            counts[(c[0] * quality.CLASSES + c[1]) * quality.CLASSES + c[2]] += 1
        assert np.allclose(row[:quality.TRIGRAMS], np.log1p(1e4 * counts / max(len(raw), 1)) / 5, atol=1e-5)
        words = re.findall("[0-9a-z]+", text.lower())
        pairs = list(zip(words, words[1:]))
        lines = [x for x in re.split("[\r\n]+", text.lower()) if x]
        again = sum(x == y for x, y in pairs)
        n, m = max(len(words), 1), max(len(lines), 1)
        want = [len(set(words)) / n, len(set(pairs)) / n, again / n, np.log1p(1e3 * again / n) / 5,
                sum(map(len, words)) / n / 10, len(set(lines)) / m, np.log1p(n) / 10, np.log1p(len(raw) / m) / 10]
        assert np.allclose(row[quality.TRIGRAMS:], want if text else 0, atol=1e-5)


def test_quality_prior_is_near_the_share_of_positives(spark):
    sf = "/root/testdata/sf0.1"
    share = spark.read.parquet(f"{sf}/labels.parquet").agg(F.avg("quality")).first()[0]
    model = queries.quality_model(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert abs(model.prior - share) < 0.05


def test_quality_sample_is_bounded(spark, monkeypatch):
    # one labelled id on thousands of rows, copied texts and null texts do not pass the bounds
    fitted = []
    monkeypatch.setattr(quality, "fit_non_negative_risk", lambda p, u, *a, fit=quality.fit_non_negative_risk, **b: fitted.append(
        (p, u)) or fit(p, u, *a, **b))
    rows = [(7, f"Plain words in a row, number {k}.") for k in range(3000)] + [(7, "the very same text")] * 5000
    rows += [(k, "JUNK!! ||| %d" % k) for k in range(100, 900)] + [(k, None) for k in range(900, 1900)]
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    quality.train(docs(spark, rows), labels, positive_rows=100, unlabelled_rows=100)
    p, u = fitted[-1]
    assert len(p) == 100 and len(u) == 100
    again = quality.train(docs(spark, rows[::-1]), labels, positive_rows=100, unlabelled_rows=100)
    assert np.allclose(again.weights, quality.train(docs(spark, rows), labels, positive_rows=100, unlabelled_rows=100).weights)


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(1)
    text = " ".join(rng.choice("the idiot moron was a stupid loser and it is not that good of them".split()) for _ in range(4000))
    texts = Texts(pa.array([text]))
    counts = np.zeros(toxicity.ALPHABET ** 3)
    s = np.concatenate([[0], toxicity.SYMBOL[texts.buf], [0]])
    np.add.at(counts, s[:-2] * 784 + s[1:-1] * 28 + s[2:], 1)

    class Rows:
        def collect(self):
            return [{"code": k, "n": counts[k]} for k in np.flatnonzero(counts)]

    return toxicity.language_model(Rows())


def test_restores_disguised_words(letters):
    restore = toxicity.Restorer(letters).restore
    assert restore("You 1d10t, m0r0n!") == "you idiot, moron!"
    assert restore("such a s t u p i d thing") == "such a stupid thing"
    assert restore("l.o.s.e.r") == "loser"
    assert restore("iiiidiooot") == "idiot"
    for plain in ("It was good, wasn't it? 12 3.5", "", "é 1 ü", "a b", "THE!! AND!!"):
        assert restore(plain) == plain.lower()


def test_decode_is_the_best_path(letters):
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        run = "".join(rng.choices("il1o0t5a. ", k=rng.randint(1, 6)))
        best = None
        for choice in itertools.product(*toxicity._slots(run), [(" ", 0.0)]):
            said, cost = "".join(c for c, _ in choice), sum(c for _, c in choice)
            x, y, s = 0, 0, -cost
            for c in said:
                z = ord(c) - 96 if c != " " else 0
                s += letters[x, y, z]
                x, y = y, z
            best = max(best, (s, said)) if best else (s, said)
        assert toxicity.decode(run, letters) == best[1].strip()


def test_every_disguise_is_read(letters, spark):
    restore = toxicity.Restorer(letters).restore
    for said, meant in (("idi07", "idiot"), ("stuupid", "stupid"), ("ssttuuppiidd", "stupid"), ("l0$er, m0r0n", "loser, moron"),
                        ("s  t u  p i d", "stupid"), ("w a s", "was"), ("w @ $", "was"), ("wa$", "was"), ("good", "good")):
        assert restore(said) == meant
    table = docs(spark, [(1, "le crétin est là, un crétin très bête à l'été, idiot " * 50), (2, "CRÉTIN")])
    more = toxicity.more_letters(table)
    assert more == "àèéê"
    french = toxicity.Letters(toxicity.language_model(toxicity.letter_counts(table, "text", more), 28 + len(more)), more)
    restore = toxicity.Restorer(french).restore
    for said, meant in (("crét1n!", "crétin"), ("CRÉT1N", "crétin"), ("c r é t i n", "crétin"), ("bêêête", "bête"), ("c.r.é.t.1.n", "crétin")):
        assert restore(said).rstrip("!") == meant


def test_long_runs_are_read_as_a_whole(letters):
    restore = toxicity.Restorer(letters).restore
    assert restore("a st" + "u" * 70 + "pid moron") == "a stupid moron"
    said = "the stupid moron was not that good " * 4
    assert toxicity.decode(" ".join(said.replace(" ", "")), letters).replace(" ", "") == said.replace(" ", "")
    # a break inside the text stays wherever it falls
    one, two = " ".join("stupid" * 5), " ".join("moron" * 5)
    assert toxicity.decode(one + " " + two, letters).count("stupid") == 5
    assert len(toxicity.decode("l.o.s.e.r." * 20_000, letters).replace(" ", "")) == 100_000


def test_letter_counts_cover_all_texts(spark):
    table = docs(spark, [(1, "ab ab"), (2, None), (3, "éa")])
    got = {r["code"]: r["n"] for r in toxicity.letter_counts(table).collect()}
    assert got[0 * 784 + 1 * 28 + 2] == 2 and got[1 * 784 + 2 * 28 + 0] == 2 and got[27 * 784 + 27 * 28 + 1] == 1


def test_toxicity_edge_cases(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("the quick brown fox jumps over lazy dogs".split(), k=30))
             + (" you nasty moron" if k % 4 == 0 else "") + f" {k}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1)], "doc_id long, toxic int")
    table = docs(spark, rows + ODD + [(300, "the quick m0r0n"), (301, "the n a s t y fox")])
    model = toxicity.train(table, labels, table)
    got = {r["_doc"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert all((got[k] >= 0.3) == (k % 4 == 0) for k in range(200) if k not in (1, 2, 3, 4, 5))
    assert got[300] >= 0.3 and got[301] >= 0.3
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.train(table, labels.where("toxic = 0"), table)
    assert max(r["score"] for r in toxicity.score(table, none).collect()) < 0.3
