import itertools
import zlib

import numpy as np
import pytest

from tidewatch.llm import langid

DATA = "/root/testdata/sf0.01"


def brute_posteriors(emission, transition):
    """Sum over all labellings of a short text."""
    n, k = emission.shape
    sums, total = np.zeros(k), 0.0
    for labels in itertools.product(range(k), repeat=n):
        score = np.log(sum(np.exp(transition[p, labels[0]]) for p in range(k)) / k)  # uniform prior before the first word
        score += sum(emission[i, y] for i, y in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:]))
        weight = np.exp(score)
        total += weight
        for y in labels:
            sums[y] += weight
    return sums / total


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_posteriors_against_all_labellings(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], {}, np.zeros((1, 3)), rng.normal(size=(3, 3)))
    sizes = np.array([4, 0, 1, 6, 3])
    emission = rng.normal(size=(14, 3)) * 2
    sums = langid.posterior_sums(model, emission, sizes)
    for got, part in zip(sums, np.split(emission, np.cumsum(sizes)[:-1])):
        want = brute_posteriors(part, model.transition) if len(part) else np.zeros(3)
        assert np.allclose(got, want)


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return {r.doc_id: r for r in langid.predict_held_out(docs).collect()}, {r.doc_id: r for r in docs.collect()}


def test_held_out_accuracy(predicted):
    got, docs = predicted
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [r for r in got.values() if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 100
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words(spark, predicted):
    _, docs = predicted
    by = {lang: next(d.text for d in docs.values() if d.lang == lang and len(d.text) > 1500 and "|" not in d.text) for lang in ("en", "de")}
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    ws = langid.words(by["en"])[:60] + langid.words(by["de"])[:30]
    shares = langid.posterior_sums(model, model.emissions(ws), np.array([90]))[0] / 90
    assert abs(shares[model.languages.index("en")] - 2 / 3) < 0.1 and abs(shares[model.languages.index("de")] - 1 / 3) < 0.1


def test_edge_rows(spark):
    text = "the thing and that "
    rows = [(1, "de", "die und das nicht " * 9, 1), (2, "en", text * 9, 2), (3, None, None, 3), (4, "en", "123 ²³ _", 4), (None, "en", text, 5), (6, None, text * 20000, 6), (6, "de", "", 7), (6, "de", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")
    model = langid.fit([(r[2], r[1]) for r in rows if r[1] and r[2]])
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(docs, model).collect())
    assert got == [("1", "de"), ("2", "en"), ("3", "und"), ("4", "und"), ("6", "en"), ("6", "und"), ("6", "und"), ("None", "en")]
    assert sorted(str(r.doc_id) for r in langid.accept(docs, model).collect()) == ["1", "2", "6", "None"]
    assert langid.accept(docs, model).columns == docs.columns
    nothing = langid.predict_held_out(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.predict_held_out(docs.limit(0)).count() == 0


def test_features_of_a_long_run_cover_it_all():
    """A run of letters without blanks is judged by all of its n-grams."""
    run = "ab" * 20 + "xyz" * 400
    w = f"<{run}>"
    want = ["=" + run, "pa", "pab", "paba", "sz", "syz", "sxyz", *(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))]
    assert sorted(langid.features(run)) == sorted(want)
    model = langid.Model(["a", "b"], {"ab": 0, "xy": 1}, np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), np.zeros((2, 2)))
    assert model.emissions([run]).tolist() == [[20.0, 400.0]]
