import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import lm

SF = "/root/testdata/sf0.01"


def made_ids(rng, n=30):
    """Ids with marks between and around."""
    ids = rng.integers(0, lm.VOCAB, size=n).astype(np.int32)
    ids[[0, 1, 9, 10, n - 2, n - 1]] = lm.VOCAB
    return ids


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = lm.Network(rng.random(lm.VOCAB) + 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = made_ids(rng)
    mean = lambda: net.forward(ids, 2, 28)[0].mean()
    grads, dx = net.gradients(net.forward(ids, 2, 28)[1])
    grads["sides"] = np.zeros_like(net.p["sides"])
    np.add.at(grads["sides"], ids, lm.spread(dx))
    row, sums, n = lm._sums(ids, lm.spread(dx))
    assert np.allclose(grads["sides"][row], sums) and n.sum() == len(ids)
    for k, g in grads.items():
        direction = rng.normal(size=g.shape)
        before = net.p[k]
        up, down = [], []
        for sign, out in ((1, up), (-1, down)):
            net.p[k] = before + sign * 1e-4 * direction
            out.append(mean())
        net.p[k] = before
        assert abs((up[0] - down[0]) / 2e-4 - float((g * direction).sum())) < 1e-4 * max(1, abs(float((g * direction).sum()))), k


def plain_logp(net, ids, at):
    """The log-probability of one token, by loops."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = p["bias"].copy()
    for i, d in enumerate((-2, -1, 1, 2)):
        h += p["sides"][ids[at + d], i * lm.HIDDEN : (i + 1) * lm.HIDDEN]
    h = np.tanh(h)
    branch, twig, leaf = ids[at] // lm.FAN**2, ids[at] // lm.FAN, ids[at] % lm.FAN
    total = 0.0
    for logits, y in (
        (h @ p["branch"] + p["branch_bias"], branch),
        ((h + p["of_branch"][branch]) @ p["twig"] + p["twig_bias"][branch], twig % lm.FAN),
        ((h + p["of_twig"][twig]) @ p["leaf"] + p["leaf_bias"][twig], leaf),
    ):
        total += logits[y] - np.logaddexp.reduce(logits)
    return total


def test_forward_against_loops():
    rng = np.random.default_rng(3)
    net, ids = lm.Network(rng.random(lm.VOCAB) + 1), made_ids(rng)
    at = [i for i in range(2, 28) if ids[i] != lm.VOCAB]
    assert np.allclose(net.forward(ids, 2, 28)[0], [plain_logp(net, ids, i) for i in at], atol=1e-4)
    assert np.array_equal(net.forward(ids, 2, 28, keep=False)[0], net.forward(ids, 2, 28)[0])


def test_probabilities_sum_to_one():
    net = lm.Network(np.arange(1, lm.VOCAB + 1.0))
    ids = np.full(5 * lm.VOCAB, 7, np.int32)
    ids[2::5] = np.arange(lm.VOCAB)  # each id between the same neighbours
    total = sum(np.exp(net.forward(ids[5 * i : 5 * i + 5], 2, 3)[0].astype(float)).sum() for i in range(lm.VOCAB))
    assert abs(total - 1) < 1e-3


def test_counts_cover_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED_AT_ONCE", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    want = Counter(w for r in docs.collect() for w in lm.words(r.text))
    assert {r.word: r.n for r in lm.word_counts(docs).collect()} == want
    vocab = lm.Vocabulary(docs, size=lm.RARE + 900, share=3000)
    top = sorted(want, key=lambda w: (-want[w], w.encode()))
    assert list(vocab.ids) == top[: len(vocab.ids)] and list(vocab.shared) == top[: len(vocab.shared)]
    assert 700 < len(vocab.ids) <= 900 and len(vocab.ids) < len(vocab.shared) <= 3000
    assert {r.word: r.n for r in vocab.others.collect()} == {w: n for w, n in want.items() if w not in vocab.shared and n > 1}
    counts = np.ones(lm.VOCAB)
    for w, n in want.items():
        counts[vocab.ids.get(w, lm.bucket(w))] += n
    assert np.allclose(vocab.counts, counts)


def test_scores_prefer_text_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocab = lm.Vocabulary(docs)
    net = lm.train(docs, vocab)
    rows = [r for r in docs.collect() if r.lang == "en" and len(lm.words(r.text)) > 100][:40]
    mixed = []
    for r in rows:
        other = next(x for x in docs.collect() if x.lang == "de" and len(lm.words(x.text)) > 100)
        a, b = lm.words(r.text)[:100], lm.words(other.text)[:100]
        ws = [w for pair in zip(a, b) for w in pair]
        random.Random(1).shuffle(ws)
        mixed.append((r.doc_id, " ".join(ws)))
    plain = {r.doc_id: r.pll_per_token for r in lm.score(docs, vocab, net).collect()}
    other = {r.doc_id: r.pll_per_token for r in lm.score(spark.createDataFrame(mixed, "doc_id long, text string"), vocab, net).collect()}
    assert np.mean([plain[d] > other[d] for d in other]) > 0.9
    untrained = {r.doc_id: r.pll for r in lm.score(docs, vocab, lm.Network(vocab.counts)).collect()}
    trained = {r.doc_id: r.pll for r in lm.score(docs, vocab, net).collect()}
    assert sum(trained.values()) > sum(untrained.values())


def test_query_scores_against_loops(spark):
    """Every document's score by plain loops over its words: network, buckets, and words' own shares with and without the broadcast counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    for share in (lm.SHARED, 400):
        vocab = lm.Vocabulary(docs, size=lm.RARE + 300, share=share)
        net = lm.train(docs, vocab)
        counts = Counter(w for r in docs.collect() for w in lm.words(r.text))
        texts = {r.doc_id: lm.words(r.text)[:80] for r in docs.collect()} | {9000: ["neverseen"], 9001: []}
        short = spark.createDataFrame([(d, " ".join(ws)) for d, ws in texts.items()], "doc_id long, text string")
        for r in lm.score(short, vocab, net).collect():
            ws = texts[r.doc_id]
            ids = [lm.VOCAB] * 2 + [vocab.ids.get(w, lm.bucket(w)) for w in ws] + [lm.VOCAB] * 2
            own = [0.0 if w in vocab.ids else np.log(max(counts[w], 1)) - np.log(max(vocab.counts[lm.bucket(w)] - 1, 1)) for w in ws]
            want = sum(plain_logp(net, np.array(ids), i + 2) + own[i] for i in range(len(ws)))
            assert r.n_tokens == len(ws) and abs(r.pll - want) < 1e-3 * max(1, len(ws))


def test_averages_against_loops(spark):
    """The tasks' changes: rows of embeddings by their own uses, the rest by tokens."""
    docs = spark.createDataFrame([(i, f"the cat number {i % 7} sat on the mat {i % 5}") for i in range(40)], "doc_id long, text string").repartition(3).cache()
    vocab = lm.Vocabulary(docs, size=lm.RARE + 50)
    start, trainers = lm.Network(vocab.counts), []
    parts = [r.texts for r in docs.groupBy(F.spark_partition_id()).agg(F.collect_list("text").alias("texts")).collect()]
    for texts in parts:
        trainer = lm.Trainer(lm.Network(vocab.counts))
        trainer.fit(lm.read(lm.Words(pa.array(texts)), pa.array(list(vocab.ids)))[0])
        trainers.append(trainer)
    got = lm.train(docs, vocab)
    for k, v in got.p.items():
        weights = [t.uses if k == "sides" else np.full(len(v), t.seen) for t in trainers]
        change = sum((t.net.p[k] - start.p[k]).reshape(len(v), -1) * w[:, None] for t, w in zip(trainers, weights))
        want = start.p[k] + (change / np.maximum(sum(weights), 1e-9)[:, None]).reshape(v.shape)
        assert np.allclose(v, want, atol=1e-3), k


def test_partitions_change_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = ({r.doc_id: r.pll_per_token for r in lm.score_corpus(docs.repartition(n)).collect()} for n in (3, 6))
    assert np.median([abs(one[d] - two[d]) / abs(one[d]) for d in one if one[d]]) < 0.05


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a b", 1.0), (3, "a b", 1.0), (None, "a", None), (5, "a b c " * 40000, 2.0)], "doc_id long, text string, pll double").repartition(3)
    rows = {(r.doc_id, r.n_tokens): (r.pll, r.pll_per_token) for r in lm.score_corpus(docs).collect()}
    assert rows[1, 0] == rows[2, 0] == (0.0, 0.0)
    assert set(rows) == {(1, 0), (2, 0), (3, 2), (None, 1), (5, 120000)}
    assert all(np.isfinite(v).all() for v in rows.values())
    assert lm.score_corpus(docs.limit(0)).count() == 0


def test_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.pll for r in lm.score_corpus(docs).collect()} for _ in range(2))
    assert all(abs(one[d] - two[d]) <= 1e-6 * abs(one[d]) for d in one)


def test_every_word_has_its_own_probability(spark):
    """Words of one bucket differ by their counts, and the probabilities of all words sum to one."""
    said = {"the": 9, "of": 8, "and": 7, "station": 5, "nation": 3, "zzon": 1, "chat": 2, "what": 1}
    docs = spark.createDataFrame([(i, w) for i, (w, n) in enumerate(said.items()) for _ in range(n)], "doc_id long, text string")
    once = spark.createDataFrame([(i, w) for i, w in enumerate(said)], "doc_id long, text string")
    for share in (lm.SHARED, 3):
        vocab = lm.Vocabulary(docs, size=lm.RARE + 3, share=share)
        assert set(vocab.ids) == {"the", "of", "and"}
        net = lm.Network(vocab.counts)
        p = {said_word: np.exp(r.pll) for r in lm.score(once, vocab, net).collect() for said_word in [list(said)[r.doc_id]]}
        assert abs(p["station"] / p["nation"] - 5 / 3) < 1e-4 and abs(p["chat"] / p["what"] - 2) < 1e-4
        used = {lm.bucket(w) for w in said if w not in vocab.ids} | set(vocab.ids.values())
        ids = np.full(5, lm.VOCAB, np.int32)
        rest = 0.0
        for token in set(range(lm.VOCAB)) - used:
            ids[2] = token
            rest += np.exp(float(net.forward(ids, 2, 3)[0][0]))
        assert abs(sum(p.values()) + rest - 1) < 1e-3
