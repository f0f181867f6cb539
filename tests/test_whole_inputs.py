"""Queries without SQL over whole streams, texts and vectors, against plain Python."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tidewatch.sources.streams import stream

QUERIES = entry.catalog()[0]
SF = "/root/testdata/sf0.01"


def test_fixed_share_over_all_positions(spark):
    rows = defaultdict(dict)
    for r in stream(spark.read.parquet(f"{SF}/events.parquet")).select("client", "pos", "loss").collect():
        rows[r.client][r.pos] = r.loss
    got = {(r.client, r.pos): (r.w_a, r.mixture) for r in QUERIES["exp_3_fixed_share"](spark, SF).collect()}
    assert len(got) == sum(map(len, rows.values())) and max(p for _, p in got) >= 900
    for client, losses in rows.items():
        w, v = 0.5, 0.0
        for pos in range(len(losses)):
            a, b = losses[pos], 1 - losses[pos]
            m = w * a + (1 - w) * b
            assert got[client, pos] == pytest.approx((w, m), abs=2e-6)
            v += w * (a - m) ** 2 + (1 - w) * (b - m) ** 2
            eta = min(1.0, math.sqrt(2 * math.log(2) / max(v, 1e-12)))
            x, y = w * math.exp(-eta * a), (1 - w) * math.exp(-eta * b)
            w = 29 / 30 * x / (x + y) + 1 / 60


def test_stems_of_whole_texts(spark, tmp_path):
    texts = ["a" * 300 + "b", "a" * 300 + "c", "short name", "x y " * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.stem for r in QUERIES["fn_bounded_stems"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        t = re.sub("[^A-Za-z0-9._-]+", "_", text).strip("_")
        assert got[i] == (t if len(t) <= 72 else f"{t[:59]}_{hashlib.sha256(t.encode()).hexdigest()[:12]}")
    assert got[0] != got[1]


def test_projection_of_whole_vectors(spark):
    of = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {(r.g, r.i): r.square for r in QUERIES["ml_6_gradient_projection"](spark, SF).collect()}
    assert got.keys() == {(k // 2, k % 2) for k in of if k ^ 1 in of}
    for (g, i), square in got.items():
        e, o = of[2 * g + i], of[2 * g + 1 - i]
        d, q = sum(x * y for x, y in zip(e, o)), sum(y * y for y in o)
        want = [x - d / q * y for x, y in zip(e, o)] if d < 0 and q > 0 else e
        assert square == pytest.approx(sum(x * x for x in want), abs=2e-5)
