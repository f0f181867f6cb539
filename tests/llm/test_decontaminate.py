import random
import re

import pytest

from tidewatch.llm import decontaminate
from tidewatch.operators import skew

SF = "/root/testdata/sf0.001"


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_scan(docs, items):
    """id: (words, words hit, items)."""
    windows = []
    for item, text in items:
        ws = brute_words(text)
        n = min(10, len(ws))
        windows += [(item, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1) if n]
    by = {}
    for item, w in windows:
        by.setdefault(w, set()).add(str(item))
    lengths = {len(w) for w in by}
    out = {}
    for doc, text in docs:
        ws, hit, found = brute_words(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in by:
                    hit.update(range(i, i + n))
                    found |= by[w]
        out[doc] = (len(ws), len(hit), sorted(found))
    return out


def scanned(docs, benchmark):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(docs, benchmark).collect()}


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)


def made(rng):
    item = lambda n: " ".join(rng.choice("a b c d e É1".split()) for _ in range(n))
    items = [(i, item(rng.choice([1, 3, 4, 5, 6, 9, 10, 11, 14]))) for i in range(8)] + [(50, None), (51, " . "), (52, "Zz"), (3, "zz yy xx ww")]
    docs = [(i, item(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "zz-YY xx, zz"), (103, "x" * 9999)]
    docs += [(200 + i, f"{item(7)}. {rng.choice(items[:8])[1]}; {item(3)}") for i in range(30)]
    return docs, items


def test_made_rows_against_brute_force(spark, way):
    docs, items = made(random.Random(6))
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = brute_scan(docs, items)
    assert scanned(d, b) == want
    dropped = decontaminate.drop_contaminated(d, b)
    assert dropped.columns == d.columns
    assert {r.doc_id for r in dropped.collect()} == {k for k, v in want.items() if not v[1]}


def test_tables_against_brute_force(spark, way):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_scan([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert scanned(docs, benchmark) == want
    assert any(v[1] for v in want.values())


def test_empty_tables_and_repeated_rows(spark, way):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.n_hit) for r in decontaminate.scan(d, b).collect()) == [("1", 2), ("1", 2), ("None", 0)]
    assert decontaminate.scan(d.limit(0), b).count() == 0
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.scan(d, b.limit(0)).collect()) == [(1, 0), (3, 0), (3, 0)]
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 3
    r = decontaminate.digest(decontaminate.scan(d, b)).where("doc_id = 1").first()
    assert (r.n_items, r.items_sha256, r.contaminated) == (1, decontaminate.sha256_of(["7"]), True)


def test_clashing_names_text_ids_and_a_long_text(spark, way):
    long = " ".join(f"w{i % 900} x{i}" for i in range(60_000)) + " Alpha beta, gamma"
    rows = [("k", long, 1, 2, 3, 4, 5), ("l", "nothing", 1, 2, 3, 4, 5)]
    d = spark.createDataFrame(rows, "doc_id string, text string, row int, `__row` int, bad int, share int, found int")
    b = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    assert scanned(d, b) == brute_scan([r[:2] for r in rows], [("i", "alpha beta gamma")])
    dropped = decontaminate.drop_contaminated(d, b)
    assert dropped.columns == d.columns and [tuple(r) for r in dropped.collect()] == rows[1:]


def test_copies_and_a_frequent_word_are_a_third_of_all(spark, way, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 8)
    docs = [(i, "the same text the") for i in range(60)] + [(100 + i, f"the number {i} of the day") for i in range(60)] + [(300 + i, f"clean {i}") for i in range(60)]
    items = [(1, "the"), (2, "number 7 of the day"), (3, "same text")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_scan(docs, items)
    assert scanned(d, b) == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {k for k, v in want.items() if not v[1]}


def test_bytes_bound_the_broadcast(spark, monkeypatch):
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert decontaminate._prepared(d, b)[0] is not None
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 3)
    assert decontaminate._prepared(d, b)[0] is None


def test_clashing_hashes_lose_nothing(spark, monkeypatch):
    """By shuffle, where many shingles share a hash and most hashes pass the bitmap."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 16)
    docs, items = made(random.Random(7))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.item_windows(b)
    assert "sha2(" in decontaminate.scan_by_shuffle(d, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert scanned(d, b) == brute_scan(docs, items)


def test_the_bitmap_holds_every_hash(spark):
    keys = [0, 1, -1, 65_535, 65_536, 1 << 40, -(1 << 63), (1 << 63) - 1]
    bitmap = decontaminate._bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert decontaminate._maybe(bitmap, decontaminate.np.array(keys)).all()
    others = decontaminate.np.arange(100_000, 101_000)
    assert not decontaminate._maybe(bitmap, others).any()
    assert not decontaminate._maybe(decontaminate._bitmap(spark.createDataFrame([], "key long")), others).any()
