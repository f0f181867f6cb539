import random
from collections import defaultdict

import pytest
import xxhash

from tidewatch.llm import simhash
from tidewatch.operators import skew

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(id, fp)]; the smallest id that each reaches over links of at most two bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i][1] ^ prints[j][1]) & (2**64 - 1)).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least[find(i)], doc)
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "É x é y Z z", "a\x1cb c\x0bd e", "w " * 400])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    monkeypatch.setattr(simhash, "AT_ONCE", 37)
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = {doc: (f"{fp:016x}", c) for (doc, fp), c in zip(want, brute_components(want))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("pairs_up_to", [1, 8, 10**6])
def test_links_of_crowded_and_small_blocks(spark, pairs_up_to):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    signed = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), pairs_up_to=pairs_up_to)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components([(p, p) for p in signed])
    assert [roots.get(p, p) for p in signed] == want


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_edge_rows(spark):
    rows = [(3, "x y z", 1), (1, "X Y Z", 2), (None, "x y z", 3), (7, None, 4), (5, "", 5), (5, "", 5), (9, "p q r s t u v w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [("1", 1), ("3", 1), ("5", 5), ("5", 5), ("7", 5), ("9", 9), ("None", 1)]
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == ["1", "5", "9", "None"]
    assert simhash.keep_one(docs).columns == docs.columns == ["doc_id", "text", "fingerprint"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_different_texts_under_one_id_stay_apart(spark):
    one, two, far = "the quick brown fox jumps over it", "nothing here is like the other text at all", "seven wholly different words stand in here"
    rows = [(5, one), (5, two), (9, one), (9, two), (9, two), (7, far), (5, one)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, tie int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, one), (5, two), (7, far)])


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "X Y Z"), ("c", "other words here")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_one_text_is_a_third_of_all_rows(spark, monkeypatch):
    """The broadcast of heavy keys and the shuffled join of the others give one result."""
    rows = [(i, "copy of one text") for i in range(100)] + [(100 + i, f"word{i} other{i * i} third{i * 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for heavy in (1, 8, 4096):
        monkeypatch.setattr(skew, "HEAVY", heavy)
        got.append(sorted(map(tuple, simhash.near_duplicates(docs).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 300
    assert [r[2] for r in got[0][:100]] == [0] * 100
