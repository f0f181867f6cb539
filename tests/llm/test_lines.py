from collections import Counter, defaultdict

import pytest

from tidewatch.llm import lines


def brute_clean(docs):
    """docs: (id, host, text); id: (text, lines, dropped)."""
    pages, seen = Counter(h for _, h, _ in docs), defaultdict(Counter)
    for _, host, text in docs:
        seen[host].update({x for x in (text or "").split("\n") if x.strip(" ")})
    out = {}
    for doc, host, text in docs:
        if text is None:
            out[doc] = (None, 0, 0)
            continue
        parts = text.split("\n")
        stay = [x for x in parts if not x.strip(" ") or seen[host][x] < lines.MIN_PAGES or seen[host][x] <= lines.MAX_RATIO * pages[host]]
        out[doc] = ("\n".join(stay), len(parts), len(parts) - len(stay))
    return out


def cleaned(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(df, "source").collect()}


@pytest.mark.parametrize("short", [lines.SHORT, 0])
@pytest.mark.parametrize("bytes_", [lines.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, monkeypatch, bytes_, short):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(lines, "SHORT", short)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    want = brute_clean([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert cleaned(docs) == want
    assert any(d for _, _, d in want.values())


def test_edge_rows(spark):
    rows = [(i, "h", f"menu\nown {i}\n\nmenu", 1) for i in range(5)]
    rows += [(10, None, "menu\nx", 1), (11, None, "menu", 1), (12, None, "menu\n", 1), (13, "h", None, 1), (14, "h", "", 1), (15, "g", "menu", 1), (16, "h", "menu " * 40000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, host int")
    got = cleaned(docs)
    assert got == brute_clean([r[:3] for r in rows])
    assert got[0] == ("own 0\n", 4, 2) and got[11] == ("", 1, 1) and got[15] == ("menu", 1, 0) and got[13] == (None, 0, 0)
    assert lines.drop_boilerplate(docs, "source").columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.drop_boilerplate(docs.limit(0), "source").count() == 0
    again = docs.unionByName(docs.where("doc_id = 0"))
    assert lines.drop_boilerplate(again, "source").where("doc_id = 0").count() == 2


def test_clashing_names(spark):
    names = "host drop kept met share own copy shares pages line n_lines n_dropped __host __lines".split()
    rows = [(i, "h", f"menu\nown {i}", *[f"c{k}" for k in range(len(names))]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    done = lines.drop_boilerplate(docs, "source")
    assert sorted(done.columns) == sorted(docs.columns)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped, r.host, r["__lines"], r.met) for r in done.collect())[2] == (2, "own 2", 2, 1, "c0", "c13", "c3")
    same = lines.drop_boilerplate(docs, "source", counts=False)
    assert same.columns == docs.columns and {r.n_lines for r in same.collect()} == {"c10"}


@pytest.mark.parametrize("heavy", [3, 50])
def test_one_host_has_a_third_of_all_pages(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rows = [(i, "big" if i % 3 == 0 else None if i % 7 == 0 else f"h{i % 5}", f"menu {i % 2}\nown {i}\nfoot") for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, "big", None)], "doc_id long, source string, text string")
    assert cleaned(docs) == brute_clean([*rows, (500, "big", None)])
