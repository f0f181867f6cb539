import re
import textwrap
from collections import Counter
from functools import lru_cache

import pytest

from tidewatch.llm import licenses


@lru_cache(maxsize=200)
def brute_grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return set(zip(ws, ws[1:]))


def brute(text, templates, least):
    """Every unit against every template, without any test beforehand."""
    units = (text or "").split("\n")
    counts = [len(licenses.normal_words(u)) for u in units]
    span = {i: (sum(counts[: i - 1]), sum(counts[:i])) for i in range(1, len(units) + 1)} | {0: (0, sum(counts))}
    found = []
    for i, unit in [(0, text or "")] * (len(units) > 1) + list(enumerate(units, 1)):
        a = brute_grams(unit)
        for k, t in sorted(templates.items()):
            b = brute_grams(t)
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= least:
                found.append((i, -1, k, round(2 * len(a & b) / (len(a) + len(b)), 9)))
    ws, plain = licenses.normal_words(text or ""), list(found)
    for k, t in sorted(templates.items()):
        b, m = brute_grams(t), len(licenses.normal_words(t))
        of = licenses.anchors(t, least)
        votes = Counter(max(0, i - of[x]) for i, x in enumerate(map(" ".join, zip(ws, ws[1:]))) if x in of)
        begins = []
        for i in sorted(votes, key=lambda s: (-votes[s], s)):
            if all(abs(i - j) >= m for j in begins):
                begins.append(i)
        for i in begins:
            a = set(zip(ws[i : i + m], ws[i + 1 : i + m]))
            value = round(2 * len(a & b) / (len(a) + len(b)), 9)
            beaten = any(f[2] == k and f[3] >= value and span[f[0]][0] < i + m and i < span[f[0]][1] for f in plain)
            if value >= least and not beaten:
                found.append((-1, i, k, value))
    return sorted(found)


def scanned(df, **kw):
    return {r.doc_id: sorted((f["unit"], f["at"], f["license"], round(f["dice"], 9)) for f in r.found) for r in licenses.scan(df, **kw).collect()}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_variants_against_brute_force(spark, least):
    t = licenses.TEMPLATES
    rows = [(0, None), (1, ""), (2, "one"), (3, "prose\nReleased under the MIT license!!\nmore"), (4, t["mit"]), (5, t["mit"].replace(". ", ".\n")), (6, t["bsd-3-clause"].upper()), (7, "word " * 50000), (8, "a\n" * 3000)]
    rows += [(10 + i, " ".join(x.split()[i % 3 :: 1])[: 40 + 37 * i]) for i, x in enumerate(t.values())]
    rows += [(50 + i, " ".join(w for j, w in enumerate(x.split()) if j % (5 + i))) for i, x in enumerate(t.values()) if len(x) < 3000]
    rows += [(90 + i, f"some words before. {x} and some behind it") for i, x in enumerate(t.values()) if len(x) < 200]
    rows += [(2, "one"), (None, t["isc"])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, found string").repartition(8)
    assert scanned(df, least=least) == {d: brute(x, t, least) for d, x in rows}


def wrapped(text, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(text, 76))


def test_licenses_where_they_stand(spark):
    """Headers wrapped above code, notices within prose, and whole license texts before and behind other text."""
    t = licenses.TEMPLATES
    code = "\n".join(f"def f{i}(x):\n    return x + {i}  # add {i} to the argument of the function" for i in range(200))
    short = [k for k in t if k not in licenses.WHOLE_TEXTS]
    rows = {k: f"{wrapped(t[k])}\n\n{code}" for k in short} | {f"{k} late": f"{code}\n{wrapped(t[k], ' * ')}\nend" for k in short}
    rows |= {f"{k} whole": f"NAME 1.0\n{t[k]}\n{code}" for k in licenses.WHOLE_TEXTS} | {"none": code, "prose": "The license of the software is under discussion and the copyright holders provide no warranty."}
    df = spark.createDataFrame(list(enumerate(rows.values())), "doc_id long, text string").repartition(8)
    names = list(rows)
    found = scanned(df)
    for i, k in enumerate(names):
        want = k.removesuffix(" late").removesuffix(" whole")
        assert (want in {f[2] for f in found[i]}) == (want in t), k
    for i, k in enumerate(names):
        if "whole" not in k:
            assert found[i] == brute(rows[k], t, 0.8)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "g", "h")], "doc_id long, text string, `__grams` string, near string")
    assert licenses.scan(df).columns == [*df.columns, "found"]


def test_matches_without_the_word_license(spark):
    """Truncated notices match at 0.8 although they don't name themselves."""
    rows = ["Released under the MIT", "This is free and unencumbered program released into the public domain.", "released under the", "so licensed", "soft"]
    found = scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert found[0] == [(1, -1, "mit-notice", round(6 / 7, 9))] and [f[2:] for f in found[1]] == [("unlicense-notice", 0.8)]
    assert found == {i: brute(x, licenses.TEMPLATES, 0.8) for i, x in enumerate(rows)}


def test_every_match_holds_a_sign():
    """Any part of a template's bigrams that is large enough for a match has one of its signs."""
    for t in licenses.TEMPLATES.values():
        g, signs = licenses.grams(t), licenses.signs(t, 0.8)
        without = [x for x in g if not signs & set(x.split(" "))]
        assert len(without) < licenses.needed(len(g), 0.8)


def test_every_copy_in_a_text_is_told(spark):
    t = licenses.TEMPLATES
    code = "\n".join(f"x{i} = {i}" for i in range(40))
    rows = [
        f"{wrapped(t['mit'])}\n{code}\n{wrapped(t['mit'], ' * ')}\n{code}\n{wrapped(t['isc'])}\n{t['mit']}",
        f"{t['mit-notice']} {code} {t['mit-notice']} and {t['mit-notice']}",
        f"{t['mit']}\n{code}\n{wrapped(t['mit'])}",
    ]
    found = scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert [len([f for f in found[i] if f[2] in ("mit", "mit-notice")]) for i in range(3)] == [3, 4, 2]  # the first notice of the second also makes its line match, less well
    assert found == {i: brute(x, t, 0.8) for i, x in enumerate(rows)}


def test_digest_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.digest(licenses.scan(df)).collect()}
    assert got == {1: (2, "cc-by-nc-4.0-notice,mit-notice", "cc-by-nc-4.0-notice", 1.0), 2: (0, "", None, None)}
    assert licenses.digest(licenses.scan(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.digest(licenses.scan(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
