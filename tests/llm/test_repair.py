import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from tidewatch.llm import repair

SF = "/root/testdata/sf0.01"
COLUMNS = [*repair.RESULTS, "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        conv, key_turn, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{key_turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if kind != 2 or c not in ".!?")
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, rs in out.items()}


def solve(rows):
    """The first of all scripts by cost, then audit, from a heap that holds them whole."""
    seen, items, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        blank = not body
        twice = not blank and (role, text) in seen
        cut = not blank and not twice and body[-1] not in ".!?"
        seen.add((role, text))
        counts = [n + x for n, x in zip(counts, (blank, twice, cut))]
        items.append((role, text, blank or twice, cut))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(items) and last in ("", "a"):
            return (*counts, cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        due = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, due, (*out, (FULL[due], ""))))
        if i < len(items):
            role, text, gone, cut = items[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if not gone:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, due, (*out, (FULL[due], text))))
                if role[:1] == due or (role[:1] == "s" and not last):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*out, (role, text))))


def brute(rows):
    out = {}
    for conv, kept in damage(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        blank, twice, cut, cost, audit, text = solve(kept)
        out[conv] = (gaps, blank, twice, cut, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS Codes").repartition(partitions)
    got = repair.digest(df).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def drawn(seed, conversations=150):
    """Nulls everywhere, unknown roles, gaps; a turn's role is there once, as texts of one turn and role have an order of their own."""
    rng, rows = random.Random(seed), {}
    for conv in range(conversations):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant", ""])
            text = rng.choice(["Hi.", "ok", "", "Yes!", "no?  ", "a b", None, "\u00a0"]) or None
            text = text if rng.random() < 0.5 else f"{turn}."
            place = turn if rng.random() < 0.95 else None
            rows[conv, place, role or " "] = (conv or None, place, role, text)
    return list(rows.values())


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = drawn(seed)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("chunk", "whole"), [(1, 3), (7, 20), (50, 120)])
def test_conversations_in_chunks(spark, monkeypatch, chunk, whole):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(repair, "WHOLE_ROWS", whole)
    rng = random.Random(chunk)
    hot = [(7, t, rng.choice(["user", "assistant", "system", "user"]), rng.choice(["Hi.", "ok", "", "Yes!", f"no {t}", f"a {t // 3}."])) for t in range(600)]
    rows = [r for r in drawn(9, 30) if r[0] != 7] + hot
    assert found(spark, rows) == brute(rows)


def test_the_tables_conversations(spark):
    rows = list(pd.read_parquet(f"{SF}/conversations.parquet").itertuples(index=False, name=None))
    assert found(spark, rows, 5) == brute(rows)


def test_rows_wholly_alike_and_dropped_ones(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    same = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "Hi.")] + [(same, 0, "user", "Hi.")] * 400
    got = found(spark, rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[same][2] == 399 and got == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_distances_against_relaxation():
    rng = random.Random(4)
    for _ in range(200):
        codes = "".join(rng.choices("suaxSUAXbd", k=rng.randint(0, 9)))
        behind = tuple(rng.randint(0, 6) if rng.random() < 0.7 else repair.NEVER for _ in range(3)) + (rng.randint(0, 6),)
        got = repair.distances(codes, behind)
        n, plain = len(codes), [repair.NEVER] * (4 * len(codes) + 4)
        plain[4 * n :] = behind
        for _ in range(len(plain)):
            for i in range(n, -1, -1):
                for s in range(4):
                    best = [plain[4 * i + s], 2 + plain[4 * i + repair.DUE[s]]]
                    if i < n:
                        best.append(3 + plain[4 * i + 4 + s])
                        more = codes[i].isupper()
                        if codes[i] not in "bd":
                            best.append(2 + more + plain[4 * i + 4 + repair.DUE[s]])
                            if s in repair.KEPT_FROM.get(codes[i].lower(), ()):
                                best.append(more + plain[4 * i + 4 + repair.STATE_OF[codes[i].lower()]])
                    plain[4 * i + s] = min(best)
        assert [min(x, repair.NEVER) for x in got] == [min(x, repair.NEVER) for x in plain]
