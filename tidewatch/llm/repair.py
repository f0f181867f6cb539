"""Conversation structure repair by shortest paths over small integer costs, with the edits that reach it as an audit.

A conversation's rows, in order of turns, are repaired so that the roles' initials read ``(s?(ua)+)?``: K keeps a row (0), R gives it the role
that is due (2), D deletes it (3; blank and duplicate rows must go), I puts an empty text of the role that is due anywhere (2); a truncated row
that stays costs 1 more. Nodes are (rows read, what the last kept initial was); distances to the end come from Dial's bucket queue, whose buckets are
the integer distances; the audit is the walk along tight arcs that takes the least letter each time, which is the least of all cheapest
audits, as a letter leads from a node to one node only.

Rows are dealt by ranges of conversation and turn, so a conversation of any length lies in order over as many tasks as it fills. One that lies in one
task whole, and isn't large, is repaired there. The others become chunks of bounded size: duplicates are found by the first
place of each role and text over all chunks (its places are one row a chunk, then one row in all); each chunk becomes the matrix of its distances between states;
the matrices of a conversation, a few numbers a chunk, are walked from its end to give distances behind each chunk; with these, chunks walk
their arcs from each state, all at once; and one walk from the beginning strings the walks together and hashes the repaired text as it goes by.

Defined results: nulls in any column count as one space (as a role it is none of the three, as a text blank); rows of one turn follow
one another by role, then by the text's hash and the text; rows that are wholly alike are told apart by nothing, the later ones are duplicates.
Null turns come first. Null conversation ids are one conversation. Turns are whole numbers. A conversation without rows after damage has zeros, an empty audit and
the hash of the empty string. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import written

#: Characters of a conversation, and its rows, that a task holds before it is cut to chunks; characters and rows of a chunk.
WHOLE_CHARS, WHOLE_ROWS = 4 << 20, 20_000
CHUNK_CHARS, CHUNK_ROWS = 32 << 10, 512

#: States: nothing yet, system, user, assistant. ``DUE`` is the state behind an inserted or renamed row, which has that state's role.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
#: States from which a row of each initial may be kept.
KEPT_FROM = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEEP, INSERT, RENAME, DELETE, TRUNCATED = 0, 2, 2, 3, 1
NEVER = 1 << 40
#: Distances behind the last row: a repaired conversation is empty or ends with the assistant.
DONE = (0, NEVER, NEVER, 0)
_BLANKS = " \t\n\v\f\r"


def code(role: str, text: str, seen: bool) -> str:
    """A row as a letter: ``b`` blank, ``d`` duplicate, else its initial (``x`` for a role without a place), in upper case if it is truncated."""
    body = text.rstrip(_BLANKS)
    if not body:
        return "b"
    if seen:
        return "d"
    initial = role[:1] if role[:1] in STATE_OF else "x"
    return initial if body[-1] in ".!?" else initial.upper()


def distances(codes: str, behind: tuple[int, ...] = DONE) -> list[int]:
    """The least cost from each node, 4 * rows read + state, to the end, where each state has a cost ``behind`` it: Dial's algorithm from
    the end, against the arcs."""
    n = len(codes)
    dist = [NEVER] * (4 * n + 4)
    least = min(behind)
    buckets: list[list[int]] = [[] for _ in range(max(b for b in behind if b < NEVER) - least + DELETE * n + 3 * INSERT + 1)]
    for state, cost in enumerate(behind):
        if cost < NEVER:
            buckets[cost - least].append(4 * n + state)
            dist[4 * n + state] = cost - least
    sources = tuple(tuple(q for q in range(4) if DUE[q] == state) for state in range(4))
    for d, bucket in enumerate(buckets):
        for node in bucket:  # grows by nothing: every arc costs something but keeping, and that leads to this bucket's end
            if dist[node] != d:
                continue
            i, state = divmod(node, 4)
            arcs = [(4 * i + q, INSERT) for q in sources[state]]
            if i:
                c, before = codes[i - 1], 4 * i - 4
                arcs.append((before + state, DELETE))
                if c not in "bd":
                    more = TRUNCATED if c.isupper() else 0
                    arcs += [(before + q, RENAME + more) for q in sources[state]]
                    c = c.lower()
                    if STATE_OF.get(c) == state:
                        arcs += [(before + q, KEEP + more) for q in KEPT_FROM[c]]
            for to, cost in arcs:
                if d + cost < dist[to]:
                    dist[to] = d + cost
                    buckets[d + cost].append(to)
    return [x + least if x < NEVER else x for x in dist]


def walk(codes: str, dist: list[int], behind: tuple[int, ...] = DONE, state: int = START) -> tuple[str, int]:
    """The least of the cheapest audits from a state before the first row, and the state behind the last row."""
    out, i, n = [], 0, len(codes)
    while i < n or dist[4 * i + state] != behind[state]:
        now, due = dist[4 * i + state], DUE[state]
        c = codes[i] if i < n else ""
        more = TRUNCATED if c.isupper() else 0
        if c and now == DELETE + dist[4 * i + 4 + state]:
            out.append("D")
            i += 1
        elif now == INSERT + dist[4 * i + due]:
            out.append("I")
            state = due
        elif c not in "bd" and state in KEPT_FROM.get(c.lower(), ()) and now == KEEP + more + dist[4 * i + 4 + STATE_OF[c.lower()]]:
            out.append("K")
            i, state = i + 1, STATE_OF[c.lower()]
        else:
            out.append("R")
            i, state = i + 1, due
    return "".join(out), state


@lru_cache(maxsize=1 << 16)
def _whole(codes: str) -> tuple[int, str]:
    dist = distances(codes)
    return dist[START], walk(codes, dist)[0]


def repaired(audit: str, roles: list[str], texts: list[str], state: int = START) -> Iterator[tuple[str, str]]:
    """The rows that an audit leaves, as (role, text)."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = DUE[state]
            yield ROLES[state], ""
            continue
        if letter == "R":
            state = DUE[state]
            yield ROLES[state], texts[at]
        elif letter == "K":
            state = STATE_OF[roles[at][0]]
            yield roles[at], texts[at]
        at += 1


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``times`` (0 for a dropped row, 2 for a repeated one)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    chosen = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))

    def when(k: int, value: Column, otherwise: str) -> Column:
        return F.when(F.col("kind") == k, value).otherwise(F.col(otherwise))

    emptied = F.when(F.col("kind").isin(0, 1), F.lit("")).otherwise(when(2, F.translate("text", ".!?", ""), "text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return chosen.select("conv_id", "turn", when(4, F.lit("user"), "role").alias("role"), emptied.alias("text"), times.alias("times"))


class _Turns:
    """Least, greatest and number of different turns of rows in order."""

    def __init__(self):
        self.least = self.last = None
        self.different = 0

    def add(self, least, last, different: int) -> None:
        if least is not None:
            self.different += different - (self.last == least)
            self.least, self.last = least if self.least is None else self.least, last

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.last - self.least + 1 - self.different


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT_KINDS = ", ".join(f"{c} long" for c in RESULTS) + ", audit string, repaired_sha256 string"
_CHUNK_KINDS = "roles array<string>, texts array<string>, least long, last long, different long"


def summary(roles: list[str], texts: list[str], turns: list[int | None]) -> dict:
    """The result of one whole conversation, rows in order."""
    seen: set[tuple[str, str]] = set()
    codes = []
    for key in zip(roles, texts):
        codes.append(code(*key, key in seen))
        seen.add(key)
    codes, known = "".join(codes), [t for t in turns if t is not None]
    cost, audit = _whole(codes) if len(codes) < 64 else _whole.__wrapped__(codes)
    body = "\n".join(f"{r}:{t}" for r, t in repaired(audit, roles, texts))
    span = _Turns()
    span.add(known[0] if known else None, known[-1] if known else None, len(set(known)))
    return {
        "gaps": span.gaps, "blank": codes.count("b"), "duplicate": codes.count("d"), "truncated": sum(map(str.isupper, codes)), "illegal": _illegal([r[:1] for r in roles]),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(body.encode()).hexdigest(),
    }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _shape(rows: DataFrame, kinds: str) -> StructType:
    """``conv_id`` as in ``rows``, and columns that may be null."""
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(kinds).fields])


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole conversations as results; of the others, chunks in order (``part``, ``chunk``) with ``keys``, each once a chunk, and their first ``places``."""
    ordered = rows.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("conv_id", "turn", "role", "tie").sortWithinPartitions("conv_id", "turn", "role", "tie", "text")
    shape = _shape(rows, f"{_RESULT_KINDS}, part int, chunk int, keys array<binary>, places array<int>, {_CHUNK_KINDS}")
    arrow = to_arrow_schema(shape)

    def run(batches):
        part, chunk, out, held = TaskContext.get().partitionId(), 0, [], 0
        now, first, large = object(), True, False
        buffer: list[tuple] = []
        chars = 0

        def as_chunks():
            nonlocal chunk, chars
            at = 0
            while at < len(buffer) or not at:
                size, to = 0, at
                while to < len(buffer) and to - at < CHUNK_ROWS and (to == at or size < CHUNK_CHARS):
                    size += len(buffer[to][2])
                    to += 1
                piece = buffer[at:to]
                places: dict[bytes, int] = {}
                for i, (_, role, text) in enumerate(piece):
                    places.setdefault(_key(role, text), i)
                known = [t for t, _, _ in piece if t is not None]
                out.append({
                    "conv_id": now, "part": part, "chunk": chunk, "roles": [r for _, r, _ in piece], "texts": [t for _, _, t in piece],
                    "keys": list(places), "places": list(places.values()),
                    "least": known[0] if known else None, "last": known[-1] if known else None, "different": len(set(known)),
                })
                chunk, at = chunk + 1, max(to, 1)
            buffer.clear()
            chars = 0

        def end(last: bool):
            nonlocal first, large, chars
            if first or last or large:
                if buffer or not large:
                    as_chunks()
            else:
                turns, roles, texts = (list(x) for x in zip(*buffer)) if buffer else ([], [], [])
                out.append({"conv_id": now} | summary(roles, texts, turns))
                buffer.clear()
                chars = 0
            first = large = False

        begun = False
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times")]
            for conv, turn, role, text, times in zip(*columns):
                if not begun or conv != now:
                    if begun:
                        end(False)
                    now, begun = conv, True
                buffer += [(turn, role, text)] * times
                chars += len(text) * times
                if chars > WHOLE_CHARS or len(buffer) > WHOLE_ROWS:
                    large = True
                    held += chars
                    as_chunks()
                if len(out) >= 1000 or held > 8 << 20:
                    yield _batch(out, arrow)
                    out, held = [], 0
        if begun:
            end(True)
        if out:
            yield _batch(out, arrow)

    return ordered.mapInArrow(run, shape)


def _mapped(df: DataFrame, fn: Callable[[dict], dict], shape: StructType) -> DataFrame:
    """``fn`` on each row."""
    arrow = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield _batch([fn(row) for row in batch.slice(at, 64).to_pylist()], arrow)

    return df.mapInArrow(run, shape)


def _folded(df: DataFrame, make: Callable[[], Callable], shape: StructType, backward: bool = False) -> DataFrame:
    """A conversation's chunks in order through ``make()``'s step, which gives a row or None; ``step(None)`` follows the last."""
    arrow = to_arrow_schema(shape)
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in ("part", "chunk")]
    ordered = df.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", *order)

    def run(batches):
        step, now = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    if step is None or row["conv_id"] != now:
                        out.append(step and step(None))
                        now, step = row["conv_id"], make()
                    out.append(step(row))
                yield _batch([x for x in out if x], arrow)
        if step and (row := step(None)):
            yield _batch([row], arrow)

    return ordered.mapInArrow(run, shape)


def _mark(row: dict) -> dict:
    """A chunk's codes, and its distances from each state before it to each state behind it."""
    firsts = set(row.pop("firsts") or ())
    codes = "".join(code(r, t, i not in firsts) for i, (r, t) in enumerate(zip(row["roles"], row["texts"])))
    columns = [distances(codes, tuple(0 if s == t else NEVER for s in range(4))) for t in range(4)]
    return row | {"codes": codes, "matrix": [columns[t][s] for s in range(4) for t in range(4)]}


def _behind():
    """Backward over a conversation's chunks: the least cost to its end from each state behind a chunk."""
    now = DONE

    def step(row):
        nonlocal now
        if row is None:
            return None
        m, here = row["matrix"], now
        now = tuple(min(NEVER, *(m[4 * s + t] + here[t] for t in range(4))) for s in range(4))
        return {"part": row["part"], "chunk": row["chunk"], "behind": list(here)}

    return step


def _walked(row: dict) -> dict:
    """A chunk's walks from each of the states: audits, what they cost, and the states behind them."""
    behind = tuple(row.pop("behind"))
    dist = distances(row["codes"], behind)
    walks = [walk(row["codes"], dist, behind, s) if dist[s] < NEVER else ("", s) for s in range(4)]
    return row | {"audits": [a for a, _ in walks], "ends": [e for _, e in walks], "costs": [dist[s] - behind[e] if dist[s] < NEVER else 0 for s, (_, e) in enumerate(walks)]}


def _strung():
    """Forward over a conversation's chunks: its result."""
    total = dict.fromkeys(RESULTS, 0)
    sha, audit, turns, state = hashlib.sha256(), [], _Turns(), START
    last, begun, conv = "", False, None

    def step(row):
        nonlocal state, last, begun, conv
        if row is None:
            return {"conv_id": conv} | total | {"gaps": turns.gaps, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        conv, codes, letters = row["conv_id"], row["codes"], row["audits"][state]
        total["blank"] += codes.count("b")
        total["duplicate"] += codes.count("d")
        total["truncated"] += sum(map(str.isupper, codes))
        total["cost"] += row["costs"][state]
        if row["roles"]:
            initials = [r[:1] for r in row["roles"]]
            total["illegal"] += _illegal(initials if last == "" else [last, *initials])
            last = initials[-1] or "\0"
        turns.add(row["least"], row["last"], row["different"])
        for r, t in repaired(letters, row["roles"], row["texts"], state):
            sha.update(f"{chr(10) if begun else ''}{r}:{t}".encode())
            begun = True
        audit.append(letters)
        state = row["ends"][state]

    return step


def repair(rows: DataFrame) -> DataFrame:
    """The result of each conversation of rows as :func:`damaged` gives them."""
    made = written(_dealt(rows), "repair")
    results = made.where("part IS NULL").select("conv_id", *RESULTS, "audit", "repaired_sha256")
    chunks = made.where("part IS NOT NULL").drop(*RESULTS, "audit", "repaired_sha256")

    each = chunks.select("conv_id", "part", "chunk", F.explode(F.arrays_zip("keys", "places")).alias("x"))
    first = each.groupBy("conv_id", F.col("x.keys").alias("key")).agg(F.min(F.struct("part", "chunk", F.col("x.places").alias("place"))).alias("first"))
    firsts = first.groupBy("first.part", "first.chunk").agg(F.collect_list("first.place").alias("firsts"))
    kept = ("conv_id", "part", "chunk", "roles", "texts", "least", "last", "different")
    base = f"part int, chunk int, {_CHUNK_KINDS}, codes string"
    joined = chunks.select(*kept).join(firsts, ["part", "chunk"], "left").select(*kept, "firsts")
    marked = written(_mapped(joined, _mark, _shape(rows, f"{base}, matrix array<long>")), "repair-marked")

    matrices = marked.select("conv_id", "part", "chunk", "matrix")
    behind = _folded(matrices, _behind, StructType.fromDDL("part int, chunk int, behind array<long>"), backward=True)
    told = marked.drop("matrix").join(behind, ["part", "chunk"]).select(*kept, "codes", "behind")
    walked = _mapped(told, _walked, _shape(rows, f"{base}, audits array<string>, ends array<int>, costs array<long>"))
    return results.unionByName(_folded(walked, _strung, _shape(rows, _RESULT_KINDS)))


def digest(conversations: DataFrame) -> DataFrame:
    """Damages and repairs: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``."""
    return repair(damaged(conversations))
