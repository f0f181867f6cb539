"""Masked pseudo-likelihood scores from a bidirectional window network.

Each token is predicted from ``SIDE`` tokens on either side: their embeddings, one table for each place, are added and go through a
hidden layer to a softmax in three steps of ``FAN`` ways (a branch, a twig of the branch, a leaf of the twig, each given those before). A
document's score is the sum over its tokens of the log-probability of each, given both sides: its pseudo-log-likelihood.

Tokens are lower-cased words between ASCII blanks. The network has ``VOCAB`` ids: the most frequent words of all documents (by counts over all of them),
and ``RARE`` buckets by ending for the others. A word in a bucket gets the bucket's probability times its own share of the bucket's
occurrences, from the full counts: every counted word has a probability of its own, and all of them sum to one. Tasks know the counts of
the ``SHARED`` most frequent words; those of the others, which grow with the corpus, are joined to the words of the texts. As context, words of one bucket look alike.

Training reads every document once: each task runs mini-batch gradient steps over its partition from the same start, and the tasks'
changes are averaged: those of an embedding's row by how often each task met its word, all others by tokens. Tasks hand on their changes
in blocks, which are summed where they are dealt to, so nothing larger than the network is held anywhere or reaches the driver.

Defined results: null and empty texts have no tokens and score 0; repeated rows train and score each time; a word that wasn't counted is scored as one
met once; an empty table gives no rows. Words of one frequency get ids together or not at all. Other columns are ignored. Scores depend on how the input is split
into partitions, as local steps do (the README gives a figure); for the same files they repeat up to rounding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SIDE = 2
FAN = 28
VOCAB = FAN**3
RARE = 2048
ENDING = 3
HIDDEN = 16
BATCH = 8192
#: Steps of the output layers (Adam) and of embeddings' rows (Adagrad by row).
RATE = 0.01
ROW_RATE = 0.1
#: Distinct words a counting task holds before it hands on its counts.
COUNTED_AT_ONCE = 400_000
#: Words whose counts are broadcast, at most.
SHARED = 200_000
#: Levels of a doubling of frequency, by which the most frequent words are chosen.
LEVELS = 64
#: Text handled at a time, and parameters in a block.
TEXT_AT_ONCE = 4 << 20
BLOCK = 4096


class Words:
    """The words of a slice of texts: ``forms``, the distinct ones; ``codes``, the form of each word of all texts in a row; ``sizes`` by text."""

    def __init__(self, column: pa.Array):
        split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
        coded = split.flatten().dictionary_encode()
        codes, offsets = coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets)
        there = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
        self.forms, self.codes, self.sizes = coded.dictionary, codes[there], np.diff(ends)


def words(text: str | None) -> list[str]:
    of = Words(pa.array([text], type=pa.string()))
    return of.forms.take(pa.array(of.codes)).to_pylist()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` over all documents; counted in tasks before the shuffle."""

    def flush(counts: dict):
        kind = (pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip((counts.keys(), counts.values()), kind)], names=["word", "n"])

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, limit=TEXT_AT_ONCE):
                of, get = Words(part["text"]), counts.get
                for w, n in zip(of.forms.to_numpy(zero_copy_only=False).tolist(), np.bincount(of.codes, minlength=len(of.forms)).tolist()):
                    if n:
                        counts[w] = get(w, 0) + n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield flush(counts)
                    counts = {}
        yield flush(counts)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level() -> Column:
    return F.floor(F.log2("n") * LEVELS)


def bucket(word: str) -> int:
    return zlib.crc32(word[-ENDING:].encode()) % RARE


class Vocabulary:
    """Ids of words, each id's number of occurrences (one more than counted), logarithms of the ``shared`` words' counts, and the table of all
    other words' counts. ``size`` and ``share`` bound the ids and the shared words."""

    def __init__(self, docs: DataFrame, text_col: str = "text", size: int = VOCAB, share: int = SHARED):
        counted = written(word_counts(docs, text_col), "word-counts")
        levels = counted.groupBy(_level().alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
        total, least_id, least = 0, 1 << 62, 1 << 62
        for r in levels:
            total += r.k
            least_id = r.level if total <= size - RARE else least_id
            least = r.level if total <= share else least
        top = counted.where(_level() >= min(least, least_id)).orderBy(F.desc("n"), "word").toPandas()
        chosen = counted.where(_level() >= least_id).count()
        self.shared = {w: float(np.log(n)) for w, n in zip(top["word"], top["n"])}
        self.ids = {w: RARE + i for i, w in enumerate(top["word"][:chosen])}
        self.others = counted.where(_level() < min(least, least_id)).where("n > 1")  # a count of one adds nothing to a sum of logarithms
        ending = F.crc32(F.right("word", F.lit(ENDING)).cast("binary"))
        self.counts = np.ones(VOCAB)
        for r in counted.groupBy(F.pmod(ending, F.lit(RARE)).alias("id")).agg(F.sum("n").alias("n")).collect():
            self.counts[r.id] += r.n
        for w, n in zip(top["word"][:chosen], top["n"]):
            self.counts[bucket(w)] -= n
            self.counts[self.ids[w]] += n


def _found(forms: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each form among the known words, -1 where it is none."""
    return pc.fill_null(pc.index_in(forms, value_set=known), -1).to_numpy(zero_copy_only=False)


def read(of: Words, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each between ``SIDE`` marks (id ``VOCAB``), and the places of the words. ``known``: the words with ids, in order."""
    by_form = _found(of.forms, known) + RARE
    rare = by_form < RARE
    if rare.any():
        ending = pc.utf8_slice_codeunits(of.forms.filter(pa.array(rare)), -ENDING).dictionary_encode()
        buckets = np.array([bucket(e) for e in ending.dictionary.to_pylist()])
        by_form[rare] = buckets[ending.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(of.sizes)), of.sizes)
    at = np.arange(len(of.codes)) + SIDE * (text + 1)
    out = np.full(len(of.codes) + SIDE * (len(of.sizes) + 1), VOCAB, dtype=np.int32)
    if len(at):
        out[at] = by_form[of.codes]
    return out, at


def stretches(ids: np.ndarray):
    """(start, end) of consecutive places that are predicted together."""
    n = len(ids) - 2 * SIDE
    cuts = np.linspace(SIDE, SIDE + max(n, 0), max(1, -(-n // BATCH)) + 1).astype(int).tolist()
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct row numbers (below 2 ** 16), the sums of their ``values`` and how many there are of each."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    found = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[starts], np.add.reduceat(values[order], starts, axis=0), np.diff(np.append(starts, len(rows)))


#: How far output weights, the rows given to twigs and leaves, and biases may go, so that no sum of exponentials leaves float32.
_BOUNDS = {"branch": 2.8, "twig": 2.8, "leaf": 2.8, "of_branch": 0.7, "of_twig": 0.7}
_HIGHEST_BIAS = 5.0


class Network:
    """Parameters in float32, under their names."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: np.clip(rng.normal(size=shape) * 0.1, -0.5, 0.5).astype(np.float32)
        tree = counts.reshape(FAN, FAN, FAN)
        share = lambda n: np.log(n / n.sum(axis=-1, keepdims=True)).astype(np.float32)
        self.p = {
            "sides": normal(VOCAB + 1, 2 * SIDE * HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
            "branch": normal(HIDDEN, FAN), "branch_bias": share(tree.sum(axis=(1, 2))),
            "of_branch": normal(FAN, HIDDEN), "twig": normal(HIDDEN, FAN), "twig_bias": share(tree.sum(axis=2)),
            "of_twig": normal(FAN * FAN, HIDDEN), "leaf": normal(HIDDEN, FAN), "leaf_bias": share(tree).reshape(FAN * FAN, FAN),
        }

    def forward(self, ids: np.ndarray, a: int, b: int, keep: bool = True):
        """Log-probabilities of the tokens (not the marks) of ``ids[a:b]``, which has ``SIDE`` ids on either side, and with ``keep`` what
        the backward pass needs."""
        p, n = self.p, b - a
        near = p["sides"][ids[a - SIDE : b + SIDE]]
        x = np.tile(p["bias"], (n, 1))
        for i, to in enumerate(_SHIFTS):
            x += near[to : to + n, i * HIDDEN : (i + 1) * HIDDEN]
        there = ids[a:b] != VOCAB
        h = np.tanh(x, out=x)[there]
        twig, leaf = np.divmod(ids[a:b][there], FAN)
        branch = twig // FAN
        h2, h3 = h + p["of_branch"][branch], h + p["of_twig"][twig]
        layers = ((h @ p["branch"] + p["branch_bias"], branch), (h2 @ p["twig"] + p["twig_bias"][branch], twig % FAN), (h3 @ p["leaf"] + p["leaf_bias"][twig], leaf))
        logp, row, ones = np.zeros(len(h), x.dtype), np.arange(len(h)) * FAN, np.ones((FAN, 1), x.dtype)
        for z, y in layers:
            logp += z.ravel()[row + y]
            np.exp(z, out=z)
            total = z @ ones
            logp -= np.log(total[:, 0])
            if keep:
                z /= total
        return logp, (there, (h, h2, h3), (branch, twig), layers)

    def gradients(self, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log-probability, for ascent: those of the dense parameters, and of the sum of embeddings at each place."""
        there, (h, h2, h3), (branch, twig), layers = kept
        p, row = self.p, np.arange(len(h)) * FAN
        for z, y in layers:
            z.ravel()[row + y] -= 1
            z *= -1 / len(h)
        one, two, three = (z for z, _ in layers)
        d2, d3 = two @ p["twig"].T, three @ p["leaf"].T
        dx = np.zeros((len(there), HIDDEN), h.dtype)
        dx[there] = (one @ p["branch"].T + d2 + d3) * (1 - h * h)
        of_branch = np.zeros((FAN, len(h)), h.dtype)
        of_branch[branch, np.arange(len(h))] = 1
        by_twig = np.zeros((FAN * FAN, HIDDEN + FAN), h.dtype)
        at, sums, _ = _sums(twig, np.concatenate([d3, three], axis=1))
        by_twig[at] = sums
        dense = {
            "bias": dx.sum(axis=0), "branch": h.T @ one, "branch_bias": one.sum(axis=0),
            "of_branch": of_branch @ d2, "twig": h2.T @ two, "twig_bias": of_branch @ two,
            "of_twig": by_twig[:, :HIDDEN], "leaf": h3.T @ three, "leaf_bias": by_twig[:, HIDDEN:],
        }
        return dense, dx


#: Where the neighbours' embeddings of a stretch begin, counted from ``SIDE`` ids before it.
_SHIFTS = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]


def spread(dx: np.ndarray) -> np.ndarray:
    """Gradients at the places of a stretch, and ``SIDE`` to either side, of the embeddings that they stand with."""
    out = np.zeros((len(dx) + 2 * SIDE, 2 * SIDE * HIDDEN), dx.dtype)
    for i, to in enumerate(_SHIFTS):
        out[to : to + len(dx), i * HIDDEN : (i + 1) * HIDDEN] = dx
    return out


class Trainer:
    """Mini-batch steps: Adam for the dense parameters, Adagrad with one rate a row for embeddings."""

    def __init__(self, net: Network):
        self.net, self.step, self.seen = net, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k != "sides"}
        self.squares, self.uses = (np.zeros(VOCAB + 1, np.float32) for _ in range(2))

    def fit(self, ids: np.ndarray) -> None:
        for a, b in stretches(ids):
            logp, kept = self.net.forward(ids, a, b)
            if not len(logp):
                continue
            dense, dx = self.net.gradients(kept)
            self.step += 1
            self.seen += len(logp)
            scale = RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            for k, g in dense.items():
                m, v = self.moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p = self.net.p[k]
                p += (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                if k in _BOUNDS:
                    np.clip(p, -_BOUNDS[k], _BOUNDS[k], out=p)
                elif k.endswith("_bias"):
                    np.minimum(p, _HIGHEST_BIAS, out=p)
            row, g, n = _sums(ids[a - SIDE : b + SIDE], spread(dx))
            self.squares[row] += np.einsum("ij,ij->i", g, g) / g.shape[1]
            self.net.p["sides"][row] += g * (ROW_RATE / (np.sqrt(self.squares[row]) + 1e-8))[:, None]
            self.uses[row] += n


def _blocks(p: dict[str, np.ndarray]):
    """(parameter, first row, end row) of each block, in a fixed order."""
    for k, v in p.items():
        rows = v.reshape(len(v), -1)
        step = max(1, BLOCK // rows.shape[1])
        yield from ((k, a, min(a + step, len(rows))) for a in range(0, len(rows), step))


def _changes(start: Network, trainer: Trainer):
    """Number, weight of each row and weighted change of each block that has changed, as a batch."""
    found: tuple[list, list, list] = ([], [], [])
    for i, (k, a, b) in enumerate(_blocks(start.p)):
        weight = trainer.uses[a:b] if k == "sides" else np.full(b - a, trainer.seen, np.float32)
        if weight.any():
            change = (trainer.net.p[k][a:b] - start.p[k][a:b]).reshape(b - a, -1) * weight[:, None]
            for out, x in zip(found, (i, weight, change.ravel())):
                out.append(x)
    floats = pa.list_(pa.float32())
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(found, (pa.int32(), floats, floats))], names=["block", "weight", "change"])


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> Network:
    """One pass over all documents; the average of the tasks' networks."""
    shared = docs.sparkSession.sparkContext.broadcast((list(vocab.ids), vocab.counts))
    schema = "block int, weight array<float>, change array<float>"

    def run(batches):
        words, counts = shared.value
        known, trainer = pa.array(words, type=pa.string()), Trainer(Network(counts))
        for batch in batches:
            for part in slices(batch, limit=TEXT_AT_ONCE):
                trainer.fit(read(Words(part["text"]), known)[0])
        if trainer.seen:
            yield _changes(Network(counts), trainer)

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                parts = [batch[c][i].values.to_numpy().astype(np.float64) for c in ("weight", "change")]
                sums[block] = [a + b for a, b in zip(sums[block], parts)] if block in sums else parts
        floats = pa.list_(pa.float32())
        columns = [list(sums), [w for w, _ in sums.values()], [c for _, c in sums.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int32(), floats, floats))], names=["block", "weight", "change"])

    start = Network(vocab.counts)
    places = list(_blocks(start.p))
    changed = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema)
    found = changed.repartition("block").mapInArrow(add, schema).toArrow()
    for block, *parts in zip(found["block"].to_pylist(), found["weight"], found["change"]):
        weight, change = (x.values.to_numpy() for x in parts)
        k, a, b = places[block]
        mean = change.reshape(b - a, -1) / np.maximum(weight, 1e-9)[:, None]
        start.p[k][a:b] += mean.reshape(start.p[k][a:b].shape)
    return start


def _occurrences(said: pa.Array, at: np.ndarray, n: int) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
    """Each distinct word of ``said`` with the rows ``at`` (below ``n``) that hold it and how often each does."""
    coded = said.dictionary_encode()
    keys, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + at, return_counts=True)
    word, row = np.divmod(keys, max(n, 1))
    offsets = pa.array(np.searchsorted(word, np.arange(len(coded.dictionary) + 1)).astype(np.int32))
    return coded.dictionary, *(pa.ListArray.from_arrays(offsets, pa.array(x, type=pa.int64())) for x in (row, times))


def score(docs: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``pll`` (natural logarithm) and ``pll_per_token`` of each row."""
    totals = np.log(np.maximum(vocab.counts[:RARE] - 1, 1))
    shared = docs.sparkSession.sparkContext.broadcast((list(vocab.ids), list(vocab.shared), np.array([*vocab.shared.values(), np.nan]), net, totals))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = {"row": "bigint", "n_tokens": "bigint", "pll": "double", "word": "string", "rows": "array<bigint>", "times": "array<bigint>"}
    schema = chosen.select("doc_id", *(F.lit(None).cast(kind).alias(k) for k, kind in kinds.items())).schema
    schema["doc_id"].nullable = True

    def scored(batch):
        """A line for each row, then one for each word whose count the task doesn't know, with the rows of this slice that hold it."""
        known, counted, logs, network, rare_logs = held[0]
        of = Words(batch["text"])
        ids, at = read(of, known)
        logp = [network.forward(ids, a, b, keep=False)[0] for a, b in stretches(ids)]
        logp = np.concatenate(logp).astype(np.float64) if logp else np.zeros(0)
        rare = ids[at] < RARE
        own = logs[_found(of.forms, counted)][of.codes[rare]]  # not a number: asked for by the line below
        logp[rare] += np.nan_to_num(own) - rare_logs[ids[at][rare]]
        asked = rare.copy()
        asked[rare] = np.isnan(own)
        sums = np.concatenate([[0.0], np.cumsum(logp)])
        ends = np.concatenate([[0], np.cumsum(of.sizes)])
        pll = sums[ends[1:]] - sums[ends[:-1]]
        word, rows, times = _occurrences(of.forms.take(pa.array(of.codes[asked])), np.repeat(np.arange(len(of.sizes)), of.sizes)[asked], len(of.sizes))
        rows = pa.ListArray.from_arrays(rows.offsets, batch["row"].take(rows.values))
        n, m = len(of.sizes), len(word)
        one = [batch["doc_id"], batch["row"], pa.array(of.sizes.astype(np.int64)), pa.array(pll), *(pa.nulls(n, x.type) for x in (word, rows, times))]
        two = [*(pa.nulls(m, x.type) for x in one[:4]), word, rows, times]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(one, two)], names=schema.names)

    held: list = []

    def run(batches):
        known, counted, *rest = shared.value
        held[:] = [(pa.array(known, type=pa.string()), pa.array(counted, type=pa.string()), *rest)]
        for batch in batches:
            for part in slices(batch, limit=TEXT_AT_ONCE):
                yield scored(part)

    both = written(chosen.mapInArrow(run, schema), "lm-scores")
    met = both.where("word IS NOT NULL").join(vocab.others, "word").select(F.log("n").alias("log_n"), F.explode(F.arrays_zip("rows", "times")).alias("x"))
    own = met.groupBy(F.col("x.rows").alias("row")).agg(F.sum(F.col("x.times") * F.col("log_n")).alias("own"))
    done = both.where("word IS NULL").join(own, "row", "left").withColumn("pll", F.col("pll") + F.coalesce("own", F.lit(0.0)))
    return done.select("doc_id", "n_tokens", "pll", (F.col("pll") / F.greatest("n_tokens", F.lit(1))).alias("pll_per_token"))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, trains on and scores all documents."""
    vocab = Vocabulary(docs, text_col)
    return score(docs, vocab, train(docs, vocab, text_col), id_col, text_col)
