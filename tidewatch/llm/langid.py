"""Language ID of code-switched text by a linear-chain conditional random field.

Every word gets a label (a language). A word's score for a language is the sum of the weights of its affixes, character n-grams and
its entry in the lexicon; a learned matrix scores the change from one word's language to the next one's. Forward-backward gives each
word's posterior; a document's language is the one with the greatest mean posterior over its words, and that mean is its score.

Training: the weights are fitted by gradient ascent on the conditional log-likelihood of at most ``SAMPLE_ROWS`` labelled documents,
chosen by a hash of their ids, each giving ``ROW_WORDS`` words in a row from a stretch of ``ROW_CHARS`` characters at a hashed place, so
that what reaches the driver is bounded whatever the texts' lengths. Their stretches are joined
across languages into code-switched sequences with known labels, from which the transitions are learned.

Inference covers whole texts: words are read in blocks, each block's product of transition and word scores is formed, blocks are
linked along the text in order, and the posteriors inside each block follow. Memory is bounded by the slice of text in hand.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn from; ties
go to the language that sorts first. Repeated rows count as they stand. Other columns are ignored by :func:`predict`, kept by
:func:`accept`.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_slices, only, texts

UNDETERMINED = "und"
SAMPLE_ROWS = 4_000
ROW_CHARS = 2_000
ROW_WORDS = 60
SEQUENCES = 3_000
STEPS = 40
LEXICON_LEAST = 8
FEATURE_LEAST = 3
BLOCK = 32
#: A document is accepted with at least this share of its words' posterior.
LEAST_SCORE = 0.35

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """Affixes of up to three letters and character n-grams of two and three of the whole word, ends marked; the lexicon entry is the
    word itself."""
    w = f"<{word}>"
    out = [f"={word}", f"p{word[:1]}", f"p{word[:2]}", f"p{word[:3]}", f"s{word[-1:]}", f"s{word[-2:]}", f"s{word[-3:]}"]
    out += [w[i : i + 2] for i in range(len(w) - 1)]
    out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray  # feature (the last: bias) x language
    transition: np.ndarray  # log scores, from x to

    def emissions(self, found: list[str]) -> np.ndarray:
        """Words x languages; no letter gives NaN."""
        get, rows, ends = self.index.get, [], []
        bias = len(self.weights) - 1
        for w in found:
            rows.append(bias)
            rows += [i for f in features(w) if (i := get(f)) is not None]
            ends.append(len(rows))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if found else np.zeros(0, np.int64)
        out = np.add.reduceat(self.weights[rows], starts, axis=0) if found else np.zeros((0, len(self.languages)))
        out[[not any(map(str.isalpha, w)) for w in found]] = np.nan
        return out


def _forward_backward(scores: np.ndarray, real: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Posteriors of rows of words: ``scores`` [time, row, language] (exponentials), ``real`` [time, row], prior and final vectors."""
    steps, n, k = scores.shape
    ahead, log_z = np.empty((steps, n, k)), np.zeros(n)
    a = first
    for t in range(steps):
        b = (a @ trans) * scores[t]
        total = b.sum(axis=1, keepdims=True)
        a = np.where(real[t][:, None], b / total, a)
        log_z += np.where(real[t], np.log(total[:, 0]), 0)
        ahead[t] = a
    behind = np.empty((steps, n, k))
    b = last
    for t in range(steps - 1, -1, -1):
        behind[t] = b
        c = (b * scores[t]) @ trans.T
        b = np.where(real[t][:, None], c / c.sum(axis=1, keepdims=True), b)
    post = ahead * behind
    return post / post.sum(axis=2, keepdims=True), ahead, behind, log_z


def posterior_sums(model: Model, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of posteriors over each document's words; ``emissions`` are the words' of all documents in a row."""
    k, trans = len(model.languages), np.exp(model.transition)
    counts = -(-sizes // BLOCK)
    n = int(counts.sum())
    sums = np.zeros((len(sizes), k))
    if not n:
        return sums
    # words dealt to blocks [time, block]
    block_doc = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)  # a block's place in its document
    start = (np.cumsum(sizes) - sizes)[block_doc] + place * BLOCK
    at = start[None, :] + np.arange(BLOCK)[:, None]
    real = at < (np.cumsum(sizes))[block_doc][None, :]
    scores = np.exp(emissions - emissions.max(axis=1, keepdims=True))[np.where(real, at, 0)]
    # each block's product
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(BLOCK):
        step = (product.reshape(-1, k) @ trans).reshape(n, k, k) * scores[t][:, None, :]
        product = np.where(real[t][:, None, None], step / step.sum(axis=(1, 2), keepdims=True), product)
    # blocks linked along each document, all documents together
    first, last = np.full((n, k), 1.0 / k), np.ones((n, k))
    order = np.argsort(place, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
    for level in levels[1:]:
        v = np.einsum("ni,nij->nj", first[level - 1], product[level - 1])
        first[level] = v / v.sum(axis=1, keepdims=True)
    for level in levels[:0:-1]:
        v = np.einsum("nij,nj->ni", product[level], last[level])
        last[level - 1] = v / v.sum(axis=1, keepdims=True)
    post, *_ = _forward_backward(scores, real, trans, first, last)
    by_block = np.where(real[:, :, None], post, 0).sum(axis=0)
    np.add.at(sums, block_doc, by_block)
    return sums


def _sequences(samples: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Code-switched training sequences: stretches of one to three samples in a row."""
    out = []
    for _ in range(min(SEQUENCES, 4 * len(samples))):
        found, labels = [], []
        for i in rng.integers(len(samples), size=rng.integers(1, 4)).tolist():
            ws, label = samples[i]
            n = int(rng.integers(3, 21))
            at = int(rng.integers(max(1, len(ws) - n + 1)))
            found += ws[at : at + n]
            labels += [label] * len(ws[at : at + n])
        out.append((found, labels))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from (text, language) rows; None if no row has a word."""
    languages = sorted({lang for _, lang in rows})
    samples = []
    rng = np.random.default_rng(seed)
    for text, lang in sorted(rows):
        ws = [w for w in words(text) if any(map(str.isalpha, w))]
        if len(text) >= ROW_CHARS:
            ws = ws[1:-1]  # the ends may be cut
        if ws:
            at = int(rng.integers(max(1, len(ws) - ROW_WORDS + 1)))
            samples.append((ws[at : at + ROW_WORDS], languages.index(lang)))
    if not samples:
        return None
    counts: dict[str, int] = {}
    for ws, _ in samples:
        for w in ws:
            for f in features(w):
                counts[f] = counts.get(f, 0) + 1
    kept = sorted(f for f, n in counts.items() if n >= (LEXICON_LEAST if f[0] == "=" else FEATURE_LEAST))
    index = {f: i for i, f in enumerate(kept)}
    k = len(languages)
    sequences = _sequences(samples, rng)
    vocab = sorted({w for ws, _ in sequences for w in ws})
    of = {w: i for i, w in enumerate(vocab)}
    pairs = [(i, j) for i, w in enumerate(vocab) for j in [len(kept), *(index[f] for f in features(w) if f in index)]]
    word_at, feature_at = np.array(pairs, dtype=np.int64).T
    steps, n = max(len(ws) for ws, _ in sequences), len(sequences)
    ids, gold, real = np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64), np.zeros((steps, n), bool)
    for j, (ws, labels) in enumerate(sequences):
        ids[: len(ws), j], gold[: len(ws), j], real[: len(ws), j] = [of[w] for w in ws], labels, True
    hot = np.eye(k)[gold] * real[:, :, None]
    both = real[1:] & real[:-1]
    gold_moves = np.bincount(gold[:-1][both] * k + gold[1:][both], minlength=k * k).reshape(k, k)
    weights, trans = np.zeros((len(kept) + 1, k)), np.zeros((k, k))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, trans)]
    for step in range(1, STEPS + 1):
        emission = np.zeros((len(vocab), k))
        for c in range(k):
            emission[:, c] = np.bincount(word_at, weights=weights[feature_at, c], minlength=len(vocab))
        scores = np.exp(emission - emission.max(axis=1, keepdims=True))[ids]
        matrix = np.exp(trans)
        post, ahead, behind, _ = _forward_backward(scores, real, matrix, np.full((n, k), 1.0 / k), np.ones((n, k)))
        gap = (hot - post) * real[:, :, None]
        by_word = np.stack([np.bincount(ids.ravel(), weights=gap[:, :, c].ravel(), minlength=len(vocab)) for c in range(k)], axis=1)
        up = np.stack([np.bincount(feature_at, weights=by_word[word_at, c], minlength=len(weights)) for c in range(k)], axis=1)
        moves = ahead[:-1][:, :, :, None] * matrix * (scores[1:] * behind[1:])[:, :, None, :]
        moves = np.where(both[:, :, None, None], moves / moves.sum(axis=(2, 3), keepdims=True), 0).sum(axis=(0, 1))
        for x, g, m in ((weights, up / n - 1e-4 * weights, moments[0]), (trans, (gold_moves - moves) / n - 1e-4 * trans, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            x += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, index, weights, trans)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` labelled rows, chosen by a hash of their ids."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = labelled.select(lang_col).count()
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * rows / max(total, 1)))
    sample = labelled.where(chosen) if total > rows else labelled
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("place")), F.greatest(F.char_length(text_col) - ROW_CHARS + 1, F.lit(1)).cast("long"))
    stretch = F.substring(F.col(text_col), place.cast("int") + 1, F.lit(ROW_CHARS))
    return fit([(r[0], r[1]) for r in sample.select(stretch, lang_col).limit(rows).collect()])


class _Reader:
    """A model in a worker, with the emissions of recurring words."""

    def __init__(self, model: Model | None):
        self.model = model
        self.memo = Memo(self._new, limit=300_000, kept=self._keep)
        self.table = np.zeros((0, len(model.languages) if model else 1))

    def _keep(self, rows: np.ndarray) -> None:
        self.table = self.table[rows]

    def _new(self, found: list[str]) -> list:
        self.table = np.concatenate([self.table, self.model.emissions(found)])
        return [()] * len(found)

    def read(self, batch_texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.model is None:
            return [UNDETERMINED] * len(batch_texts), [0.0] * len(batch_texts)
        found = [words(t) for t in batch_texts]
        rows = self.memo.lookup([w for ws in found for w in ws])
        emission = self.table[rows]
        lettered = ~np.isnan(emission[:, 0]) if len(emission) else np.zeros(0, bool)
        sizes = np.array([len(ws) for ws in found], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lettered)])[np.concatenate([[0], np.cumsum(sizes)])]
        kept = np.diff(ends)
        sums = posterior_sums(self.model, emission[lettered], kept)
        best = sums.argmax(axis=1)
        share = np.where(kept > 0, sums[np.arange(len(sums)), best] / np.maximum(kept, 1), 0)
        langs = [self.model.languages[b] if n else UNDETERMINED for b, n in zip(best, kept)]
        return langs, np.clip(share, 0, 1).tolist()


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast([model])
    key = uuid.uuid4().hex

    def run(batch):
        langs, scores = only(key, lambda: _Reader(shared.value[0])).read(texts(batch))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(chosen, run, chosen.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def accept(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast([model])
    key = uuid.uuid4().hex

    def run(batch):
        langs, scores = only(key, lambda: _Reader(shared.value[0])).read(texts(batch, text_col))
        return batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores)], type=pa.bool_()))

    return map_slices(docs, run, docs.schema, text_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its id, as text, is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def predict_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from labelled rows that aren't held out; predicts all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
