import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import pieces

DATA = "/root/testdata/sf0.001"
PATH = "/opt/tokenizers/piece_bpe_32k.model"
HARD = ["", " ", "  a  b ", "a\nb\n\n c", "▁ mark ▁▁x", "naïve 你好 🙂 \x00\x01", "́", "x" * 1000, "aaaa" * 200, "tab\tand\r\n", "ab " * 2000]


class Tiny:
    """A vocabulary by hand."""

    byte_ids = list(range(1000, 1256))
    add = pieces.Vocabulary.add

    def __init__(self, scored):
        self.trie, self.longest, self.bytes_of = {}, 1, []
        for i, (piece, score) in enumerate(scored.items()):
            self.add(piece, i, score)
        self.unknown = min(scored.values()) - 10


def brute(vocab_pieces, unknown, text):
    """Best sum of scores and its ids by plain dynamic programming; ties go to the earliest start of the last piece."""
    best = [(0.0, None, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 40), end):
            hit = vocab_pieces.get(text[start:end])
            if hit is None and end - start == 1:
                hit = (unknown, -1)
            if hit and (best[end] is None or best[start][0] + hit[0] > best[end][0]):
                best[end] = (best[start][0] + hit[0], start, hit[1])
    ids, at = [], len(text)
    while at:
        _, start, piece = best[at]
        ids[:0] = [piece] if piece >= 0 else [-2 - i for i in range(len(text[start:at].encode()))]
        at = start
    return best[-1][0], ids


def listed(vocab, node=None, prefix=""):
    for c, child in (vocab.trie if node is None else node).items():
        if c == "":
            yield prefix, child
        else:
            yield from listed(vocab, child, prefix + c)


@pytest.fixture(scope="module")
def vocab():
    return pieces._vocabulary(PATH)


def test_random_vocabularies_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        scored = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))): -float(rng.randint(1, 9)) for _ in range(12)}
        tiny = Tiny(scored)
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 90)))
        plain = {p: (s, i) for i, (p, s) in enumerate(scored.items())}
        want = brute(plain, tiny.unknown, text)[1]
        assert [min(i, 1000) for i in pieces.viterbi(tiny, text)] == [i if i >= 0 else 1000 for i in want]


def test_window_stays_bounded_and_commits_early():
    tiny = Tiny({"a": -1.0, "ab": -1.5, "b": -1.0, "abab": -2.0})
    search = pieces.StreamingViterbi(tiny)
    text = "ababx" * 500 + "abab" * 50 + "x" + "ba" * 200
    for at, c in enumerate(text):
        search.feed(c)
        assert len(search.score) <= tiny.longest + 2 and len(search.nodes) <= tiny.longest
        assert at > 2500 or search.at - search.base <= 4 * tiny.longest
    plain = {p: (s, i) for p, (s, i) in listed(tiny)}
    assert [max(i, -1) for i in search.finish()] == [max(i, -1) for i in brute(plain, tiny.unknown, text)[1]]


def test_vocabulary_against_brute_force(spark, vocab):
    plain = dict(listed(vocab))
    texts = HARD[:-1] + [r.text[:300] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(25).collect()]
    for text, ids in zip(texts, pieces.encode(texts, PATH)):
        want = brute(plain, vocab.unknown, f" {text}")[1]
        assert [i for i in ids if i not in vocab.byte_ids] == [i for i in want if i >= 0]


def test_round_trip_of_every_text(spark, vocab):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = pieces.digest(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:50]:
        ids = pieces.encode([texts[r.doc_id]], PATH)[0]
        assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (r.n_pieces, r.ids_crc32)


def test_library_decodes_the_same(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["Hello world", "naïve 你好 🙂", "a\nb"]:
        assert model.decode([int(i) for i in pieces.encode([text], PATH)[0]]) == text


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, "a b", None), *[(9 + i, t, "z") for i, t in enumerate(HARD)]], "doc_id long, text string, ids string")
    rows = pieces.digest(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    assert [(r.n_pieces, r.ids_crc32) for r in rows if r.doc_id == 1] == [(None, None)]
    both = pieces.decode_column(pieces.encode_column(docs, PATH, out_col="tokens"), PATH, "tokens")
    assert both.columns == ["doc_id", "text", "ids", "tokens", "decoded"]
    assert all(r.text == r.decoded for r in both.collect())
    assert pieces.digest(docs.limit(0), PATH).count() == 0


def test_memo_clears_without_changing_results(vocab):
    memo = pieces.Memo(lambda found: [pieces.viterbi(vocab, s) for s in found], limit=3)
    words = [" the", " a", " of", " the", " thing", " is"]
    ids, _ = memo.joined(words)
    assert ids.tolist() == np.concatenate([pieces.viterbi(vocab, w) for w in words]).tolist()


def test_fine_stretches_join_to_the_whole(vocab):
    assert vocab.stretch is pieces._FINE_STRETCH
    alphabet = "abzäßłéЖ你²½_1٣ .,'\"-(\n▁\t\u0301"
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert "".join(vocab.stretch.findall(text)) == text
        assert pieces.encode([text], PATH)[0].tolist() == pieces.viterbi(vocab, f" {text}")
    joining = Tiny({"a": -1.0, "a.": -1.0})
    assert joining.stretch is pieces._STRETCH


def test_names_clash_in_any_case(spark):
    docs = spark.createDataFrame([(1, "ab", 5, 6)], "doc_id long, text string, IDS int, Decoded int")
    done = pieces.decode_column(pieces.encode_column(docs, PATH), PATH)
    assert done.columns == ["doc_id", "text", "ids", "decoded"] and done.select("decoded").first()[0] == "ab"
    checked = pieces.encode_checked(docs, PATH)
    assert len({c.lower() for c in checked.columns}) == len(checked.columns) and checked.select("ids").first()[0]
