import hashlib
import random

import pandas as pd
import pyarrow as pa
import pytest

from tidewatch.llm import bpe

SF = "/root/testdata/sf0.001"
PATH = "/opt/tokenizers/word_bpe_49k.json"
HARD = [
    "", " ", "\n\t ", "Hello, World's best!!", "don't  WE'LL", "x" * 3000, "in" * 1500 + "g", "12345 a1b2", "ΑΣ ΣΑΣ", "İstanbul ǅ", "Å é", "你好🙂👩‍👩‍👧", "a\x00b\x1cc\x85d　e",
    "a<|endoftext|>b <|StartOfText|><|startoftext|>", "<|endoftext|", "á <|endoftext|>́", "\U0003fc3b.\U00010d50Ᲊ꟎",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def listed(texts):
    return bpe.encode_lists(pa.array(texts, type=pa.string()), PATH).to_pylist()


def by_list(merges, symbols):
    """The list's merges one after the other, each from left to right."""
    for a, b, made in merges:
        out = []
        for s in symbols:
            if out and out[-1] == a and s == b:
                out[-1] = made + 0.5  # not to be merged again by the same merge
            else:
                out.append(s)
        symbols = [int(s) for s in out]
    return symbols


def random_merges(rng):
    tokens, merges = list(range(rng.randint(1, 3))), []
    base = len(tokens)
    seen = set()
    for _ in range(rng.randint(1, 25)):
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in seen:
            seen.add(pair)
            merges.append((*pair, 100 + len(merges)))
            tokens.append(100 + len(merges) - 1)
    return base, bpe.Merges(merges)


def test_merging_and_lookahead_of_random_lists():
    rng, tight = random.Random(5), 0
    for _ in range(400):
        base, merges = random_merges(rng)
        assert merges.proper
        ahead = merges.lookahead()
        for _ in range(10):
            text = [rng.randrange(base) for _ in range(rng.randint(1, 120))]
            whole = merges.apply(text)
            assert whole == by_list(merges.merges, text)
            # Tokens that end before the lookahead are the same whatever follows.
            cut = rng.randrange(len(text))
            end, before = 0, []
            for token in merges.apply(text[:cut]):
                end += merges.length.get(token, 1)
                if end > cut - ahead:
                    break
                before.append(token)
            assert whole[: len(before)] == before
            tight += bool(before)
            machine, out, at = bpe.Transducer(merges, ahead), [], 0
            while at < len(text):
                to = at + rng.randint(1, 7)
                out += machine.feed(text[at:to])
                assert len(machine.held) <= machine.most
                at = to
            assert out + machine.finish() == whole
    assert tight > 500


def test_a_list_that_is_not_proper_is_held_whole():
    merges = bpe.Merges([(100, 0, 101), (0, 0, 100)])
    assert merges.lookahead() is None
    machine = bpe.Transducer(merges, None)
    assert machine.feed([0] * 50) == [] and machine.finish() == merges.apply([0] * 50)


def test_the_vocabularys_lookahead(library):
    vocab = bpe._vocabulary(PATH)
    assert vocab.merges.proper and 64 <= vocab.lookahead <= 2000
    machine = bpe.Transducer(vocab.merges, vocab.lookahead)
    most, out = 0, []
    word = "internationalisation" * 2000
    symbols = [vocab.inner[b] for b in word.encode()]
    for at in range(0, len(symbols) - 1, 10):
        out += machine.feed(symbols[at : min(at + 10, len(symbols) - 1)])
        most = max(most, len(machine.held))
    assert out + machine.finish([vocab.last[ord(word[-1])]]) == library.encode(word, add_special_tokens=False).ids
    assert most <= machine.most


def test_against_the_library(library):
    rng = random.Random(1)
    letters = "aAeiouth'sSrevdlm .,!?-0123456789\n\tééΣσςİßǅKÅ你好🙂👩‍ \x00\x1c\x85"
    texts = HARD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [t[:3] + rng.choice(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]) + t[3:] for t in texts[:300]]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert listed(texts) == want
    assert [bpe.decode(x, PATH) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("plane", [0, 1, 2])
def test_every_character_of_the_first_planes(library, plane):
    texts = [f"a{chr(c)}B1{chr(c)}.{chr(c)}" for c in range(plane << 16, plane + 1 << 16) if not 0xD800 <= c < 0xE000]
    assert listed(texts) == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_bytes_become_text_as_they_come():
    rng = random.Random(2)
    for _ in range(2000):
        data = "a é你🙂".encode() * 2 if rng.random() < 0.5 else bytes(rng.choices([0x41, 0x80, 0xBF, 0xC1, 0xC3, 0xE0, 0xE4, 0xED, 0xF0, 0xF4, 0xF5, 0xFF, 0x90], k=12))
        machine, out, at = bpe.ByteToText(), "", 0
        while at < len(data):
            to = at + rng.randint(1, 3)
            out += machine.feed(data[at:to])
            assert len(machine.held) <= 3
            at = to
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_byte_level_entries_become_the_text():
    from tokenizers import Tokenizer

    text = "naïve 你好 🙂 \n x"
    machine, byte_of = bpe.ByteToText(), {c: b for b, c in enumerate(bpe.byte_alphabet())}
    parts = [machine.feed(bytes(byte_of[c] for c in token)) for token in Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json").encode(text).tokens]
    assert "".join(parts) + machine.finish() == text


def test_columns_keep_the_others(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (2, None, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    done = bpe.decode_column(bpe.encode_column(docs, PATH), PATH)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id, r.ids, r.decoded) for r in done.where("text IS NOT NULL").collect())
    assert got[0] == got[1] == (1, [3306, 997], "hello</w> there</w>") and got[2] == (3, [], "")
    assert done.where("text IS NULL").first().ids is None and done.where("text IS NULL").first().decoded is None
    assert bpe.encode_column(docs.where("false"), PATH).collect() == []


def test_digest_against_the_library(spark, library):
    rows = list(enumerate([*HARD, None, "Hello", "Hello"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS Doc").repartition(3)
    for docs, rows in ((docs, rows), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        rows = rows or [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digest(docs, PATH).collect())) == sorted(want)
    assert bpe.digest(docs.where("false"), PATH).collect() == []
