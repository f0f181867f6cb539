import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import align
from tidewatch.llm.bpe import byte_alphabet

SF = "/root/testdata/sf0.001"
A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
HARD = [
    None, "", " ", "  ", "\n", "\n\n a", "<s> </s> <0x41> <unk> <|endoftext|>", "x" * 3000, "a  b   c\t\td \n e", "\u3000x", "a\u3000 b", "! \x1c!", "!\x1c !", "\r\n\r\nq", ";\r x",
    "a\u2581b", "\u00a0 \u00a0", "naïve 你好 🙂", "end ", "end\n", "same", "same",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Whole texts through the libraries, every A token against every B token it may touch, counts in dictionaries."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in a_of.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("\u2581", " ").encode() for i in range(b_of.get_piece_size())]
    each, counts = [], Counter()
    for text in texts:
        a = a_of.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        whole = f" {text}".encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            each.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(b_bytes[i]) for i in b])
        at_a, at_b = ([i for i, x in enumerate(ids) for _ in table[x]] for ids, table in ((a, a_bytes), (b, b_bytes)))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(at_a, at_b)))]  # the tokens that share a byte
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        parts = [(np.split(np.array(ids), np.searchsorted(ends, cuts, side="right"))) for ends, ids in ((ends_a, a), (ends_b, b))]
        groups = ["|".join(",".join(map(str, g.tolist())) for g in two) for two in list(zip(*parts))[:-1]]
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for x in each:
        out.append((*x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, ""))
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS N_A").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.digest(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_hard_and_random_texts(spark, monkeypatch):
    rng = random.Random(2)
    letters = "aAeiouthsrdlmnTHE      \n\n\t.,!?-'012345éΣß你好🙂  \x00\x1c\x85▁<>|s/"
    drawn = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(600)]
    check(spark, HARD + [t if i % 3 else t.replace("▁", "") for i, t in enumerate(drawn)])


def test_documents(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    check(spark, texts)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame([(i, f"some words of text {i % 5} here") for i in range(100)], "doc_id long, text string").coalesce(1)
    made = align.blocks(docs, A, B).collect()
    assert len(made) > 10 and len({r.block for r in made}) == len(made) and sum(len(r.doc_id) for r in made) == 100


def test_groups_and_links_of_one_text():
    size_a, size_b = np.array([0, 1, 2, 3]), np.array([0, 1, 2, 3])
    links, groups = align.align([1, 2, 3], [2, 1, 1, 2], size_a, size_b)  # A ends 1 3 6, B ends 2 3 4 6
    assert links == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]
    assert groups == [([1, 2], [2, 1]), ([3], [1, 2])]
    assert align.align([], [], size_a, size_b) == ([], [])


@pytest.mark.parametrize("text", ["a  b", " \n x\ty ", "\u3000 a", "no blanks"])
def test_stretches_are_the_text(text):
    assert "".join(align.stretches(text)) == text


def test_no_rows(spark):
    assert align.digest(spark.createDataFrame([], "doc_id string, text string"), A, B).collect() == []
