import os
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tidewatch.llm import tokens

DATA = "/root/testdata/sf0.001"
PATH = "/opt/tokenizers/word_bpe_49k.json"
HARD = [
    None,
    "",
    " \n\t",
    "It's John's, they'll éte. a b c d \x1cx\x85y.z",
    "<|endoftext|> a<|startoftext|>b <|endoftext|>",
    "WORD!!! Word### ((a)) A<|ENDOFTEXT|> <|EndOfText|> ÀÉÎ ǅ Å",
    "İstanbul ΣΑΣ ß ﬁ 你好 한국 한 12,345.67 a.b,c. .» «x».",
    "x" * 5000,
    "word, word. word; WORD " * 300,
    "́ a ́b",
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_stretches_give_what_whole_texts_give(spark):
    texts = HARD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == whole(texts)


def tie(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def expected(rows):
    """Starts in the order of ids and, where ids are equal, of the texts' hashes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    out, at = [], 0
    for (doc, _), ids in zip(rows, whole([t for _, t in rows])):
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def laid_out(df):
    return sorted(df.select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r.start)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)
    got = laid_out(tokens.write_and_lay_out(docs, PATH))
    assert [tuple(r) for r in got] == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a b"), (None, "c"), (2, "again"), (2, "again")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, file string")
    got = laid_out(tokens.write_and_lay_out(docs, PATH))
    want = expected(rows)
    assert [tuple(r) for r in got] == want
    assert laid_out(tokens.write_and_lay_out(docs.limit(0), PATH)) == []


def test_files_have_indexes_and_filters(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path / "ids")
    tokens.write_orc(tokens.encoded(docs, PATH), path)
    wanted = tokens.read_documents(spark, path, [3, 150])
    assert sorted(r.doc_id for r in wanted.collect()) == [3, 150]
    assert "PushedFilters: [In(doc_id" in wanted._jdf.queryExecution().toString()
    parts = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    import pyarrow.orc as orc

    ids = [i for p in parts for i in orc.read_table(f"{path}/{p}")["doc_id"].to_pylist()]
    assert ids == sorted(ids) and len(ids) == docs.count()
    assert all({"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= streams(spark, f"{path}/{p}") for p in parts)


def streams(spark, path):
    """Kinds of the id column's streams in the first stripe's footer."""
    jvm = spark._jvm.org.apache
    reader = jvm.orc.OrcFile.createReader(jvm.hadoop.fs.Path(path), jvm.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    found = [footer.getStreams(i) for i in range(footer.getStreamsCount())]
    return {x.getKind().toString() for x in found if x.getColumn() == 1}


def test_starts_follow_the_files_where_ids_repeat(spark, tmp_path):
    """Rows of one id with different texts, more than a partition holds, and identical rows."""
    rows = [(2, "a b"), (2, "c"), (3, "d"), (2, "a b c d e"), (2, "c"), (1, None), (2, "f g " * 40)] + [(7, f"w{i} x") for i in range(60)] + [(7, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "ids")
    got = laid_out(tokens.write_and_lay_out(docs, PATH, path))
    read = [r for f in sorted(os.listdir(path)) if f.endswith(".orc") for r in tokens.read_orc(spark, f"{path}/{f}").collect()]
    flat = [i for r in read for i in r.ids]
    assert [r.doc_id for r in read] == [r.doc_id for r in got]
    for r in got:
        assert zlib.crc32(np.array(flat[r.start : r.start + r.n_tokens], dtype="<u4").tobytes()) == r.ids_crc32
    assert [tuple(r) for r in got] == expected(rows)


def test_text_ids_and_a_very_long_text(spark):
    long = " ".join(f"word{i} Ünïcode, {i}." for i in range(150_000))
    docs = spark.createDataFrame([("b", long), ("a", "x"), ("c", None)], "doc_id string, text string")
    got = laid_out(tokens.write_and_lay_out(docs, PATH))
    assert [tuple(r) for r in got] == expected([("b", long), ("a", "x"), ("c", None)])


@pytest.mark.parametrize("limit", [1, 7, 10**6])
def test_memo_size_changes_nothing(limit):
    memo = tokens.Memo(tokens._Encoder(PATH), limit=limit)
    words = "a b c the a thhetion b c . a".split()
    for _ in range(2):
        ids, sizes = memo.joined(words)
        assert ids.tolist() == [i for w in whole(words) for i in w[:-1]] and sizes.sum() == len(ids)
