"""Token ids as ORC: documents sorted by id, encoded, written in stripes, and read back.

The files hold ``doc_id``, ``ids`` and ``at`` (the file's ids before the row's) in ascending document order: range partitions of ids, each
sorted, one file each. ORC
stores the ids with integer run-length encoding and keeps row indexes and, on ``doc_id``, a Bloom filter for each
``row_index_stride`` rows, so a reader of some documents skips files, stripes and row groups by metadata
(:func:`read_documents`), and stripes are read in parallel.

Words recur, so a task tells stretches between blanks apart in Arrow, encodes each distinct one once (the vocabulary's tokenizer drops
white space and joins nothing across it) and holds a bounded number of them.

Defined results: a null or empty text has only the end id; rows with a null id come first; equal ids follow one another in the order of
their texts' hashes, which also part them over ranges where an id has many rows; repeated rows are documents of their own; an empty table
gives empty files and no rows. Ids keep their type (any that ORC can order). Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import Memo, fresh_place, located, only, slices, written

END_ID = 1
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000

#: A letter, marks behind it, and the blank or the text's end behind these.
_CLOSING = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)([ \n\t\r]|$)"
_TOGETHER = 400
#: Text encoded at a time; the more, the fewer distinct stretches in all.
TEXT_AT_ONCE = 8 << 20


class _Encoder:
    """Encodes distinct stretches; words of letters, each ended by a word-end token, go many to a call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(located(path))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def __call__(self, found: list[str]) -> list:
        plain = [i for i, w in enumerate(found) if w.isalpha()]
        groups = [plain[at : at + _TOGETHER] for at in range(0, len(plain), _TOGETHER)]
        out: list = [None] * len(found)
        for group, e in zip(groups, self._ids([" ".join([found[i] for i in g]) for g in groups])):
            ids = np.array(e, dtype=np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                for i, a, b in zip(group, [0, *cuts.tolist()], cuts.tolist()):
                    out[i] = e[a:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._ids([found[i] for i in rest])):
            out[i] = ids
        return out

    def _ids(self, found: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]


def _memo(path: str) -> Memo:
    """The worker's memo for a tokenizer file."""
    return only(("tokens", path), lambda: Memo(_Encoder(path)))


def _loose(column: pa.Array) -> pa.Array:
    """Texts whose ASCII letters are lower-cased, as the tokenizer does anyway, and whose closing marks stand apart from the letter
    before them, where the tokenizer parts them anyway: fewer forms to hold. Texts that could hold special tokens stay as they are."""
    plain = pc.replace_substring_regex(pc.ascii_lower(column), pattern=_CLOSING, replacement=r"\1 \2\3")
    special = pc.match_substring(column, "<|")
    return pc.if_else(special, column, plain) if pc.any(special).as_py() else plain


def encode_lists(column: pa.Array, path: str, end_id: int = END_ID) -> pa.ListArray:
    """The ids of each text of a string column, with the end id. Stretches are told apart in Arrow; only distinct ones become strings here."""
    split = pc.ascii_split_whitespace(_loose(pc.fill_null(column, "")))
    coded = split.flatten().dictionary_encode()
    ids, sizes = _memo(path).joined(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    found = coded.indices.to_numpy(zero_copy_only=False)
    last = np.cumsum(sizes)
    size = sizes[found]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat((last - sizes)[found] - ends[:-1], size)
    offsets = np.asarray(split.offsets)
    bounds = ends[offsets - offsets[0]]
    values = np.insert(ids[at], bounds[1:], end_id)
    return pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def encode(batch_texts: list[str | None], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """The ids of each text, with the end id."""
    return [x.values.to_numpy() for x in encode_lists(pa.array(batch_texts, type=pa.string()), path, end_id)]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``ids`` and ``at`` (ids of the same partition before the row's), in ascending order of ids over range partitions."""

    def run(batches):
        before = 0
        for batch in batches:
            for part in slices(batch, limit=TEXT_AT_ONCE):
                ids = encode_lists(part["text"], path, end_id)
                offsets = np.asarray(ids.offsets).astype(np.int64) + before
                before = int(offsets[-1])
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, pa.array(offsets[:-1])], names=["doc_id", "ids", "at"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = chosen.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(run, _schema(chosen.schema["doc_id"].dataType))


def _schema(id_type=LongType()) -> StructType:
    return StructType([StructField("doc_id", id_type), StructField("ids", ArrayType(IntegerType())), StructField("at", LongType())])


def write_orc(tokens: DataFrame, path: str, stripe_bytes: int = STRIPE_BYTES, row_index_stride: int = ROW_INDEX_STRIDE) -> None:
    (
        tokens.write.option("orc.compress", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, id_type=LongType()) -> DataFrame:
    return spark.read.schema(_schema(id_type)).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents' ids: the filter goes to the files' statistics, row indexes and Bloom filters."""
    return read_orc(spark, path).where(F.col("doc_id").isin(doc_ids))


def layout(tokens: DataFrame) -> DataFrame:
    """From files read back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Each file holds a range of documents, so a start is the sum of the files before, one row each, and the row's ``at``. Files that hold
    one id only, alike or not, follow one another by name.
    """

    def run(batches):
        for batch in batches:
            lists = batch["ids"]
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
            data, bounds = memoryview(values).cast("B"), (offsets * 4).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["file"], batch["at"], n, pa.array(crc, type=pa.int64())], names=["doc_id", "file", "at", "n", "crc"])

    read = tokens.select("doc_id", "ids", "at", F.col("_metadata.file_name").alias("file"))
    empty = F.lit(0).cast("long")
    rows = written(read.mapInArrow(run, read.select("doc_id", "file", "at", empty.alias("n"), empty.alias("crc")).schema), "layout")
    before = Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first"), F.max("doc_id").alias("last"), F.sum("n").alias("total"))
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(files, "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def write_and_lay_out(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Encodes, writes ORC below ``path`` (a fresh shared folder if None), and lays out what it reads back."""
    spark = docs.sparkSession
    path = path or fresh_place(spark, "orc")
    write_orc(encoded(docs, tokenizer_path), path)
    return layout(read_orc(spark, path, docs.schema["doc_id"].dataType))
