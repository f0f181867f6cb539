"""Readers of result files, archives, manifests, logs and image sets, and their writers.

Everything goes through Spark's own sources, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and version of result rows.
RESULT_COLUMNS = "version int, mode string, dataset string, schedule string, seed int, series string, sweep_parameter string, sweep_value double, batch double, distance double, accuracy double"
VERSION = 1
SCHEDULES = ("random", "fixed")


def read_results(spark: SparkSession, paths: str | list[str], modes: list[str] | None = None) -> DataFrame:
    """Result rows of all files, in one bag; a wrong version, a missing schedule or an unknown mode fails the read."""
    rows = spark.read.schema(RESULT_COLUMNS).csv(paths, header=True, mode="FAILFAST", enforceSchema=False)
    bad = (F.coalesce(F.col("version"), F.lit(-1)) != VERSION) | ~F.coalesce(F.col("schedule").isin(*SCHEDULES), F.lit(False))
    if modes is not None:
        bad = bad | ~F.col("mode").isin(*modes)
    return rows.where(F.when(bad, F.raise_error(F.concat(F.lit("result row not accepted: "), F.to_json(F.struct("version", "mode", "schedule"))))).otherwise(F.lit(True)).cast("boolean"))


def read_logs(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Records of lines that match ``pattern`` (its groups as ``names``), with file and line order left to the reader of keys."""
    lines = spark.read.text(path)
    found = lines.where(F.col("value").rlike(pattern))
    return found.select(*[F.regexp_extract("value", pattern, i).alias(n) for i, n in enumerate(names, 1)], F.col("_metadata.file_path").alias("file"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``root`` and ``dataset`` of each source of JSON lists; one without datasets fails the read."""
    found = spark.read.schema("root string, datasets array<string>").json(path)
    bad = F.col("root").isNull() | (F.coalesce(F.size("datasets"), F.lit(0)) < 1)
    checked = found.where(F.when(bad, F.raise_error(F.concat(F.lit("source not accepted: "), F.coalesce("root", F.lit("?"))))).otherwise(F.lit(True)).cast("boolean"))
    return checked.select("root", F.explode("datasets").alias("dataset"))


def latest_records(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the last record."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def read_manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Manifests below a folder, unreadable ones left out, completed ones only."""
    found = spark.read.schema(schema + ", _broken string").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").option("columnNameOfCorruptRecord", "_broken").json(root, multiLine=True)
    return found.withColumn("path", F.col("_metadata.file_path")).where("_broken IS NULL AND status = 'completed'").drop("_broken")


def read_archives(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Compressed array archives as rows: ``path`` and the named arrays (absent ones null). Each archive is one run, read in one task."""
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for where, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    out.append((where, *(arrays[n].ravel().tolist() if n in arrays else None for n in names)))
            yield pd.DataFrame(out, columns=["path", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, f"path string, {schema}")


def _parse_idx(content: bytes) -> np.ndarray:
    """A big-endian image (magic 2051, in [0, 1]) or label (magic 2049) file, maybe compressed."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    (magic,) = struct.unpack_from(">I", data)
    if magic not in (2049, 2051):
        raise ValueError(f"not an image or label file (magic {magic})")
    shape = struct.unpack_from(">III" if magic == 2051 else ">I", data, 4)
    body = np.frombuffer(data, np.uint8, offset=16 if magic == 2051 else 8)
    if len(body) != np.prod(shape):
        raise ValueError("payload size doesn't fit the header")
    return body.reshape(shape[0], -1).astype(np.float32) / 255 if magic == 2051 else body.astype(np.float32)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``at``, ``values`` of image and label files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                rows = _parse_idx(content)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pd.DataFrame({"path": where, "at": np.arange(at, at + len(part)), "values": [np.atleast_1d(r).tolist() for r in part]})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, at long, values array<float>")


def canonical(rows: DataFrame, added: dict[str, Column], order: list[str]) -> DataFrame:
    """``rows`` with the columns of ``order``, those that are missing from ``added``; all others go."""
    missing = [c for c in order if c not in rows.columns and c not in added]
    if missing:
        raise ValueError(f"no column or value for {missing}")
    return rows.select(*(F.col(c) if c in rows.columns else added[c].alias(c) for c in order))


# --- writers ---


def write_results(rows: DataFrame, path: str) -> None:
    """CSV with a fixed header, refused where there is something already."""
    rows.select(*[c.split(" ")[0] for c in RESULT_COLUMNS.split(", ")]).write.mode("errorifexists").csv(path, header=True)


def write_runs(samples: DataFrame, path: str, by: list[str]) -> None:
    """Raw rows as Parquet, partitioned by run columns; rows of one run lie together, and Spark splits a run by its size."""
    samples.hint("rebalance", *by).write.partitionBy(*by).mode("errorifexists").parquet(path)


def write_baseline(rows: DataFrame, path: str, by: str, order: list[str]) -> DataFrame:
    """CSV in a folder for each value of ``by``, sorted within each file, refused where there is something already; what is read back, if it
    has as many rows."""
    rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.partitionBy(by).mode("errorifexists").csv(path, header=True)
    back = rows.sparkSession.read.schema(rows.schema).csv(path, header=True)
    written, read = rows.count(), back.count()
    if written != read:
        raise ValueError(f"{written} rows were written, {read} are there")
    return back


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small ordered result as a Markdown table; nulls as a dash. Larger results are refused, not cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    text = lambda v: "–" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(text, r)) + " |" for r in found)])
