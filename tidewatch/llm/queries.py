"""The operators as registered queries over the corpus tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, decontaminate, jpeg, langid, licenses, lines, lm, pieces, pii, repair, simhash, tokens
from .common import written

#: Vocabulary files, parameters of the operators: a bare name is looked up where each task runs, a path is taken as it is.
PIECES = "piece_bpe_32k.model"
WORD_PIECES = "word_bpe_49k.json"
BYTE_PIECES = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), PIECES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_boilerplate(table(spark, sf_dir, "documents"), "source")
    return done.select("doc_id", "text", "n_lines", "n_dropped")


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are stored as a media column of a table and read back from it."""
    return jpeg.digest(written(jpeg.encode_column(table(spark, sf_dir, "documents")), "media", compression="zstd"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_lay_out(table(spark, sf_dir, "documents"), WORD_PIECES)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), WORD_PIECES)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"), BYTE_PIECES, PIECES)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_pieces": op2_pieces,
    "op3_line_dedup": op3_line_dedup,
    "op4_jpeg": op4_jpeg,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_token_orc": op9_token_orc,
    "op10_lm_scores": op10_lm_scores,
    "op11_bpe": op11_bpe,
    "op12_alignment": op12_alignment,
    "op13_repair": op13_repair,
}

_OP3 = f"""
WITH shown AS (
  SELECT source AS host, doc_id, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source AS host, count(*) AS pages FROM documents GROUP BY source),
common AS (SELECT host, line, count(*) AS n FROM shown GROUP BY host, line HAVING count(*) >= {lines.MIN_PAGES}),
bad AS (SELECT c.host, list(c.line) AS lines FROM common c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE n > {lines.MAX_RATIO} * pages GROUP BY c.host),
kept AS (
  SELECT d.doc_id, d.text IS NULL AS none, string_split(d.text, chr(10)) AS lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.lines, x), false)) AS left_over
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.host)
SELECT doc_id, CASE WHEN NOT none THEN coalesce(array_to_string(left_over, chr(10)), '') END AS text,
  CASE WHEN none THEN 0 ELSE len(lines) END AS n_lines, CASE WHEN none THEN 0 ELSE len(lines) - len(left_over) END AS n_dropped
FROM kept
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(of: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({of}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP7 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words_sql("text")} AS ws FROM documents),
b AS (SELECT item_id, {_words_sql("text")} AS ws FROM benchmark),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, least({decontaminate.WINDOW}, len(ws)) AS n,
    array_to_string(list_slice(ws, i, i + least({decontaminate.WINDOW}, len(ws)) - 1), ' ') AS grams
  FROM b, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW}, 0) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM w),
placed AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS grams
  FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
met AS MATERIALIZED (SELECT doc_id, p.n, i, item_id FROM placed p JOIN w ON p.n = w.n AND p.grams = w.grams),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM met, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: DuckDB SQL for the operators that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": _OP3, "op5_licenses": licenses.oracle_sql(), "op7_decontaminate": _OP7}
