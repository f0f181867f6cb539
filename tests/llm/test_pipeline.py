from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import pieces
from tidewatch.llm.queries import PIECES

from .test_decontaminate import brute_scan
from .test_lines import brute_clean
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(900001, "12 34 !!", None, "src0", 8), (900002, None, None, "src0", None)], docs.schema)
    docs = docs.unionByName(noise).cache()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "line dedup", "near-dedup", "decontamination", "pieces"]

    kept = steps["language ID"](spark, docs, SF)
    assert rows(kept) == rows(docs.where("doc_id < 900000"))  # the tables' documents all are in one language or two
    before = kept.cache()

    cleaned = steps["line dedup"](spark, before, SF).cache()
    assert cleaned.columns == docs.columns
    want = brute_clean([(r.doc_id, r.source, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in cleaned.collect()} == {d: t for d, (t, _, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    single = steps["near-dedup"](spark, cleaned, SF).cache()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in cleaned.collect()]
    firsts = set(brute_components(prints))
    assert rows(single) == [r for r in rows(cleaned) if r[docs.columns.index("doc_id")] in firsts]

    clean = steps["decontamination"](spark, single, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, r in brute_scan([(r.doc_id, r.text) for r in single.collect()], items).items() if r[1]}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    assert hit

    ids = steps["pieces"](spark, clean, SF).collect()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id for r in ids} == texts.keys() and all(r.lossless for r in ids)
    assert all(pieces.decode(r.ids, PIECES) == texts[r.doc_id] and len(r.ids) == r.n_pieces for r in ids)


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_groups_of_copies_keep_one_whole_text(spark):
    """Each line of a group's copies is on over 5 % of its source's pages; different groups don't become one empty text."""
    words = [f"w{i}" for i in range(400)]
    groups = {g: "\n".join(" ".join(words[100 * g + 10 * k : 100 * g + 10 * k + 10]) for k in range(3)) + "\n\n" for g in range(3)}
    data = [(100 * g + i, text, "en", f"src{g % 2}", len(text)) for g, text in groups.items() for i in range(20)]
    data += [(1000 + i, f"menu\nown line number {i} of page {i * i}\n", "en", "src0", 40) for i in range(20)] + [(2000, None, "en", "src0", None), (2001, "\n", "en", "src0", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.line_dedup(spark, docs, SF).cache()
    texts = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
    assert all(texts[100 * g + i] == (text, len(text)) for g, text in groups.items() for i in range(20))
    assert texts[1003][0] == "own line number 3 of page 9\n" and texts[2000] == (None, None) and texts[2001] == ("\n", 1)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, cleaned, SF).collect()}
    assert {d: t for d, t in kept.items() if d < 1000} == {100 * g: text for g, text in groups.items()}


def test_repeated_rows_a_long_text_and_extra_columns(spark):
    """Through all stages: clashing columns stay up to the last stage, a repeated row counts once after near-dedup, nothing crashes."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    long = base.where("doc_id = 1").selectExpr("5000L as doc_id", "repeat(concat(text, ' again\n'), 300) as text", "lang", "source", "n_chars")
    docs = base.unionByName(base.where("doc_id IN (2, 3)")).unionByName(long)
    for name in ("row", "tie", "id", "drop", "kept", "fp", "n_lines"):
        docs = docs.withColumn(name, F.lit(name))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        assert {r.fp for r in now.collect()} <= {"fp"}
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids))
    assert dict(corpus_pipeline.STAGES)["pieces"](spark, now, SF).where("lossless").count() == len(ids)
