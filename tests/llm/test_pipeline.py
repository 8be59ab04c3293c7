"""The corpus pipeline stage by stage against plain versions of its decisions."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_text_operators import SF, alike, docs_of, empty_docs, linked_brute, odd_docs, shingle_set  # noqa: E402


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_in_turn(spark):
    from accesslens.llm.common import stored
    from accesslens.llm.quality import quality_scores

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "personal_data", "packing"]

    good = stored(stages["quality"](spark, docs, SF), "t")
    wanted = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert set(rows_of(good)) == wanted and 0 < len(wanted) < docs.count()

    lines = stored(stages["line_dedup"](spark, good, SF), "t")
    assert lines.columns == docs.columns and set(rows_of(lines)) <= wanted
    seen = {}
    for i, r in sorted(rows_of(good).items()):
        seen.setdefault(r["text"] if len(r["text"].split()) >= 8 else i, i)
    assert set(rows_of(lines)) <= set(seen.values())        # later copies of a text are gone
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] != rows_of(good)[r["doc_id"]]["text"])

    near = stored(stages["near_duplicates"](spark, lines, SF), "t")
    ordered = sorted(rows_of(lines).items())
    parts = linked_brute([shingle_set(r["text"]) for _, r in ordered], alike)
    assert set(rows_of(near)) == {ordered[p][0] for p in set(parts)}

    clean = stored(stages["personal_data"](spark, near, SF), "t")
    assert set(rows_of(clean)) == set(rows_of(near)) and clean.columns == docs.columns
    assert clean.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0

    packed = stages["packing"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows_of(clean))

    whole = corpus_pipeline.run(spark, SF)
    assert whole.groupBy("doc_id").agg(F.sum("length")).count() == len(rows_of(clean))


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark).drop("removed_lines"), empty_docs(spark), docs_of(spark, [(1, "only one")] * 3)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns
