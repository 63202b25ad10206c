"""The registered queries on the smallest given tables, and the pipeline stage by stage."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences, oracle_connection
from hotspan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    fn, sql = QUERIES[name]
    if sql is not None:
        assert differences(spark, oracle_connection(SF_DIR), fn, sql, SF_DIR) is None
    else:
        assert fn(spark, SF_DIR).count() > 0


@pytest.mark.parametrize("name", ["op7_secret_scan", "op10_license_scan"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        rows.append(docs.count())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 200 > rows[0] > rows[1] == rows[2] > 0 and rows[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.select("row").distinct().count() == rows[3]
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_quality_stage_takes_one_python_worker_a_task(spark, monkeypatch):
    """No stage of the training makes the statistics and sums them, also where the labels are broadcast."""
    seen = []
    fit = corpus_pipeline.quality.fit
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda rows, *a: seen.append(rows) or fit(rows, *a))
    kept = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*seen, kept)]
    assert len(seen) == 1 and "MapInArrow" not in plans[0]
    assert plans[1].count("ArrowEvalPython") + plans[1].count("MapInArrow") == 1


def test_stages_hand_small_batches_to_python(spark):
    """A batch of texts has a few MB when a stage with Python has returned, and less where the user has set less."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("quality", "near_duplicates", "pack"):
                spark.conf.set(corpus_pipeline.BATCH, "64m")
                stage(spark, docs, SF_DIR)
                found = [r.bytes for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
                assert max(found) < corpus_pipeline.BATCH_BYTES + 1_100_000 and sum(found) > 12_000_000, name
        for text, then in (("1m", "1m"), ("4096k", "4096k"), ("5000kb", str(4 << 20)), ("1g", str(4 << 20)), ("300", "300")):
            spark.conf.set(corpus_pipeline.BATCH, text)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(corpus_pipeline.BATCH) == then
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


CLASHES = ("_id", "_source", "_size", "_key", "_base", "_spans", "_epochs", "_words", "_cut", "_left", "_rest", "key", "size", "rest", "words", "id",
           "doc", "row", "component", "score", "first", "rows", "n", "check", "hits", "dotted.name")


def test_stages_keep_columns_of_any_name(spark):
    """Every stage gives the same rows with and without further columns, and keeps these columns' values."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
        out = stage(spark, wide, SF_DIR)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES), name
        plain = stage(spark, docs, SF_DIR).collect()
        shown = Counter(tuple(r[c] for c in docs.columns) for r in rows)
        assert shown == Counter(tuple(r) for r in plain), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, wide, SF_DIR).count() == last(spark, docs, SF_DIR).count()
