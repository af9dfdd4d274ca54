import zlib

import numpy as np
import pytest

from docloom.llm import catalog, quality

from .helpers import HARD_TEXTS, as_tables, documents, empty

LABELS = "doc_id bigint, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = catalog.op4_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_scores_are_weighted_votes_of_the_nearest():
    """Blocked scores against a plain loop over all labelled vectors."""
    rng = np.random.default_rng(2)
    counts = rng.poisson(1, (60, quality.TERMS)).astype(np.float32)
    labels = (np.arange(60) % 3 > 0).astype(float)
    model = quality.train(counts, labels)
    fresh = rng.poisson(1, (20, quality.TERMS)).astype(np.float32)
    vectors = quality._unit((quality._weighted(fresh, model.idf) - model.mean) @ model.projection)
    for v, got in zip(vectors, model.scores(fresh)):
        cosines = [float(v @ w) for w in model.vectors]
        near = sorted(range(60), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        votes = {i: (max(cosines[i], 0) + 1e-6) ** 3 for i in near}
        assert got == pytest.approx(sum(votes[i] * labels[i] for i in near) / sum(votes.values()), abs=1e-4)


def test_labels_of_the_held_out_fold_and_other_columns_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    flipped = labels.withColumn(
        "quality", (quality.F.when(quality.fold(quality.F.col("doc_id")) == 0, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality"))).cast("int")
    )
    again = quality.fit(docs.withColumn("lang", quality.F.lit("xx")), flipped)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.labels, again.labels)


def test_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.unionByName(docs), labels.unionByName(labels), per_class=20)
    assert len(model.labels) == 40 and model.labels.sum() == 20


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, None), (3, None, 1), (None, 1, 0), (99, 1, 0)]])
def test_hard_rows(spark, tmp_path, labels):
    path = as_tables(spark, tmp_path, documents(spark, extra=True), labels=spark.createDataFrame(labels, LABELS))
    got = catalog.op4_quality_classifier(spark, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in HARD_TEXTS)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    if not labels:
        assert {r.score for r in got} == {0.5}


def test_empty_table_and_filter(spark):
    model = quality.train(np.zeros((0, quality.TERMS)), np.zeros(0))
    assert quality.scored(empty(spark), model).collect() == []
    docs = documents(spark, extra=True)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == docs.count()
