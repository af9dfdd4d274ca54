from collections import defaultdict

import corpus_pipeline
from docloom.llm import quality

from .helpers import as_tables, documents, empty
from .test_exact_dedup import norm
from .test_packing import check, ids_of, tokenizer
from .test_secrets import HEX
from .test_simhash import brute_components

SF = "/root/testdata/sf0.01"


def brute(rows, scores):
    """(doc_id, text) of what four stages keep, by plain loops over the quality scores."""
    rows = [(d, t) for d, t in rows if scores[d] >= 0.3]
    last = {}
    for d, t in sorted(rows):
        last[norm(t)] = d
    rows = [(d, t) for d, t in rows if last[norm(t)] == d]
    keep = {c for _, _, c in brute_components(rows)}
    return {d: t for d, t in rows if d in keep}


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing",
    ]
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(10_000 + i, f"{t} token = \"{HEX}\"") for i, (_, t) in enumerate(rows[:5])]
    docs = documents(spark, rows)
    import tempfile

    path = as_tables(spark, tempfile.mkdtemp(), docs, labels=spark.read.parquet(f"{SF}/labels.parquet"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    want = brute(rows, scores)
    assert 0 < len(want) < len(rows)
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p.doc_id for p in pieces} == set(want)
    from docloom.llm.secrets import redacted

    t = tokenizer()
    check(pieces, {d: ids_of(t, redacted(x)) for d, x in want.items()})


def test_every_stage_takes_hard_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (13, 0, 1)], "doc_id bigint, quality int, toxic int")
    path = as_tables(spark, tmp_path, labels=labels)
    for docs in (documents(spark), documents(spark, extra=True), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, path)
            if name != "packing":
                assert got.columns == docs.columns
            assert len(got.collect()) <= 1000


def test_groups_meet_as_the_stages_say(spark, tmp_path):
    rows = [(i, "the same words in the same order every time they are read") for i in range(50)]
    path = as_tables(spark, tmp_path, documents(spark, rows), labels=spark.createDataFrame([], "doc_id bigint, quality int"))
    pieces = corpus_pipeline.run(spark, path).collect()
    by = defaultdict(int)
    for p in pieces:
        by[p.doc_id] += p.length
    assert list(by) == [49]
