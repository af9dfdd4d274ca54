import hashlib
from collections import Counter, defaultdict

import pytest
from compare import difference, duck

from pyspark.sql import functions as F

from docloom.llm import catalog, common, exact_dedup

from .helpers import HARD_TEXTS, as_tables, documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def norm(text):
    return (text or "").translate(LOWER)


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = Counter()
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known, default=None)
        kept = 0
        for d in ids:
            first = d == keep and not kept
            kept += first
            out[d, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("prefix", [1, 128])
def test_groups(spark, prefix):
    rows = exact_dedup.membership(exact_dedup.refined(documents(spark, extra=True), prefix)).collect()
    want = Counter({k[:4]: 0 for k in expected(HARD_TEXTS)})
    for k, n in expected(HARD_TEXTS).items():
        want[k[:4]] += n
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == want


def test_query_on_hard_rows(spark, tmp_path):
    got = catalog.op10_exact_dedup(spark, as_tables(spark, tmp_path, documents(spark))).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected(HARD_TEXTS)


def test_query_against_sql(spark, sf):
    assert difference(spark, duck(sf), "op10", catalog.op10_exact_dedup, catalog.ORACLES["op10_exact_dedup"], sf) is None


def test_dropping_keeps_columns_and_one_row_each(spark):
    docs = documents(spark, extra=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.schema == docs.schema
    want = sorted(str(k[0]) for k, n in expected(HARD_TEXTS).items() for _ in range(n) if k[3])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_hot_group_and_empty(spark):
    rows = [(i, "same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 3100)]
    kept = exact_dedup.drop_copies(documents(spark, rows)).collect()
    assert len(kept) == 101 and max(r.doc_id for r in kept if r.text == "same text") == 2999
    assert exact_dedup.drop_copies(empty(spark)).collect() == []
    assert exact_dedup.membership(exact_dedup.refined(empty(spark))).collect() == []


def test_filter_is_sized_by_its_keys(spark, monkeypatch):
    keys = spark.range(40_000).withColumn("k", F.col("id") * 7)
    other = spark.range(40_000).withColumn("k", -F.col("id") - 1)
    found = common.hash_filter(keys, F.col("k"))
    assert found.words == 10_000 and found.members.count() <= found.words
    assert common.flag(keys, found, F.col("k"), "f").filter("f").count() == 40_000
    assert common.flag(other, found, F.col("k"), "f").filter("f").count() < 0.04 * 40_000
    monkeypatch.setattr(common, "MOST_FILTER_WORDS", 100)  # a bound that is reached loses nothing
    full = common.hash_filter(keys, F.col("k"))
    assert full.words == 100 and common.flag(keys, full, F.col("k"), "f").filter("f").count() == 40_000


def test_clean_rows_stay_out_of_joins(spark, tmp_path):
    """Many short copies: clean texts aren't shuffled, and rows without a full hash meet in no key."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 20_000, F.concat(F.lit("copy "), F.expr("id div 2"))).otherwise(F.concat(F.lit("a clean text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"),
    )
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    rows = exact_dedup.refined(docs)
    assert rows.filter("doc_id >= 20000 AND full IS NOT NULL").count() < 400
    assert rows.filter("doc_id < 20000 AND full IS NULL").count() == 0
    plan = exact_dedup.membership(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter isnotnull(full") >= 2 and "Filter isnull(full" in plan
    kept = exact_dedup.drop_copies(docs)
    assert kept.count() == 20_000 and kept.filter("doc_id < 20000").agg(F.sum(F.col("doc_id") % 2)).first()[0] == 10_000
    free = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Union" in line]
    assert free


def test_main_path_is_native(spark, sf):
    plan = catalog.op10_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
