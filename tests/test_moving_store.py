"""A stream whose store moves on: snapshots, replays and re-matching."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom import catalog, corpus
from docloom.operators.dimension import load
from docloom.plans.batch import run_batch
from docloom.sources import audit
from docloom.sources.store import save_snapshot
from docloom.streaming import moving

ABOUT = ["doc_id", "template_id", "route", "match_score", "data_json", "validation_errors"]


def seen(df):
    return sorted(map(str, df.select(ABOUT).collect()))


@pytest.fixture()
def setting(spark, sf, tmp_path):
    docs = corpus.render_orders(spark, sf).filter(F.col("doc_id").cast("int") < 120)
    stored = corpus.as_store(spark, corpus.order_templates())
    source, snapshots, out = (str(tmp_path / x) for x in ("in", "snapshots", "out"))
    moving.commit_snapshot(stored.filter("seq = 0"), snapshots, 1)
    docs.repartition(2, "doc_id").write.parquet(source)
    run = lambda: moving.run_moving_folder(spark, source, snapshots, out, f"{out}/checkpoint", files_per_batch=1).awaitTermination()
    return docs, stored, snapshots, out, run


def test_killed_and_restarted_run_gives_the_same_and_misses_meet_the_new_store(spark, setting, monkeypatch):
    docs, stored, snapshots, out, run = setting
    plain, calls = moving.audit_records, []

    def fails_in_the_second_batch(results):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return plain(results)

    monkeypatch.setattr(moving, "audit_records", fails_in_the_second_batch)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(moving, "audit_records", plain)
    save_snapshot(stored, snapshots, 3)  # written, but never committed
    moving.commit_snapshot(stored, snapshots, 2)
    run()  # the batch that was killed has begun with snapshot 1 and ends with it
    first = moving.current_results(spark, out)
    assert {r["as_of"] for r in first.select("as_of").distinct().collect()} == {1}
    assert seen(first) == seen(run_batch(docs, load(stored.filter("seq = 0"))))
    assert moving.rematch_misses(spark, snapshots, out) == 2
    want = seen(run_batch(docs, load(stored)))
    assert seen(moving.current_results(spark, out)) == want != seen(first)
    assert moving.rematch_misses(spark, snapshots, out) == 2  # asked twice
    assert seen(moving.current_results(spark, out)) == want
    passed = moving.current_results(spark, out).filter("route = 'HIT_PASS'").count()
    assert moving.current_hits(spark, out).agg(F.sum("hits")).first()[0] == passed
    records, bad = audit.read_audit(spark, f"{out}/audit")
    assert bad.count() == 0 and records.count() > 120  # re-matched documents have a record of either match


def test_killed_rematch_is_repeated_and_new_misses_are_taken_later(spark, setting, monkeypatch):
    docs, stored, snapshots, out, run = setting
    run()
    moving.commit_snapshot(stored.filter("seq < 2"), snapshots, 2)
    plain = moving.audit_records
    monkeypatch.setattr(moving, "audit_records", lambda results: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        moving.rematch_misses(spark, snapshots, out)
    monkeypatch.setattr(moving, "audit_records", plain)
    moving.rematch_misses(spark, snapshots, out)
    two = run_batch(docs, load(stored.filter("seq < 2")))
    assert seen(moving.current_results(spark, out)) == seen(two)
    moving.commit_snapshot(stored, snapshots, 4)
    assert moving.rematch_misses(spark, snapshots, out) == 4
    assert seen(moving.current_results(spark, out)) == seen(run_batch(docs, load(stored)))


def test_no_committed_snapshot_is_an_error(spark, tmp_path):
    save_snapshot(corpus.as_store(spark, corpus.order_templates()), str(tmp_path), 1)
    with pytest.raises(Exception):
        moving.latest_snapshot(spark, str(tmp_path))


def _files(folder):
    return [f for f in Path(folder).rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]


def test_a_stream_keeps_its_tables_small_and_nothing_between(spark, setting, monkeypatch):
    docs, stored, snapshots, out, run = setting
    made = []
    plain = moving.new_path
    monkeypatch.setattr(moving, "new_path", lambda *a: made.append(plain(*a)) or made[-1])
    run()
    moving.commit_snapshot(stored, snapshots, 2)
    moving.rematch_misses(spark, snapshots, out)
    assert len(made) == 3 and not any(Path(m).exists() for m in made)
    assert all(f.name.endswith(".json.gz") for f in _files(f"{out}/audit"))
    assert all(f.name.endswith(".zstd.parquet") for t in ("results", "misses") for f in _files(f"{out}/{t}"))
    assert seen(moving.current_results(spark, out)) == seen(run_batch(docs, load(stored)))


def test_files_of_an_inbox_leave_no_shuffle_behind(spark, tmp_path, sf):
    left = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle")}
    docs, name = catalog._orders_in_files(spark, sf), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = left(), spark.conf.get(name, None)
    catalog._write_files(docs, f"{tmp_path}/inbox")
    assert not left() - before and spark.conf.get(name, None) == set_before
    files = _files(f"{tmp_path}/inbox")
    assert len(files) == 2 * spark.sparkContext.defaultParallelism and all(".zstd." in f.name for f in files)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/inbox").collect())) == sorted(map(str, corpus.render_orders(spark, sf).collect()))
    text = docs.filter("length(doc_id) > 2")._jdf.queryExecution().optimizedPlan().toString()
    dealt = text.split("RepartitionByExpression")[0]
    assert "normalised_text" in dealt and "Filter" not in dealt  # made of the text where it arrives; dropped rows don't travel
