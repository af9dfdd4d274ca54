"""A folder run whose store moves on (S13): learnt templates serve the next documents, and earlier misses too.

Snapshots become visible by an entry in a manifest, written after the snapshot itself. Every micro-batch takes
the newest committed snapshot and records which, before it does anything: replayed, it uses that one again.
Documents that found no template are kept as a set of their own; ``rematch_misses`` matches all sets that no
earlier re-match has taken against the newest snapshot and leaves what still misses as the next set. Which sets
it takes is recorded first as well, so a run that was killed gives the same results when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import EngineConfig
from docloom.operators.dimension import Dimension, load
from docloom.plans.batch import COLD_MISS, NEAR_MISS, extract_documents, route_documents
from docloom.schemas import DOCS
from docloom.session import drop_path, new_path, spread
from docloom.sources.audit import audit_records
from docloom.sources.store import load_snapshot, save_snapshot

MANIFEST = "manifest"
MISSED = (NEAR_MISS, COLD_MISS)


def commit_snapshot(templates: DataFrame, folder: str, snapshot_id: int) -> None:
    """Write a snapshot and then make it visible to running streams."""
    save_snapshot(templates, folder, snapshot_id)
    entry = templates.sparkSession.range(1).select(F.lit(snapshot_id).cast("bigint").alias("committed"))
    entry.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def latest_snapshot(spark: SparkSession, folder: str) -> int:
    """The newest committed snapshot; a folder without one is an error."""
    found = spark.read.schema("committed bigint").parquet(f"{folder.rstrip('/')}/{MANIFEST}")
    newest = found.agg(F.max("committed")).first()[0]
    if newest is None:
        raise ValueError(f"no committed snapshot in {folder}")
    return newest


def _exists(spark: SparkSession, path: str) -> bool:
    """Written to its end: Spark's writers leave their mark last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _recorded(choice: DataFrame, path: str) -> DataFrame:
    """``choice`` as it was when it was first asked for."""
    if not _exists(choice.sparkSession, path):
        choice.write.mode("overwrite").parquet(path)
    return choice.sparkSession.read.schema(choice.schema).parquet(path)


def _settle(docs: DataFrame, dim: Dimension, snapshot_id: int, out: str, part: str, cfg: EngineConfig) -> None:
    """Results, audit and misses of some documents, below ``part`` of each table; replaced when repeated."""
    session = docs.sparkSession
    missed = F.col("route").isin(*MISSED)
    whole = F.when(missed, F.struct(*[c for c in docs.columns if c != "doc_id"]))
    found = extract_documents(docs, dim, cfg).withColumn("_doc", whole).withColumn("as_of", F.lit(snapshot_id).cast("bigint"))
    settled = route_documents(found, carry=("as_of", "_doc"))
    both = new_path(session, "moving")
    _packed(settled).parquet(both)
    try:
        routed = session.read.schema(settled.schema).parquet(both)
        _packed(routed.drop("_doc")).parquet(f"{out}/results/{part}")
        results = session.read.parquet(f"{out}/results/{part}")
        records = audit_records(results.drop("as_of"))
        # JSON text is by far the largest of the tables: Spark reads it compressed as well
        records.write.mode("overwrite").options(ignoreNullFields="false", compression="gzip").json(f"{out}/audit/{part}")
        _packed(routed.filter(missed).select("doc_id", "_doc.*")).parquet(f"{out}/misses/{part}")
    finally:
        drop_path(session, both)


def _packed(rows: DataFrame) -> DataFrameWriter:
    """Tables of a stream stay: they are kept small."""
    return rows.write.mode("overwrite").option("compression", "zstd")


def run_moving_folder(
    spark: SparkSession,
    source: str,
    snapshots: str,
    out: str,
    checkpoint: str,
    cfg: EngineConfig = EngineConfig(),
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process every parquet file of D2 rows not seen before against the newest committed snapshot, then stop.

    A snapshot committed while the run is on serves from the next micro-batch.
    """
    reader = spark.readStream.schema(DOCS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    known: dict[int, Dimension] = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = session.range(1).select(F.lit(latest_snapshot(session, snapshots)).cast("bigint").alias("as_of"))
        used = _recorded(newest, f"{out}/used/batch_id={batch_id}").first()["as_of"]
        if used not in known:
            known.clear()
            known[used] = load(load_snapshot(session, snapshots, used), cfg)
        _settle(spread(batch, "doc_id"), known[used], used, out, f"part=batch-{batch_id}", cfg)

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _taken(spark: SparkSession, out: str) -> DataFrame:
    """part, by: sets of misses that a re-match has taken."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/taken")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "part string, by bigint")
    return spark.read.schema("part string").option("basePath", f"{out}/taken").parquet(f"{out}/taken/by=*").select(
        "part", F.col("by").cast("bigint").alias("by")
    )


def rematch_misses(spark: SparkSession, snapshots: str, out: str, cfg: EngineConfig = EngineConfig()) -> int:
    """Match the waiting misses against the newest committed snapshot; returns that snapshot.

    Misses that already met it are left alone, so asking twice changes nothing.
    """
    newest = latest_snapshot(spark, snapshots)
    seen = spark.read.parquet(f"{out}/results").groupBy("part").agg(F.max("as_of").alias("as_of"))
    before = _taken(spark, out).filter(F.col("by") != newest).select("part")
    waiting = seen.filter(F.col("as_of") < newest).join(before, "part", "left_anti").select("part")
    parts = [r["part"] for r in _recorded(waiting, f"{out}/taken/by={newest}").collect()]  # one per batch at most
    if parts:
        docs = spark.read.parquet(*[f"{out}/misses/part={p}" for p in sorted(parts)])
        dim = load(load_snapshot(spark, snapshots, newest), cfg)
        _settle(docs, dim, newest, out, f"part=rematch-{newest}", cfg)
    return newest


def current_results(spark: SparkSession, out: str) -> DataFrame:
    """Every document's newest result: misses of sets that a re-match has taken give way to its results."""
    results = spark.read.parquet(f"{out}/results")
    taken = F.broadcast(_taken(spark, out).select("part").distinct().withColumn("_taken", F.lit(True)))  # a row per batch
    joined = results.join(taken, "part", "left")
    return joined.filter(~(F.coalesce("_taken", F.lit(False)) & F.col("route").isin(*MISSED))).drop("_taken", "part")


def current_hits(spark: SparkSession, out: str) -> DataFrame:
    """Hits per template over all newest results, ready to be added to the next snapshot."""
    passed = current_results(spark, out).filter(F.col("route") == "HIT_PASS")
    return passed.groupBy("template_id").agg(F.count("*").alias("hits"))
