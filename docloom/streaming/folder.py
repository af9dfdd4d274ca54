"""Incremental folder run (S13): documents are matched, extracted and audited as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import EngineConfig
from docloom.operators.dimension import Dimension, as_dimension
from docloom.plans.batch import run_batch
from docloom.schemas import DOCS
from docloom.session import spread
from docloom.sources.audit import audit_records


def run_folder(
    spark: SparkSession,
    source: str,
    store: DataFrame | Dimension,
    out: str,
    checkpoint: str,
    cfg: EngineConfig = EngineConfig(),
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process every parquet file of D2 rows not seen before, then stop.

    Each micro-batch writes results, audit and hit counts below its own ``batch_id=`` folder and
    overwrites that folder when it is replayed, so a restart repeats nothing. A batch of fewer files than there are
    cores is dealt to all of them.
    """
    dim = as_dimension(store, cfg)
    reader = spark.readStream.schema(DOCS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        part = f"batch_id={batch_id}"
        run_batch(spread(batch, "doc_id"), dim, cfg).write.mode("overwrite").parquet(f"{out}/results/{part}")
        results = session.read.parquet(f"{out}/results/{part}")
        audit_records(results).write.mode("overwrite").option("ignoreNullFields", "false").json(
            f"{out}/audit/{part}"
        )
        results.filter(F.col("route") == "HIT_PASS").groupBy("template_id").agg(
            F.count("*").alias("hits")
        ).write.mode("overwrite").parquet(f"{out}/hits/{part}")

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hit_deltas(spark: SparkSession, out: str) -> DataFrame:
    """Hits per template over all batches, ready to be added to the next snapshot."""
    return (
        spark.read.parquet(f"{out}/hits").groupBy("template_id").agg(F.sum("hits").alias("hits"))
    )
