"""Connected components of a graph given as an edge table, by contraction.

Each round ranks the vertices by a fresh hash, points every vertex at its lowest-ranked neighbour (or itself),
writes that map, and replaces the edges by the edges between images; maps compose to the final label. Fresh
ranks shrink any graph by a constant factor a round, long paths too. Nothing is gathered: all steps are
aggregations and joins of narrow tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import through_table


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b bigint); root is one vertex of its component."""
    live = through_table(_proper(edges), "cc-edges")
    labels, turn = None, 0
    while not live.isEmpty():
        turn += 1
        ranked = lambda v: F.struct(F.xxhash64(v, F.lit(turn)).alias("rank"), F.col(v).alias("v"))  # noqa: B023, E731
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
        step = step.select(F.col("a").alias("v"), F.least("best", ranked("a"))["v"].alias("to"))
        step = through_table(step, "cc-step")
        # two jumps at once: where to, and where that points
        jump = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
        step = through_table(
            step.join(jump, "to", "left").select("v", F.coalesce("next", "to").alias("to")), "cc-jump"
        )
        if labels is None:
            labels = step.select("v", F.col("to").alias("root"))
        else:
            on = step.select(F.col("v").alias("root"), "to")
            labels = labels.join(on, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        labels = through_table(labels, "cc-labels")
        a = step.select(F.col("v").alias("a"), F.col("to").alias("ra"))
        b = step.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        moved = live.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        live = through_table(_proper(moved), "cc-edges")
    if labels is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels


def _proper(edges: DataFrame) -> DataFrame:
    """Smaller end first, no loops, each edge once."""
    return (
        edges.filter("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
