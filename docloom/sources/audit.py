"""Audit records and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.exprs import blank_to_null, materialise
from docloom.functions.text import basename, extension
from docloom.schemas import AUDIT


def utc_now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def audit_records(
    results: DataFrame,
    duration_ms: Column | float = 0.0,
    extra: dict[str, Column] | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """S7. D8 rows from results; ``extra`` columns are laid over the top level.

    A result is a HIT when no responder was used and a template is named, so a tolerated validation
    failure is a HIT too.
    """
    path = F.col("document_path")
    duration = duration_ms if isinstance(duration_ms, Column) else F.lit(float(duration_ms))
    record = {
        "ts": utc_now_iso() if ts is None else ts,
        "file": basename(path),
        "file_type": extension(path),
        "template_id": F.col("template_id"),
        "match_score": F.round("match_score", 4),
        "candidate_scores": F.transform_values("candidate_scores", lambda k, v: F.round(v, 4)),
        "result": F.when(
            ~F.col("llm_used") & (F.coalesce("template_id", F.lit("")) != ""), F.lit("HIT")
        ).otherwise(F.lit("MISS")),
        "llm_used": F.col("llm_used"),
        "llm_backend": F.col("llm_backend"),
        "llm_model": F.col("llm_model"),
        "validation_passed": F.col("validation_passed"),
        "validation_errors": F.col("validation_errors"),
        "field_count": F.col("field_count"),
        "duration_ms": F.round(duration, 1),
    }
    record.update(extra or {})
    return results.select(*[c.alias(name) for name, c in record.items()])


def append_audit(records: DataFrame, path: str) -> None:
    """S7, S10. JSON lines, appended."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


_KNOWN = [f.split()[0] for f in AUDIT.split(", ")]


def _extra(line: Column) -> Column:
    """Keys of an audit line beyond the known ones, values as JSON text; null where there are none."""
    others = F.map_filter(F.from_json(line, "map<string,string>"), lambda k, v: ~k.isin(_KNOWN))
    return F.when(F.size(others) > 0, others)


def parse_audit_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S8 on a ``value`` column of lines: (records, malformed lines); blank lines vanish.

    Keys a writer added (``extra`` of audit_records) come back in the map ``extra``.
    """
    stripped = lines.select(blank_to_null(F.trim("value")).alias("line")).filter("line is not null")
    # A step of its own: a filter on the record would otherwise parse the line again for each of its conditions.
    parsed = materialise(
        stripped,
        r=F.from_json(
            "line",
            f"{AUDIT}, _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ),
    )
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.col("line").startswith("{")
    good = parsed.filter(~broken).select("r.*", _extra(F.col("line")).alias("_extra")).drop("_corrupt")
    good = good.withColumn("extra", F.coalesce("_extra", "extra")).drop("_extra")
    return good, parsed.filter(broken).select("line")


def read_audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8. Every record below ``path``, and the malformed lines that were skipped."""
    return parse_audit_lines(spark.read.option("recursiveFileLookup", "true").text(path))


def write_results(results: DataFrame, path: str) -> None:
    """S9. One JSON object per result."""
    results.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
