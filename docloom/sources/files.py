"""File discovery and type dispatch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import extension

# What a folder run picks up, in this order.
FOLDER_PATTERNS = ("*.pdf", "*.xlsx")


def discover(
    spark: SparkSession, folder: str, patterns: tuple[str, ...] = FOLDER_PATTERNS, require: bool = True
) -> DataFrame:
    """S1. Files directly in ``folder`` matching a pattern; the content column is never read."""
    found = reduce(
        DataFrame.unionByName,
        [
            spark.read.format("binaryFile")
            .option("pathGlobFilter", p)
            .load(folder)
            .select(F.lit(i).alias("listing"), "path", "length", "modificationTime")
            for i, p in enumerate(patterns)
        ],
    )
    if require and found.isEmpty():
        raise FileNotFoundError(f"no file matching {', '.join(patterns)} in {folder}")
    return found


def file_type(path: Column) -> Column:
    """S2. pdf or xlsx by lower-cased suffix, null when unsupported."""
    suffix = F.lower(extension(path))
    return F.when(suffix == "pdf", F.lit("pdf")).when(suffix.isin("xlsx", "xls"), F.lit("xlsx"))


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2. (supported files with ``file_type``, rejected files with ``reason``)."""
    typed = files.withColumn("file_type", file_type(F.col("path")))
    rejected = typed.filter(F.col("file_type").isNull()).withColumn(
        "reason",
        F.concat(
            F.lit("Unsupported file type: "),
            F.when(extension(F.col("path")) != "", F.concat(F.lit("."), F.lower(extension(F.col("path"))))).otherwise(""),
        ),
    )
    return typed.filter(F.col("file_type").isNotNull()), rejected.drop("file_type")
