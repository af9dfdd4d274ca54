"""One large JSON object as rows of its members, read and written in parallel.

A string of valid JSON holds no line break, so each line tells by itself how far it opens or closes braces.
Sums of that, first per split of the file, then within the split, give the depth at which each line begins.
A line that begins at the object's own depth with a quote opens a member; lines up to the next such line are
parsed together. Members may span lines and splits. Several members on one line, or commas in front of lines,
are read as well, but what has no line break between members is parsed by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.exprs import json_text, materialise


def _braces(line: Column) -> Column:
    """How many braces and brackets a line opens more than it closes; null where a string stays open."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\\.", ""), '"[^"]*"', "")
    opens = F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))
    return F.when(~bare.contains('"'), opens.cast("bigint"))


def _before(column: str, order: list[Column], part: list[str]) -> Column:
    """The sum of ``column`` over the rows before this one."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def _lines(spark: SparkSession, path: str, what: str) -> DataFrame:
    """(split, line, value, braces, depth, total) of every line that isn't blank.

    ``split`` numbers the splits in file order: one row for each split, not for each line, meets in one task.
    """
    raw = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    told = raw.filter(F.trim("value") != "").withColumn(
        "braces", F.coalesce(_braces(F.col("value")), F.raise_error(F.lit(f"malformed {what}")))
    )
    sizes = told.groupBy("file", "start").agg(F.sum("braces").alias("sum"))
    order = [F.length("file"), F.col("file"), F.col("start")]
    splits = sizes.select(
        "file",
        "start",
        F.row_number().over(Window.orderBy(*order)).alias("split"),
        _before("sum", order, []).alias("outer"),
        F.sum("sum").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("split").orderBy("row")
    return told.join(splits, ["file", "start"]).select(
        "split",
        F.row_number().over(within).alias("line"),
        "value",
        "braces",
        (F.col("outer") + _before("braces", [F.col("row")], ["split"])).alias("depth"),
        "total",
    )


def members(spark: SparkSession, path: str, value_type: str, what: str = "JSON object") -> DataFrame:
    """(pos, key, value) of each member of the object at ``path``; ``pos`` counts from 0 in the object's order.

    ``path`` is a file, or a folder whose files hold the object's pieces in the order of their names. Anything
    but one whole object is an error, as is a value that isn't of ``value_type``.
    """
    at = F.struct("split", "line")
    opens = (F.col("depth") <= 0) | (F.col("depth") == 1) & F.ltrim("value").startswith('"')
    lines = _lines(spark, path, what).withColumn("opens", F.when(opens, at))
    upto = Window.partitionBy("split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lines.groupBy("split")
        .agg(F.max("opens").alias("last"))
        .select("split", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    )
    pieces = (
        lines.withColumn("own", F.last("opens", ignorenulls=True).over(upto))
        .join(carried, "split")
        .groupBy(F.coalesce("own", "carried").alias("at"))
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "line", "value"))), lambda x: x["value"]), "\n").alias("text"),
            F.min("depth").alias("least"),
            F.min_by("depth", at).alias("depth"),
            F.sum("braces").alias("braces"),
            F.first("total").alias("total"),
        )
    )
    parsed = materialise(pieces, m=F.map_entries(_parsed(value_type, what)))
    sized = parsed.select(F.col("at.split").alias("split"), F.col("at.line").alias("line"), "m").withColumn("n", F.size("m"))
    outer = sized.groupBy("split").agg(F.sum("n").alias("n"))
    outer = outer.select("split", _before("n", [F.col("split")], []).alias("outer"))
    placed = sized.join(outer, "split").withColumn("before", F.col("outer") + _before("n", [F.col("line")], ["split"]))
    return placed.select("before", F.posexplode("m").alias("pos", "kv")).select(
        (F.col("before") + F.col("pos")).cast("bigint").alias("pos"), F.col("kv.key").alias("key"), F.col("kv.value").alias("value")
    )


def _parsed(value_type: str, what: str) -> Column:
    """The members of a piece as a map; the object's own braces and the commas between pieces are taken off."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    first = (F.col("at.split") == 1) & (F.col("at.line") == 1)
    opened, closed = F.col("depth") == 0, F.col("depth") + F.col("braces") == 0
    inner = F.when(opened, F.substring(text, 2, 2**31 - 1)).otherwise(text)
    last = F.substring(text, -1, 1)
    fault = (
        (F.col("total") != 0)
        | (F.col("least") < 0)
        | (opened != first)
        | (first & ~text.startswith("{"))
        | (closed & (last != "}"))
        | (~closed & (last != ",") & (text != "{"))
    )
    body = F.when(text == "{", F.lit("")).otherwise(F.substring(inner, F.lit(1), F.length(inner) - 1))
    m = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string,{value_type}>", {"mode": "FAILFAST"})
    error = F.raise_error(F.lit(f"malformed {what}"))
    return F.when(F.coalesce(fault, F.lit(True)), error).otherwise(F.coalesce(m, error))


def write_object(rows: DataFrame, path: str) -> None:
    """(seq, key, entry) rows as one JSON object, a member a line, in the order of ``seq``, then key.

    A range sort lays the lines out over the files of the folder; only the two ends carry a brace.
    """
    at = F.struct("seq", "key")
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if ends["low"] is None:
        rows.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.text(path)
        return

    def is_at(end) -> Column:
        return F.col("seq").eqNullSafe(F.lit(end["seq"])) & F.col("key").eqNullSafe(F.lit(end["key"]))

    line = F.concat(
        F.when(is_at(ends["low"]), "{").otherwise(""),
        json_text(F.col("key")),
        F.lit(": "),
        F.col("entry"),
        F.when(is_at(ends["high"]), "}").otherwise(","),
    )
    rows.orderBy("seq", "key").select(line.alias("value")).write.text(path)
