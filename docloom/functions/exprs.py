"""Small expression helpers shared by the operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built_once(builder: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a large expression for reuse by later queries of the same Spark application.

    Its arguments must be plain values (column names, settings), which become the key.
    """
    kept: dict[tuple, Column] = {}

    @functools.wraps(builder)
    def get(*args) -> Column:
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, *args)
        if key not in kept:
            kept[key] = builder(*args)
        return kept[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A projected column referenced inside a lambda is inlined by the optimizer and re-evaluated for
    every element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialise(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever later lambdas or filters refer to them.

    The expressions sit in a projection of their own, so they are compiled; the one-element
    ``inline`` above it is a Generate node, which neither projections nor predicates cross.
    """
    kept = [c for c in df.columns if c not in columns]
    staged = df.select(*kept, *[c.alias(name) for name, c in columns.items()])
    return staged.select(*kept, F.inline(F.array(F.struct(*columns))))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# Fixed value: the white space Python's str.strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_unicode(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


# The same white space as a class of a pattern.
WHITE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip_edges(v: Column) -> Column:
    """``strip_unicode``; trimming looks at every character, so only texts with an edge beyond ``!`` to ``~`` pay."""
    plain = lambda c: F.ascii(c).between(0x21, 0x7E)
    return F.when(plain(v) & plain(F.substring(v, -1, 1)), v).otherwise(strip_unicode(v))


def json_text(c: Column) -> Column:
    """A string column as a JSON string literal (null stays the JSON word null)."""
    item = F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)
    # Visible ASCII without quote and backslash needs no escape.
    plain = F.rlike(c, F.lit(r"\A[ !#-\[\]-~]*\z"))
    return F.when(c.isNull(), F.lit("null")).when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(item)


def float_text(c: Column) -> Column:
    """A double the way Python's str() prints it."""
    magnitude = F.abs(c)
    fixed = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    fixed = F.regexp_replace(fixed, r"\.$", ".0")
    spark_text = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(spark_text, "^([^E]+)", 1), r"\.0$", "")
    exponent = F.regexp_extract(spark_text, r"E(-?\d+)", 1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .when((magnitude == 0) | ((magnitude >= 1e-3) & (magnitude < 1e7)), spark_text)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), fixed)
        .otherwise(scientific)
    )


def python_float(c: Column) -> Column:
    """Text to double with Python's float() grammar; null where float() would refuse."""
    text = strip_unicode(c)
    digits = r"\d+(_\d+)*"
    number = rf"^[+-]?(({digits}\.?({digits})?)|(\.{digits}))([eE][+-]?{digits})?$"
    word = F.lower(text)
    return (
        F.when(text.rlike(number), F.regexp_replace(text, "_", "").try_cast("double"))
        .when(word.rlike(r"^\+?(inf|infinity)$"), F.lit(float("inf")))
        .when(word.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
        .when(word.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )
