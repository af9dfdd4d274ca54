"""Scalar text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker that precedes each sheet in a workbook's text, and the character
# boundaries at which a space is inserted before fingerprint matching.
SHEET_MARKER = r"(?U)\[Sheet:[^\]]*\]\s*"
BOUNDARIES = r"[a-z](?=[A-Z])|\p{Nd}(?=[A-Za-z])|[A-Za-z](?=\p{Nd})"


def strip_sheet_markers(text: Column) -> Column:
    """P2. The substring test keeps the regex away from texts without any marker."""
    return F.when(
        F.contains(text, F.lit("[Sheet:")), F.regexp_replace(text, SHEET_MARKER, " ")
    ).otherwise(text)


def normalise_text(text: Column) -> Column:
    """P1. Space at case and digit/letter boundaries, runs of spaces collapsed, newlines kept.

    The three boundary kinds never share a character pair, so one pass with a look-ahead inserts
    the same spaces as one pass per kind.
    """
    spaced = F.regexp_replace(strip_sheet_markers(text), BOUNDARIES, "$0 ")
    return F.regexp_replace(spaced, "  +", " ")


def fold(text: Column) -> Column:
    """P3. Case fold used on both sides of every containment test."""
    return F.lower(text)


def preview(text: Column, n: int) -> Column:
    """P4. First n characters, with an ellipsis where something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def span_preview(text: Column, n: int = 500) -> Column:
    """P4. First n characters without a mark."""
    return F.substring(text, 1, n)


def basename(path: Column) -> Column:
    """P5."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """P5. Suffix without its dot, case kept; a leading dot alone is not a suffix."""
    return F.regexp_extract(basename(path), r"(?s)^.+\.([^.]+)$", 1)
