"""Documents from page rows and from sheet cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.exprs import materialise
from docloom.functions.text import normalise_text


def _text_cells(tables: Column) -> Column:
    """Null cells to empty text."""
    filled = F.transform(
        tables,
        lambda table: F.transform(
            table, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit("")))
        ),
    )
    return F.coalesce(filled, F.array().cast("array<array<array<string>>>"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """S3. One document per doc_id: page texts joined by newline in page order, numbered from 1."""
    grouped = pages.groupBy("doc_id").agg(
        F.first("path").alias("path"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "page_num",
                    F.coalesce("text", F.lit("")).alias("text"),
                    _text_cells(F.col("tables")).alias("tables"),
                )
            )
        ).alias("_pages"),
    )
    joined = materialise(
        grouped, full_text=F.array_join(F.transform("_pages", lambda p: p["text"]), "\n")
    )
    return joined.select(
        "doc_id",
        "path",
        F.lit("pdf").alias("file_type"),
        "full_text",
        normalise_text(F.col("full_text")).alias("normalised_text"),
        F.transform(
            "_pages",
            lambda p, i: F.struct(
                (i + 1).alias("page_num"),
                p["text"].alias("text"),
                p["tables"].alias("tables"),
                F.lit("").alias("sheet_name"),
            ),
        ).alias("pages"),
        F.array().cast("array<string>").alias("sheet_names"),
    )


def assemble_sheets(cells: DataFrame) -> DataFrame:
    """S4. One document per doc_id from (sheet, row, column, value) cells; indexes start at 0.

    Rows are built first, then sheets, then documents, so a large workbook is put together by many
    tasks and only its finished sheets meet in one row. Of a cell given twice the smallest value stays.
    """
    rows = cells.groupBy("doc_id", "sheet_idx", "row_idx").agg(
        F.first("path").alias("path"),
        F.first("sheet_name").alias("sheet_name"),
        F.max("col_idx").alias("last_col"),
        F.array_sort(F.collect_set(F.struct("col_idx", F.coalesce("value", F.lit("")).alias("value")))).alias("_cells"),
    )
    first_of_cell = lambda c, i: (i == 0) | (F.get("_cells", i - 1)["col_idx"] != c["col_idx"])
    rows = materialise(rows, cells=F.map_from_entries(F.filter("_cells", first_of_cell))).drop("_cells")
    # Every row of a sheet is as wide as its widest row, blanks included.
    sheets = rows.groupBy("doc_id", "sheet_idx").agg(
        F.first("path").alias("path"),
        F.first("sheet_name").alias("sheet_name"),
        F.max("last_col").alias("last_col"),
        F.collect_list(F.struct("row_idx", "cells")).alias("_rows"),
    )
    ordered = F.array_sort(
        F.col("_rows"), lambda a, b: (a["row_idx"] - b["row_idx"]).cast("int")
    )
    dense = F.transform(
        ordered,
        lambda r: F.transform(
            F.sequence(F.lit(0), F.col("last_col")),
            lambda c: F.coalesce(F.try_element_at(r["cells"], c), F.lit("")),
        ),
    )
    filled = materialise(
        sheets, _rows=F.filter(dense, lambda row: F.exists(row, lambda c: c != ""))
    )
    texts = materialise(
        filled,
        _text=F.array_join(F.transform("_rows", lambda row: F.array_join(row, "  ")), "\n"),
    )
    docs = texts.groupBy("doc_id").agg(
        F.first("path").alias("path"),
        F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet_name", "_text", "_rows"))).alias("_sheets"),
    )
    joined = materialise(
        docs,
        full_text=F.array_join(
            F.transform(
                "_sheets",
                lambda s: F.concat(F.lit("[Sheet: "), s["sheet_name"], F.lit("]\n"), s["_text"]),
            ),
            "\n",
        ),
    )
    return joined.select(
        "doc_id",
        "path",
        F.lit("xlsx").alias("file_type"),
        "full_text",
        normalise_text(F.col("full_text")).alias("normalised_text"),
        F.transform(
            "_sheets",
            lambda s, i: F.struct(
                (i + 1).alias("page_num"),
                s["_text"].alias("text"),
                F.array(s["_rows"]).alias("tables"),
                s["sheet_name"].alias("sheet_name"),
            ),
        ).alias("pages"),
        F.transform("_sheets", lambda s: s["sheet_name"]).alias("sheet_names"),
    )
