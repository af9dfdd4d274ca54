"""Business documents rendered from the order tables, with the templates that read them.

Every order becomes one document. Its status picks the layout (German confirmation, German delivery
note, English invoice); its priority picks how complete the document is.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.exprs import built_once
from docloom.functions.text import normalise_text
from docloom.schemas import TEMPLATES
from docloom.session import shares

COMPANY = "Nordwind Handel KG"


def german_number(c: Column, places: int = 2) -> Column:
    return F.translate(F.format_number(c, places), ",.", ".,")


def _line_rows(lineitem: DataFrame, n: int) -> DataFrame:
    """Per order: its lines in a total order, each with its cells and their text; in ``n`` shares by order key.

    Plain columns meet by order key; cells and text are made after that, a line a row, as compiled expressions.
    """
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    cells = (
        F.col("l_linenumber").cast("string"),
        F.concat(F.lit("Art-"), F.col("l_partkey").cast("string")),
        F.col("l_quantity").cast("bigint").cast("string"),
        german_number(F.col("l_extendedprice")),
    )
    names = [f"_cell{i}" for i in range(len(cells))]
    # Steps of their own: cells are read by their list and their text, the aggregate reads a plain column.
    lines = lineitem.repartition(n, "l_orderkey").select("l_orderkey", *order, *[c.alias(n) for c, n in zip(cells, names)])
    line = F.struct(*order, F.concat_ws("   ", *names).alias("text"), F.array(*names).alias("cells"))
    return lines.select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("line")).alias("lines")
    )


def _parts() -> dict[str, Column]:
    """What several layouts of an order show: made in a step of its own, so that each is compiled once and no
    method grows too large to be compiled to machine code."""
    with_lines = F.col("o_orderstatus").isin("F", "O")
    return {
        "_key": F.col("o_orderkey").cast("string"),
        "_total": german_number(F.col("o_totalprice")),
        "_n_lines": F.coalesce(F.array_size("lines"), F.lit(0)).cast("string"),
        "_lines": F.when(with_lines, F.concat_ws("\n", F.lit("Pos  Artikel  Menge  Preis"), F.col("lines.text"))),
    }


@built_once
def _rendered() -> Column:
    """struct(full_text, _tables) of one order row."""
    key, total, n_lines, lines_text = (F.col(c) for c in ("_key", "_total", "_n_lines", "_lines"))
    status, family = F.col("o_orderstatus"), F.col("o_orderpriority")
    no_date = family.isin("2-HIGH", "3-MEDIUM")
    no_customer = family == "2-HIGH"
    half = family == "4-NOT SPECIFIED"
    cold = (family == "5-LOW") & (status == "P")
    cells = "array<array<array<string>>>"
    line_cells = F.coalesce(F.col("lines.cells"), F.array().cast("array<array<string>>"))
    german_day = F.date_format("o_orderdate", "dd.MM.yyyy")

    def when_kept(dropped: Column, text: Column) -> Column:
        return F.when(~dropped, text)

    sender = F.lit(f"Absender: {COMPANY}")
    confirmation = F.concat_ws(
        "\n",
        sender,
        F.concat(F.lit("Bestellung: "), key),
        when_kept(no_date | half, F.concat(F.lit("Bestelldatum: "), german_day)),
        when_kept(no_customer | half, F.concat(F.lit("Kunde: "), F.col("c_name"))),
        F.when(no_date | no_customer, F.lit("Bestelldatum fehlt, Kunde: offen")),
        when_kept(half, F.lit("Auftragsbestaetigung")),
        lines_text,
        F.concat(F.lit("Summe "), total, F.lit(" EUR")),
    )
    delivery = F.concat_ws(
        "\n",
        sender,
        F.concat(F.lit("Lieferschein Nr. "), key),
        when_kept(no_date | half, F.concat(F.lit("Liefertag "), F.date_format("o_orderdate", "d.M.yy"))),
        when_kept(no_customer | half, F.concat(F.lit("Empfaenger "), F.col("c_name"))),
        F.when(no_date | no_customer, F.lit("Liefertag offen; Empfaenger; fehlt")),
        when_kept(half, F.lit("Spedition frei Haus")),
        F.concat(F.lit("Packstuecke gesamt: "), n_lines),
        lines_text,
        F.concat(F.lit("Warenwert "), total),
        F.lit("Ende der Lieferung"),
    )
    invoice = F.concat_ws(
        "\n",
        sender,
        F.concat(F.lit("Invoice number: "), key),
        when_kept(no_date | half, F.concat(F.lit("Invoice date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))),
        when_kept(no_customer | half, F.concat(F.lit("Bill to: "), F.col("c_name"))),
        F.when(no_date | no_customer, F.lit("Invoice date pending; Bill to pending")),
        when_kept(half, F.lit("Payment terms: 30 days net")),
        F.concat(F.lit("Amount due: "), total),
        F.concat(F.lit("Line count: "), n_lines),
    )
    memo = F.concat_ws(
        "\n", sender, F.lit("Interne Notiz ohne Formular"), F.concat(F.lit("Vorgang "), key)
    )
    text = (
        F.when(cold, memo).when(status == "F", confirmation).when(status == "O", delivery).otherwise(invoice)
    )
    page_tables = F.when(
        (status == "P") & ~cold,
        F.array(
            F.concat(
                F.array(F.array(F.lit("No"), F.lit("Item"), F.lit("Qty"), F.lit("Amount"))),
                line_cells,
                F.array(F.array(F.lit("Total"), F.lit(""), F.lit(""), total)),
            )
        ),
    ).otherwise(F.array().cast(cells))
    return F.struct(text.alias("full_text"), page_tables.alias("_tables"))


def render_orders(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """D2 rows. Invoices carry their lines as a page table, the other layouts as text columns.

    ``files``: dealt to so many parts, by another hash than the one that deals a batch to the cores.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    # Customers come first, so that no lines travel by customer. Then both sides grow with the data: they meet by hash
    # of the order key, whatever their present size, in shares of a fixed number. All later steps run in these shares;
    # merged to the number of cores they would leave most cores waiting for the last one.
    n = shares(lineitem)
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).repartition(n, "o_orderkey")
    rows = named.join(_line_rows(lineitem, n).hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("_key")
    rendered = rows.withColumns(_parts()).select(
        key.alias("doc_id"),
        F.concat(
            F.lit("inbox/"), F.year("o_orderdate").cast("string"), F.lit("/order-"), key, F.lit(".pdf")
        ).alias("path"),
        F.lit("pdf").alias("file_type"),
        F.inline(F.array(_rendered())),
    )
    if files:  # each text travels once, not as the three columns made of it below
        rendered = rendered.repartition(files, F.xxhash64("doc_id"))
    return (
        rendered.select(
            "doc_id",
            "path",
            "file_type",
            "full_text",
            F.array(
                F.struct(
                    F.lit(1).alias("page_num"),
                    F.col("full_text").alias("text"),
                    F.col("_tables").alias("tables"),
                    F.lit("").alias("sheet_name"),
                )
            ).alias("pages"),
            F.array().cast("array<string>").alias("sheet_names"),
        )
    ).withColumn("normalised_text", normalise_text(F.col("full_text")))


def _rule(field, type="string", regex=None, anchor=None, stop=None, columns=None, strip=None, fmt=None):
    return {
        "field": field,
        "type": type,
        "regex": regex,
        "anchor_regex": anchor,
        "stop_regex": stop,
        "columns": columns,
        "strip_chars": strip,
        "date_format": fmt,
    }


def _check(field, not_null=False, gt=None, lt=None, regex_match=None):
    return {"field": field, "not_null": not_null, "gt": gt, "lt": lt, "regex_match": regex_match}


LINE_COLUMNS = ["pos", "article", "quantity", "amount"]
BIG_ORDER = 450000.0


def order_templates() -> list[dict]:
    """The three document types of the rendered corpus."""
    return [
        {
            "template_id": "confirmation_v1",
            "required_keywords": ["Bestellung:", "Bestelldatum", "Kunde:", "Auftragsbestaetigung", "Summe"],
            "supplier_hint": COMPANY,
            "doc_type": "order_confirmation",
            "keyword_quorum": 0.6,
            "rules": [
                _rule("order_number", regex=r"Bestellung: *([0-9]+)"),
                _rule("order_date", "date", r"Bestelldatum:\s*(\d{2}\.\d{2}\.\d{4})", fmt="%d.%m.%Y"),
                _rule("customer", regex=r"Kunde:\s*(Customer#\d+)"),
                _rule("total", "decimal", r"Summe +([0-9.,]*[0-9]) EUR"),
                _rule("articles", "list", r"Art-(\d+)"),
                _rule("lines", "table", anchor=r"Pos\s+Artikel", stop=r"^Summe", columns=LINE_COLUMNS),
            ],
            "checks": [
                _check("order_number", True, regex_match=r"\d+$"),
                _check("order_date", True),
                _check("customer", True),
                _check("total", True, gt=0.0, lt=BIG_ORDER),
            ],
        },
        {
            "template_id": "delivery_v1",
            "required_keywords": ["Lieferschein", "Liefertag", "Empfaenger", "Spedition", "Packstuecke"],
            "supplier_hint": COMPANY,
            "doc_type": "delivery_note",
            "keyword_quorum": 0.6,
            "rules": [
                _rule("order_number", regex=r"^Lieferschein Nr\.\s*(\d+)$"),
                _rule("order_date", "date", r"Liefertag\s+(\d{1,2}\.\d{1,2}\.\d{2,4})"),
                _rule("customer", regex=r"Empfaenger\s+(Customer.\d+)", strip="#"),
                _rule("total", "decimal", r"Warenwert\s+([\d\.,]+)"),
                _rule("line_count", "integer", r"Packstuecke gesamt:\s*(\d+)"),
                _rule("lines", "table", anchor=r"Pos\s+Artikel", stop=r"^Warenwert", columns=LINE_COLUMNS),
            ],
            "checks": [
                _check("order_number", True),
                _check("order_date", True, regex_match=r"\d{4}-\d{2}-\d{2}"),
                _check("customer", True),
                _check("line_count", True, gt=0.0),
                _check("total", lt=BIG_ORDER),
            ],
        },
        {
            "template_id": "invoice_v1",
            "required_keywords": ["Invoice number", "Invoice date", "Bill to", "Payment terms", "Amount due"],
            "supplier_hint": "",
            "doc_type": "invoice",
            "keyword_quorum": 0.8,
            "rules": [
                _rule("order_number", regex=r"Invoice number:\s*(\d+)"),
                _rule("order_date", "date", r"Invoice date:\s*(\d{4}-\d{2}-\d{2})", fmt="%Y-%m-%d"),
                _rule("customer", regex=r"Bill to:\s*(Customer#\d+)"),
                _rule("total", "decimal", r"Amount due:\s*([\d\.]+,\d{2})"),
                _rule("line_count", "integer", r"Line count:\s*(\d+)"),
                _rule("lines", "table", anchor=r"Item\s+Qty", stop=r"^Total", columns=LINE_COLUMNS),
            ],
            "checks": [
                _check("order_number", True),
                _check("order_date", True),
                _check("customer", True),
                _check("total", True, lt=BIG_ORDER),
                _check("line_count", gt=0.0),
            ],
        },
    ]


def licence_templates() -> list[dict]:
    """Templates for free texts: licence notices, mail addresses and languages."""

    def t(template_id, keywords, quorum=0.6, rules=(), checks=()):
        return {
            "template_id": template_id,
            "required_keywords": list(keywords),
            "supplier_hint": "",
            "doc_type": "text",
            "keyword_quorum": quorum,
            "rules": list(rules),
            "checks": list(checks),
        }

    return [
        t(
            "apache_v1",
            ["Licensed under the", "Apache License", "Version"],
            rules=[
                _rule("version", regex=r"Apache License, Version ([\d.]+)", strip="."),
                _rule("mails", "list", r"[\w.]+@[\w.]+\.\w+"),
            ],
            checks=[_check("version", True, gt=1.0, lt=10.0)],
        ),
        t("mit_v1", ["Released under", "MIT License"], rules=[_rule("licence", regex=r"the (MIT) License")]),
        t("gpl_v1", ["licensed under the", "GNU General", "Public License", "version"]),
        t("cc_v1", ["Licensed under", "BY-NC"], rules=[_rule("version", regex=r"BY-NC ([\d.]+)")]),
        t("english_v1", [" the ", " and ", " that ", "with", "from"], 0.8),
        t("german_v1", [" der ", " und ", " nicht ", "für", " ein "], 0.8),
        t("french_v1", [" les ", " que ", " dans ", "avec", "pour"], 0.8),
        t("repeated_v1", ["example.com", "EXAMPLE.com", "mail"], 0.9),
        t("blank_v1", []),
    ]


def as_store(spark: SparkSession, templates: list[dict], snapshot_id: int = 0) -> DataFrame:
    """A template snapshot from plain records, in their order."""
    stamp = datetime.datetime(2024, 1, 1)
    rows = [
        {
            "seq": i,
            "snapshot_id": snapshot_id,
            "metadata": {},
            "version": 1,
            "created_at": stamp,
            "updated_at": stamp,
            "hit_count": 0,
            **t,
        }
        for i, t in enumerate(templates)
    ]
    return spark.createDataFrame(rows, TEMPLATES)
