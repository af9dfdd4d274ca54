"""Order and sheet queries on rows of their own: same results with fewer shuffles, parses and interpreted steps."""

import datetime
import io
import json
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from docloom import catalog, corpus
from docloom.functions.exprs import json_text, strip_edges
from docloom.operators import extraction, matching
from docloom.session import SHARES_A_SPLIT, shares
from docloom.sources import audit
from docloom.streaming.folder import run_folder

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string"
)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def sheets(spark, folder):
    rows = [
        (1, 11, 21, 1, 5.0, 1.0, 0.1, 0.1, "A", "F"),
        (1, 12, 22, 2, 6.0, 1.0, 0.0, 0.1, "A", "F"),
        (1, 13, 23, 3, 7.0, 1.0, 0.1, 0.0, "R", "O"),
        (2, 15, 25, 1, None, 1.0, 0.1, 0.1, "N", "O"),
        (None, 16, 26, 1, 9.0, 1.0, 0.1, 0.1, "R", "F"),
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return catalog.sheet_documents(spark, str(folder))


def test_sheets_are_dealt_once(spark, tmp_path):
    docs = sheets(spark, tmp_path)
    assert plan(docs).count("Exchange hashpartitioning") == 2  # sheets, then documents
    found = {r["doc_id"]: r["full_text"] for r in docs.collect()}
    assert set(found) == {"1", "2", None}
    assert found["1"] == "[Sheet: FlagA]\nPart11  5  F  21\nPart12    F  22\n[Sheet: FlagR]\nPart13  7  O  "
    assert found["2"] == "[Sheet: FlagN]\nPart15    O  25"


def test_lines_of_audit_are_parsed_before_they_are_told_apart(spark):
    record = {"file": "a", "result": "HIT", "run": "x"}
    lines = spark.createDataFrame([(json.dumps(record),), ('{"file": "b',), ("  ",), ("[1]",)], "value string")
    good, bad = audit.parse_audit_lines(lines)
    assert [(r["file"], r["extra"]) for r in good.collect()] == [("a", {"run": "x"})]
    assert {r["line"] for r in bad.collect()} == {'{"file": "b', "[1]"}
    assert plan(bad).count("from_json") == 1


def orders(spark, folder):
    day = datetime.datetime(2024, 3, 5)
    spark.createDataFrame(
        [(k, 1, s, 1234.5, day, "1-URGENT") for k, s in ((1, "F"), (2, "O"), (3, "P"), (4, "F"), (5, "P"))],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1")], "c_custkey bigint, c_name string").write.parquet(f"{folder}/customer.parquet")
    rows = [(k, 7, 1, n, q, p, 0.0, 0.0, "A", "F") for k in (1, 2, 3) for n, q, p in ((2, None, 9.0), (1, 3.0, 4321.5))]
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return corpus.render_orders(spark, str(folder))


def test_orders_are_rendered_by_compiled_expressions(spark, tmp_path):
    docs = orders(spark, tmp_path)
    found = {r["doc_id"]: r for r in docs.collect()}
    body = "Pos  Artikel  Menge  Preis\n1   Art-7   3   4.321,50\n2   Art-7   9,00\n"
    assert found["1"]["full_text"].endswith(body + "Summe 1.234,50 EUR")
    assert "Packstuecke gesamt: 2\n" + body in found["2"]["full_text"]
    assert found["4"]["full_text"].endswith("Pos  Artikel  Menge  Preis\nSumme 1.234,50 EUR")
    assert found["5"]["full_text"].endswith("Line count: 0")
    tables = {k: found[k]["pages"][0]["tables"] for k in found}
    assert tables["1"] == []
    assert tables["3"][0][1:] == [["1", "Art-7", "3", "4.321,50"], ["2", "Art-7", None, "9,00"], ["Total", "", "", "1.234,50"]]
    assert len(tables["5"][0]) == 2
    assert "lambdafunction" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_rendering_keeps_its_shares_and_no_lines_travel_by_customer(spark, tmp_path):
    orders(spark, tmp_path)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    shown = corpus.render_orders(spark, str(tmp_path))
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    assert shown.rdd.getNumPartitions() == shares(lines) == SHARES_A_SPLIT * lines.rdd.getNumPartitions()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        text = plan(corpus.render_orders(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert text.index("hashpartitioning(o_orderkey") < text.index("hashpartitioning(o_custkey")


def test_pieces_of_a_store_meet_slim_documents(spark, tmp_path, monkeypatch):
    orders(spark, tmp_path)
    kept, written = matching.through_table, {}
    monkeypatch.setattr(matching, "through_table", lambda df, name: written.update({name: df.columns}) or kept(df, name))
    found = catalog.j9_plan_chunks(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == {"1", "2", "3", "4", "5"}
    assert set(written["numbered-docs"]) == {"doc_id", "normalised_text", "_row"}


def test_a_batch_of_one_file_is_dealt_to_all_cores(spark, tmp_path):
    orders(spark, tmp_path)
    source, out = f"{tmp_path}/inbox", f"{tmp_path}/out"
    docs = corpus.render_orders(spark, str(tmp_path))
    copies = docs.crossJoin(spark.range(20)).withColumn("doc_id", F.concat_ws("-", "doc_id", "id")).drop("id")
    copies.coalesce(1).write.parquet(source)
    run_folder(spark, source, catalog.order_store(spark), out, f"{out}/checkpoint").awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    assert results.count() == 100
    if spark.sparkContext.defaultParallelism > 1:
        assert results.select(F.input_file_name()).distinct().count() > 1


def test_edges_gaps_and_json_texts(spark):
    texts = ["", " ", "a", " a", "a ", "üb", "bü", "\x1ca\x85", "a\x00", "~!", "　a b ", 'q"]', "[\n]"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    shown = rows.select("t", strip_edges(F.col("t")).alias("s"), json_text(F.col("t")).alias("j")).collect()
    for r in shown:
        assert r["s"] == (None if r["t"] is None else r["t"].strip())
        assert json.loads(r["j"]) == r["t"]
    cut = rows.limit(1).select(extraction._line_cells(F.array(F.lit("  1  a b  c!  ~   "))).alias("c")).first()["c"]
    assert cut == [["1", "a b", "c!", "~"]]
