"""The registered queries: every operator over the whole given tables.

Each query takes (spark, sf_dir). ``catalog_sql`` holds the same questions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import corpus
from docloom.config import EngineConfig
from docloom.functions.exprs import json_text, materialise
from docloom.functions.patterns import SEARCH
from docloom.functions.text import (
    basename,
    extension,
    normalise_text,
    preview,
    span_preview,
    strip_sheet_markers,
)
from docloom.operators import extraction, lifecycle, matching, mining, report, sanitise, templates
from docloom.operators.dimension import load
from docloom.operators.validation import validate
from docloom.plans.batch import extract_documents, route_documents, run_batch
from docloom.plans.rounds import learn_round, routed_with_text, settle
from docloom.schemas import CHECK, RULE
from docloom.session import new_path, shuffles_dropped, spread, through_table
from docloom.sources import assembly, audit, responses, store
from docloom.sources.files import discover, dispatch
from docloom.streaming.folder import hit_deltas, run_folder
from docloom.streaming.moving import commit_snapshot, current_hits, current_results, rematch_misses, run_moving_folder

CFG = EngineConfig()


# --- inputs ------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_texts(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as D2 rows."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text", "lang", "source"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("texts/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.lit("pdf").alias("file_type"),
        F.col("text").alias("full_text"),
        normalise_text(F.col("text")).alias("normalised_text"),
        "lang",
        "source",
    )


def orders(spark: SparkSession, sf: str, files: int | None = None) -> DataFrame:
    return corpus.render_orders(spark, sf, files)


def order_store(spark: SparkSession) -> DataFrame:
    return corpus.as_store(spark, corpus.order_templates())


def text_store(spark: SparkSession) -> DataFrame:
    return corpus.as_store(spark, corpus.licence_templates())


def extracted_orders(spark: SparkSession, sf: str) -> DataFrame:
    return extract_documents(orders(spark, sf), order_store(spark))


def order_results(spark: SparkSession, sf: str) -> DataFrame:
    return route_documents(extracted_orders(spark, sf))


def matched_texts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match(free_texts(spark, sf), text_store(spark))


def supplier_templates(spark: SparkSession, sf: str) -> DataFrame:
    """A store that grows with the suppliers: one template each."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nation = F.col("s_nationkey")
    text = lambda v: F.lit(v).cast("string")
    rule = lambda field, kind, regex, anchor, stop: F.struct(
        F.lit(field).alias("field"),
        F.lit(kind).alias("type"),
        regex.alias("regex"),
        anchor.alias("anchor_regex"),
        stop.alias("stop_regex"),
        F.array(F.lit("pos"), F.lit("amount")).alias("columns"),
        text(None).alias("strip_chars"),
        text(None).alias("date_format"),
    )
    check = lambda field: F.struct(
        F.lit(field).alias("field"),
        F.lit(True).alias("not_null"),
        F.lit(None).cast("double").alias("gt"),
        F.lit(None).cast("double").alias("lt"),
        text(None).alias("regex_match"),
    )
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return s.select(
        F.col("s_suppkey").alias("seq"),
        F.lit(0).cast("bigint").alias("snapshot_id"),
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"), F.lit("_v1")).alias("template_id"),
        F.array(
            F.lit("Delivery Note"),
            F.col("s_name"),
            F.concat(F.lit("Nation "), nation.cast("string")),
            F.lit("Überweisung"),
        ).alias("required_keywords"),
        F.col("s_name").alias("supplier_hint"),
        F.concat(F.lit("type_"), nation.cast("string")).alias("doc_type"),
        F.when(F.col("s_acctbal") > 5000, F.lit(0.8)).otherwise(F.lit(0.6)).alias("keyword_quorum"),
        F.array(
            rule("number", "string", F.lit(r"No\.\s*(\d+)"), text(None), text(None)),
            rule(
                "day",
                "date",
                F.when(nation < 5, r"Day (\d+").when(nation < 10, r"(Day) (\d+)").when(nation < 15, text(None)).otherwise(r"Day (\S+)"),
                text(None),
                text(None),
            ),
            rule(
                "lines",
                "table",
                text(None),
                F.lit("Pos"),
                F.when(nation < 8, text(None)).when(nation < 12, "Sum[").otherwise("Sum"),
            ),
        ).alias("rules"),
        F.array(check("number"), check("day"), check("lines"), check("ghost")).alias("checks"),
        F.create_map(F.lit("nation"), nation.cast("string")).alias("metadata"),
        F.lit(1).alias("version"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit(0).cast("bigint").alias("hit_count"),
    )


def benchmark_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template per benchmark item: all its distinct tokens."""
    b = table(spark, sf, "benchmark", "item_id", "text")
    return b.select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("template_id"),
        F.array_distinct(
            F.regexp_extract_all("text", F.lit(mining.token_pattern(CFG.min_token_len)), F.lit(0))
        ).alias("required_keywords"),
    )


def order_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers a responder might give for the orders that no template settles.

    Repairs keep the template id they were given, near misses invent one, cold misses found a memo
    template. Delivery notes answer inside a fence, large orders are cut off, small ones empty.
    """
    o = spread(
        table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"),
        "o_orderkey",
    )
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    known = F.when(status == "F", "confirmation_v1").when(status == "O", "delivery_v1").otherwise("invoice_v1")
    repair, near = priority == "2-HIGH", priority == "4-NOT SPECIFIED"
    cold = (priority == "5-LOW") & (status == "P")
    key = F.col("o_orderkey").cast("string")
    answered_id = F.when(repair, known).when(near, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit("_v1"))).otherwise("memo_v1")
    body = F.concat(
        F.lit('{"template_id": "'),
        answered_id,
        F.lit('", "fingerprint": {"required_keywords": ["Absender:", "Segment '),
        F.col("c_mktsegment"),
        F.lit('", "segment '),
        F.lower("c_mktsegment"),
        F.lit('"], "supplier_hint": "Nordwind Handel KG", "doc_type": "'),
        F.lower("c_mktsegment"),
        F.lit('"'),
        F.when(price < 100000, F.lit(', "keyword_quorum": 0.5')).otherwise(F.lit("")),
        F.lit(
            '}, "extraction_rules": [{"field": "order_number", "regex": "(?:Bestellung|Nr|Vorgang)[.:]?\\\\s*(\\\\d+)"},'
            ' {"field": "broken", "type": "string", "regex": "(unclosed"},'
            ' {"field": "pair", "type": "string", "regex": "(a)(b)"}],'
            ' "confidence_checks": [{"field": "order_number", "not_null": true}, {"field": "broken", "gt": 1}],'
            ' "extracted_data": {"order_number": "'
        ),
        key,
        F.lit('", "segment": "'),
        F.col("c_mktsegment"),
        F.lit('", "customer": null, "urgent": true, "share": 0.25, "items": [{"a": 1}, []]}}'),
    )
    raw = (
        F.when(price > 400000, F.substring(body, 1, 120))
        .when(price < 20000, F.lit(""))
        .when(status == "O", F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .otherwise(F.concat(F.lit("  "), body))
    )
    return (
        o.filter(repair | near | cold)
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("response_seq"),
            key.alias("doc_id"),
            F.when(repair | near, known).alias("existing_template_id"),
            F.when(status == "O", "local").otherwise("remote").alias("backend"),
            F.lit("fixture").alias("model"),
            raw.alias("raw"),
        )
    )


def decoded_orders(spark: SparkSession, sf: str) -> DataFrame:
    return responses.decode_responses(order_responses(spark, sf), F.col("backend") == "remote")


def learnt(spark: SparkSession, sf: str) -> DataFrame:
    return templates.build_templates(decoded_orders(spark, sf))


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(c: Column | str, sep: str = " | ") -> Column:
    return F.array_join(c, sep)


# --- 2.1 sources and sinks -----------------------------------------------------------------------


def named_files(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    suffix = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "de", ".XLSX").when(F.col("lang") == "fr", ".xls").otherwise(".tar.Gz")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("in/"), "source", F.lit("/d."), F.col("doc_id").cast("string"), suffix).alias("path"),
    )


def s2_dispatch(spark, sf):
    good, bad = dispatch(named_files(spark, sf))
    return good.select("doc_id", "file_type", F.lit("-").alias("reason")).unionByName(
        bad.select("doc_id", F.lit("-").alias("file_type"), "reason")
    )


def s3_assemble_pages(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        F.concat(F.lit("talk-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.col("turn").cast("int").alias("page_num"),
        "text",
        F.lit(None).cast("array<array<array<string>>>").alias("tables"),
    )
    docs = assembly.assemble_pages(rows)
    return docs.select(
        "doc_id",
        "path",
        long(F.size("pages")).alias("n_pages"),
        F.get("pages", F.lit(0))["page_num"].cast("bigint").alias("first_page"),
        F.md5("full_text").alias("text_digest"),
        F.md5("normalised_text").alias("normal_digest"),
    )


def sheet_documents(spark, sf):
    lines = table(
        spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    flag = F.col("l_returnflag")
    lines = lines.withColumns(
        {
            "doc_id": F.col("l_orderkey").cast("string"),
            "sheet_idx": F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2),
        }
    ).drop("l_orderkey")
    # Dealt by sheet once: numbering and, in the assembly, rows and sheets are then made where the lines lie.
    lines = lines.repartition("doc_id", "sheet_idx")
    order = Window.partitionBy("doc_id", "sheet_idx", "l_returnflag").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    cells = F.array(
        F.concat(F.lit("Part"), F.col("l_partkey").cast("string")),
        F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("bigint").cast("string")),
        F.col("l_linestatus"),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey").cast("string")),
    )
    rows = lines.withColumn("row_idx", F.row_number().over(order)).select(
        "doc_id",
        F.concat(F.lit("order-"), "doc_id", F.lit(".xlsx")).alias("path"),
        "sheet_idx",
        F.concat(F.lit("Flag"), "l_returnflag").alias("sheet_name"),
        "row_idx",
        F.posexplode(cells).alias("col_idx", "value"),
    )
    return assembly.assemble_sheets(rows)


def s4_assemble_sheets(spark, sf):
    return sheet_documents(spark, sf).select(
        "doc_id",
        joined("sheet_names", ",").alias("sheets"),
        long(F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(F.get(p["tables"], F.lit(0))))).alias("n_rows"),
        F.md5("full_text").alias("text_digest"),
        F.md5("normalised_text").alias("normal_digest"),
    )


def _store_rows(back: DataFrame) -> DataFrame:
    return back.select(
        "seq",
        "template_id",
        joined("required_keywords").alias("keywords"),
        "supplier_hint",
        "doc_type",
        "keyword_quorum",
        long(F.size("rules")).alias("n_rules"),
        joined(F.transform("rules", lambda r: F.coalesce(r["regex"], F.lit("-")))).alias("patterns"),
        long(F.size("checks")).alias("n_checks"),
        F.col("metadata")["nation"].alias("nation"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


def s5_s6_store_roundtrip(spark, sf):
    """The store as one JSON object, written and read back."""
    path = new_path(spark, "store")
    store.export_store_json(supplier_templates(spark, sf), path)
    return _store_rows(store.load_store_json(spark, path))


def s5_s6_store_lines(spark, sf):
    """The store in the line form, written and read back."""
    path = new_path(spark, "store")
    store.export_store_lines(supplier_templates(spark, sf), path)
    return _store_rows(store.load_store_lines(spark, path))


def s6_snapshot(spark, sf):
    folder = new_path(spark, "snapshots")
    store.save_snapshot(supplier_templates(spark, sf), folder, 3)
    back = store.load_snapshot(spark, folder, 3)
    return back.select("template_id", "snapshot_id", "seq", long(F.size("rules")).alias("n_rules"), "keyword_quorum")


def order_audit(spark, sf):
    return audit.audit_records(
        order_results(spark, sf),
        duration_ms=12.345,
        extra={"run": F.lit("nightly")},
        ts=F.lit("2024-05-06T07:08:09.123456+00:00"),
    )


def audit_roundtrip(spark, sf):
    """Written, then read back among blank and broken lines."""
    path = new_path(spark, "audit")
    audit.append_audit(order_audit(spark, sf), path)
    noise = table(spark, sf, "nation", "n_name").select(
        F.explode(F.array(F.lit(""), F.lit("   "), F.concat(F.lit('{"file": "'), "n_name"))).alias("value")
    )
    noise.write.mode("append").text(path)
    return audit.read_audit(spark, path)


def s7_s8_audit(spark, sf):
    good, _ = audit_roundtrip(spark, sf)
    return good.select(
        "file",
        "file_type",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        "match_score",
        "result",
        "validation_passed",
        joined("validation_errors").alias("errors"),
        "field_count",
        "duration_ms",
        long(F.size("candidate_scores")).alias("n_candidates"),
    )


def s8_extra(spark, sf):
    """What a writer added to its records comes back."""
    good, _ = audit_roundtrip(spark, sf)
    return good.select("file", F.col("extra")["run"].alias("run"), long(F.size("extra")).alias("n_extra"))


def s10_export(spark, sf):
    """Audit records as exported JSON lines, read as plain text."""
    path = new_path(spark, "export")
    audit.append_audit(order_audit(spark, sf), path)
    line = lambda key: F.get_json_object("value", f"$.{key}").alias(key)
    return spark.read.text(path).select(line("file"), line("ts"), line("result"), line("run"))


def s1_discover(spark, sf):
    """The table files of the input folder, without reading them."""
    found = discover(spark, sf, ("*.parquet",))
    return found.select(basename(F.col("path")).alias("file"), (F.col("length") > 0).alias("filled"))


def s8_bad_lines(spark, sf):
    _, bad = audit_roundtrip(spark, sf)
    return bad.groupBy("line").agg(F.count("*").alias("n"))


def s9_results(spark, sf):
    path = new_path(spark, "results")
    written = order_results(spark, sf)
    audit.write_results(written, path)
    back = spark.read.schema(written.schema).json(path)
    return back.select(
        "doc_id",
        "document_path",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        "match_score",
        "data_json",
        "route",
        F.coalesce("existing_template_id", F.lit("-")).alias("existing_template_id"),
        "field_count",
        "llm_used",
        F.coalesce("llm_backend", "llm_model", F.lit("-")).alias("responder"),
        "validation_passed",
        joined("validation_errors").alias("errors"),
        long(F.size("candidate_scores")).alias("n_candidates"),
    )


def s11_decode(spark, sf):
    return decoded_orders(spark, sf).select(
        "response_seq",
        F.coalesce("reject", F.lit("-")).alias("reject"),
        F.when(F.col("reject").isNull(), F.coalesce("body.template_id", F.lit("none"))).otherwise("-").alias("answered_id"),
        F.when(F.col("reject").isNull(), F.coalesce(F.col("body.extracted_data")["segment"], F.lit("none"))).otherwise("-").alias("segment"),
    )


def s12_requests(spark, sf):
    docs = free_texts(spark, sf).select(
        "doc_id", "full_text", F.when(F.col("lang") == "en", F.lit("english_v1")).alias("existing_template_id")
    )
    capped = responses.build_requests(docs, instructions="Extract.")
    whole = responses.build_requests(docs, None, instructions="Extract.")
    return capped.select("doc_id", F.md5("prompt").alias("capped_digest"), F.col("truncated")).join(
        whole.select("doc_id", F.md5("prompt").alias("whole_digest")), "doc_id"
    )


def _orders_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two files a core, whatever the shares of the rendering: the number of batches follows the files."""
    return orders(spark, sf, 2 * spark.sparkContext.defaultParallelism)


def _write_files(docs: DataFrame, folder: str) -> None:
    """Adds files to an inbox; what was shuffled for them goes when they are written."""
    with shuffles_dropped(docs.sparkSession):
        docs.write.mode("append").option("compression", "zstd").parquet(folder)


def s13_folder_stream(spark, sf):
    """Rendered orders arrive as files; the stream settles them and stops; its hits make a snapshot."""
    source, out = new_path(spark, "inbox"), new_path(spark, "stream")
    _write_files(_orders_in_files(spark, sf), source)
    run_folder(spark, source, order_store(spark), out, f"{out}/checkpoint", files_per_batch=4).awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    counts = results.groupBy(F.coalesce("template_id", F.lit("-")).alias("template_id"), "route").agg(
        F.count("*").alias("documents")
    )
    stored = lifecycle.add_hits(order_store(spark), hit_deltas(spark, out))
    store.save_snapshot(stored, f"{out}/snapshots", 1)
    after = store.load_snapshot(spark, f"{out}/snapshots", 1).select("template_id", "hit_count")
    return counts.join(after, "template_id", "left").select(
        "template_id", "route", "documents", F.coalesce("hit_count", F.lit(0)).alias("hits")
    )


def s13_rematch(spark, sf):
    """A stream that starts with one template; the others are committed while half of the orders are out, and
    what missed before is matched again."""
    source, out, snapshots = new_path(spark, "inbox"), new_path(spark, "stream"), new_path(spark, "snapshots")
    docs, stored = _orders_in_files(spark, sf), order_store(spark)
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    commit_snapshot(stored.filter("seq = 0"), snapshots, 1)
    _write_files(docs.filter(early), source)
    run = lambda: run_moving_folder(spark, source, snapshots, out, f"{out}/checkpoint", files_per_batch=4)
    run().awaitTermination()
    commit_snapshot(stored, snapshots, 2)
    _write_files(docs.filter(~early), source)
    run().awaitTermination()
    rematch_misses(spark, snapshots, out)
    hits = current_hits(spark, out)
    counts = current_results(spark, out).groupBy(F.coalesce("template_id", F.lit("-")).alias("template_id"), "route").agg(
        F.count("*").alias("documents")
    )
    return counts.join(hits, "template_id", "left").select(
        "template_id", "route", "documents", F.coalesce("hits", F.lit(0)).alias("hits")
    )


# --- 2.2 scalar text ------------------------------------------------------------------------------


def p1_normalise(spark, sf):
    return free_texts(spark, sf).select(
        "doc_id", long(F.length("normalised_text")).alias("n_chars"), F.md5("normalised_text").alias("digest")
    )


def p2_sheet_markers(spark, sf):
    return sheet_documents(spark, sf).select(
        "doc_id", F.md5(strip_sheet_markers(F.col("full_text"))).alias("digest")
    )


def p3_p4_fold_preview(spark, sf):
    text = F.col("full_text")
    return free_texts(spark, sf).select(
        "doc_id",
        F.md5(F.lower(text)).alias("folded"),
        F.md5(preview(text, 2000)).alias("run_preview"),
        F.md5(preview(text, 300)).alias("value_preview"),
        F.md5(span_preview(text)).alias("span_preview"),
    )


def p5_paths(spark, sf):
    return named_files(spark, sf).select(
        "doc_id", basename(F.col("path")).alias("file"), extension(F.col("path")).alias("file_type")
    )


def p6_build(spark, sf):
    return learnt(spark, sf).select(
        "response_seq",
        "template_id",
        joined("required_keywords").alias("keywords"),
        "doc_type",
        "supplier_hint",
        "keyword_quorum",
        joined(F.transform("rules", lambda r: F.concat(r["field"], F.lit(":"), r["type"]))).alias("rules"),
        long(F.size(F.filter("checks", lambda c: c["not_null"]))).alias("required_checks"),
        long("hit_count").alias("hit_count"),
        F.col("metadata")["llm_generated"].alias("generated"),
    )


def p7_listing(spark, sf):
    return templates.list_templates(supplier_templates(spark, sf)).drop("seq")


def p8_lookup(spark, sf):
    wanted = templates.get_template(supplier_templates(spark, sf), "supplier_7_v1")
    return wanted.select("template_id", "supplier_hint", "doc_type", "keyword_quorum")


def p9_in_order(spark, sf):
    return templates.in_order(supplier_templates(spark, sf)).select("seq", "template_id")


def p10_import(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    fp = F.concat(
        F.lit('"fingerprint": {"supplier_hint": '), json_text(F.col("c_name")),
        F.lit(', "keyword_quorum": '), F.when(nation < 3, "1.5").otherwise("0.7"), F.lit("}"),
    )
    value = (
        F.when(segment == "BUILDING", F.lit("  "))
        .when(segment == "MACHINERY", F.concat(F.lit('{"template_id": "'), "c_name"))
        .when(segment == "FURNITURE", F.concat(F.lit("{"), fp, F.lit("}")))
        .when(nation > 20, F.concat(F.lit('{"template_id": "'), "c_name", F.lit('"}')))
        .otherwise(
            F.concat(
                F.lit('{"template_id": "'), "c_name", F.lit('", '), fp,
                F.when(nation == 10, F.lit(', "extraction_rules": [{"type": "date"}]')).otherwise(F.lit("")), F.lit("}"),
            )
        )
    )
    good, bad = templates.import_templates(c.select(F.col("c_custkey").alias("line_id"), value.alias("value")))
    return good.select(
        "line_id", F.lit("-").alias("reason"), "template_id", "keyword_quorum", "doc_type"
    ).unionByName(
        bad.select("line_id", "reason", F.lit("-").alias("template_id"), F.lit(0.0).alias("keyword_quorum"), F.lit("-").alias("doc_type"))
    )


def p11_questions(spark, sf):
    talk = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    questions = talk.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("text").alias("question"))
    docs = free_texts(spark, sf).select(
        "doc_id", "full_text", F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("data_json")
    )
    return responses.question_prompts(questions, docs).select(
        "doc_id", F.md5("question").alias("question"), F.md5("prompt").alias("prompt")
    )


def p12_response_fields(spark, sf):
    return templates.response_fields(decoded_orders(spark, sf)).select(
        "response_seq", "kind", "field", F.coalesce("s", F.lit("<null>")).alias("s")
    )


# --- 2.3 matching ---------------------------------------------------------------------------------


def j1_keyword_hits(spark, sf):
    return matching.keyword_hits(free_texts(spark, sf), text_store(spark)).select(
        "doc_id", "template_id", long("hits").alias("hits"), F.round("keyword_score", 6).alias("keyword_score")
    )


def _order_scores(spark, sf, hint):
    docs = orders(spark, sf)
    ts = [{**t, "supplier_hint": hint} for t in corpus.order_templates()]
    return matching.keyword_hits(docs, corpus.as_store(spark, ts)).select(
        "doc_id", "template_id", F.round("score", 6).alias("score")
    )


def j3_supplier_contained(spark, sf):
    return _order_scores(spark, sf, "Nordwind Handel KG")


def j3_supplier_fuzzy(spark, sf):
    return _order_scores(spark, sf, "Nordwind Handel GmbH")


def j5_best(spark, sf):
    return matched_texts(spark, sf).select(
        "doc_id",
        F.coalesce("best_template_id", F.lit("-")).alias("best_template_id"),
        F.round("match_score", 6).alias("match_score"),
        F.round("hit_rate", 6).alias("hit_rate"),
    )


def j6_decision(spark, sf):
    return matched_texts(spark, sf).select("doc_id", F.coalesce("template_id", F.lit("MISS")).alias("template_id"))


def j7_candidates(spark, sf):
    return matched_texts(spark, sf).select("doc_id", F.explode("candidate_scores").alias("template_id", "score"))


def j8_near_miss(spark, sf):
    return matched_texts(spark, sf).select("doc_id", F.coalesce("near_miss_id", F.lit("-")).alias("near_miss_id"))


def j9_match_orders(spark, sf):
    return matching.match(orders(spark, sf), order_store(spark)).select(
        "doc_id",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        F.round("match_score", 6).alias("match_score"),
        F.coalesce("near_miss_id", F.lit("-")).alias("near_miss_id"),
    )


def _decisions(matched: DataFrame) -> DataFrame:
    return matched.select(
        "doc_id",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        F.round("match_score", 6).alias("match_score"),
        F.coalesce("near_miss_id", F.lit("-")).alias("near_miss_id"),
    )


def j9_plan_inline(spark, sf):
    """The same question with the store as data of higher-order functions."""
    return _decisions(matching.match(orders(spark, sf), order_store(spark), EngineConfig(compiled_max_templates=0)))


def j9_plan_chunks(spark, sf):
    """The same question with the store in pieces of a template or two, each an automaton."""
    cfg = EngineConfig(inline_max_templates=1, automaton_max_templates=1)
    # several pieces write their documents once: only what the decision reads goes along
    docs = orders(spark, sf).select("doc_id", "normalised_text")
    return _decisions(matching.match(docs, order_store(spark), cfg))


def j9_plan_automaton(spark, sf):
    """Delivery notes against a store that grows with the parts, five templates each (10,000 at sf0.01)."""
    parts = spread(table(spark, sf, "part", "p_partkey"), "p_partkey")  # a small table of much work
    last = F.lit(parts.agg(F.max("p_partkey").cast("bigint")).first()[0])
    key, v = F.col("p_partkey").cast("bigint"), F.col("v")
    word = lambda k: F.concat(F.lit("TEIL "), k.cast("string"), F.lit(";"))
    stored = (
        parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("v"))
        .select(
            (key * 5 + v).alias("seq"),
            F.concat_ws("_", F.lit("part"), key, v).alias("template_id"),
            F.array(word(key), word((key * 7 + v * 13) % last + 1), word((key * 11 + v * 29) % last + 1)).alias(
                "required_keywords"
            ),
            F.when(v == 2, "Lieferschein").otherwise("").alias("supplier_hint"),
            F.when(v % 2 == 0, 0.6).otherwise(0.8).alias("keyword_quorum"),
            F.array().cast(f"array<{RULE}>").alias("rules"),
            F.array().cast(f"array<{CHECK}>").alias("checks"),
        )
    )
    named = F.array_sort(F.collect_set(F.concat(F.lit("Teil "), F.col("l_partkey").cast("string"), F.lit(";"))))
    notes = table(spark, sf, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(named.alias("parts"))
    docs = notes.select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.concat(F.lit("Lieferschein "), joined("parts", " "), F.lit(" Ende")).alias("normalised_text"),
    )
    return _decisions(matching.match(docs, stored, EngineConfig(inline_max_templates=100), candidates=False))


def j9_match_by_grams(spark, sf):
    """A store that grows with the suppliers, matched by equi-join on keyword grams."""
    names = table(spark, sf, "supplier", "s_suppkey", "s_name")
    parts = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey").join(
        names, F.col("l_suppkey") == F.col("s_suppkey")
    )
    docs = parts.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("names")).select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.concat(F.lit("Delivery Note for "), joined("names", ", "), F.lit(" end")).alias("normalised_text"),
    )
    stored = supplier_templates(spark, sf).withColumns(
        {
            "supplier_hint": F.lit(""),
            "required_keywords": F.array(
                F.col("supplier_hint"), F.concat(F.lit("Note for "), "supplier_hint"), F.concat(F.col("supplier_hint"), F.lit(" END"))
            ),
        }
    )
    return matching.match_by_grams(docs, stored, CFG).select(
        "doc_id",
        "best_template_id",
        F.round("match_score", 6).alias("match_score"),
        long(F.size("candidate_scores")).alias("n_candidates"),
    )


def j10_family(spark, sf):
    stored = supplier_templates(spark, sf)
    asked = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.col("s_suppkey").alias("key"),
        F.concat(F.lit("type_"), F.col("s_nationkey").cast("string")).alias("doc_type"),
        F.concat(F.col("s_name"), F.lit(" AG")).alias("supplier_hint"),
    )
    return matching.family_match(asked, stored).select("key", "family_id", F.round("ratio", 4).alias("ratio"))


def _distorted_names(spark, sf) -> DataFrame:
    """Supplier names asked backwards, cut, without zeros or within others; some of types that have no family."""
    name, kind = F.col("s_name"), F.col("s_suppkey") % 4
    return table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.col("s_suppkey").alias("key"),
        F.when(F.col("s_suppkey") % 7 == 0, "type_none").otherwise(F.concat(F.lit("type_"), F.col("s_nationkey").cast("string"))).alias("doc_type"),
        F.when(F.col("s_suppkey") % 8 == 1, F.concat(F.substring(name, 1, 8), F.lit(" qv")))
        .when(kind == 0, F.reverse(name))
        .when(kind == 1, F.concat(F.substring(name, 1, 8), F.lit(" xyz qv")))
        .when(kind == 2, F.replace(name, F.lit("0"), F.lit("")))
        .otherwise(F.concat(F.lit("The "), F.substring(name, 4, 30), F.lit(" AG")))
        .alias("supplier_hint"),
    )


def j10_family_distorted(spark, sf):
    """J10 on names that are contained in none: ratios on both sides of the threshold, ties, missing families."""
    found = matching.family_match(_distorted_names(spark, sf), supplier_templates(spark, sf))
    return found.select("key", F.coalesce("family_id", F.lit("-")).alias("family_id"), F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("ratio"))


def j11_rules_of_document(spark, sf):
    dim = load(order_store(spark))
    matched = matching.match(orders(spark, sf), dim)
    return extraction.attach_rules(matched.select("doc_id", "template_id"), dim).select(
        "doc_id", long(F.coalesce(F.size("_rules"), F.lit(0))).alias("n_rules"), long(F.coalesce(F.size("_checks"), F.lit(0))).alias("n_checks")
    )


# --- 2.4 extraction -------------------------------------------------------------------------------


def _hits(spark, sf) -> DataFrame:
    dim = load(order_store(spark))
    matched = matching.match(orders(spark, sf), dim).filter(F.col("template_id").isNotNull())
    return extraction.extract(matched, dim)


def _field(name: str, part: str) -> Column:
    return F.get(F.filter("data", lambda v: v["field"] == name), F.lit(0))[part]


def x1_values(spark, sf):
    return extraction.long_form(_hits(spark, sf)).select(
        "doc_id",
        "template_id",
        long("rule_pos").alias("rule_pos"),
        "field",
        "kind",
        F.coalesce("s", F.round("d", 2).cast("string"), F.col("i").cast("string"), long(F.size("l")).cast("string"), long(F.size("t")).cast("string"), F.lit("<none>")).alias("shown"),
    )


def x2_string(spark, sf):
    return _hits(spark, sf).select(
        "doc_id", _field("order_number", "s").alias("order_number"), F.coalesce(_field("customer", "s"), F.lit("-")).alias("customer")
    )


def x3_date(spark, sf):
    return _hits(spark, sf).select("doc_id", F.coalesce(_field("order_date", "s"), F.lit("-")).alias("order_date"))


def x4_decimal(spark, sf):
    return _hits(spark, sf).select("doc_id", _field("total", "d").alias("total"))


def x5_integer(spark, sf):
    return _hits(spark, sf).select("doc_id", F.coalesce(_field("line_count", "i"), F.lit(-1)).alias("line_count"))


def x6_list(spark, sf):
    return _hits(spark, sf).select("doc_id", F.coalesce(joined(_field("articles", "l"), ","), F.lit("-")).alias("articles"))


def x6_mails(spark, sf):
    pattern = F.lit(SEARCH + r"[\w.]+@[\w.]+\.\w+")
    return free_texts(spark, sf).select(
        "doc_id", joined(extraction.all_matches(F.col("full_text"), pattern, F.lit(0))).alias("mails")
    )


def x6_links(spark, sf):
    pattern = F.lit(SEARCH + r'<li><a href="([^"]*)">([^<]*)</a></li>')
    pages = spread(table(spark, sf, "pages", "page_id", "html"), "page_id")
    found = materialise(pages, links=extraction.all_matches(F.col("html"), pattern, F.lit(2)))
    return found.select("page_id", long(F.size("links")).alias("n_links"), F.md5(joined("links", "\n")).alias("digest"))


def _table_rows(spark, sf, template_ids):
    hits = _hits(spark, sf).filter(F.col("template_id").isin(template_ids))
    return hits.select("doc_id", F.posexplode(_field("lines", "t")).alias("line", "row")).select(
        "doc_id",
        long("line").alias("line"),
        *[F.col("row")[c].alias(c) for c in corpus.LINE_COLUMNS],
    )


def x7_x9_table_pages(spark, sf):
    return _table_rows(spark, sf, ["invoice_v1"])


def x8_x9_table_text(spark, sf):
    return _table_rows(spark, sf, ["confirmation_v1", "delivery_v1"])


def _in_python(pattern: str | None) -> str | None:
    """The same pattern spelt so that only Python can run it."""
    return pattern and f"(?a:{pattern})"


EVEN_CUSTOMER = r"(C)?(?(1)ustomer.?\d*[02468]$|x)"
OTHER_END = r"(\d)\d*$(?<!\1)"


def python_order_store(spark: SparkSession) -> DataFrame:
    """The order templates with anchors, stops and checks that the JVM can't run: flags, a conditional, a
    reference inside a look-behind."""
    stored = corpus.order_templates()
    for t in stored:
        for rule in t["rules"]:
            for side in ("anchor_regex", "stop_regex"):
                rule[side] = _in_python(rule[side])
        for check in t["checks"]:
            check["regex_match"] = _in_python(check["regex_match"])
        for field, pattern in (("customer", EVEN_CUSTOMER), ("order_number", OTHER_END)):
            t["checks"].append({"field": field, "not_null": False, "gt": None, "lt": None, "regex_match": pattern})
    return corpus.as_store(spark, stored)


def x7_x8_python_tables(spark, sf):
    """All tables, found in pages or text by patterns that only Python can run."""
    dim = load(python_order_store(spark))
    hits = matching.match(orders(spark, sf), dim).filter(F.col("template_id").isNotNull())
    found = extraction.extract(hits, dim).select("doc_id", F.posexplode(_field("lines", "t")).alias("line", "row"))
    return found.select("doc_id", long("line").alias("line"), *[F.col("row")[c].alias(c) for c in corpus.LINE_COLUMNS])


def v4_python_checks(spark, sf):
    """Checks that only Python can run: even customers, order numbers that end unlike they begin."""
    dim = load(python_order_store(spark))
    hits = matching.match(orders(spark, sf), dim).filter(F.col("template_id").isNotNull())
    checked = validate(extraction.extract(hits, dim), dim)
    about = F.filter("errors", lambda e: F.contains(e, F.lit("does not match")))
    return checked.select("doc_id", joined(about).alias("errors"))


def x10_type_dispatch(spark, sf):
    values = extraction.long_form(_hits(spark, sf))
    filled = [F.count(c).alias(f"n_{c}") for c in ("s", "d", "i", "l", "t", "error")]
    return values.groupBy("template_id", "kind").agg(F.count("*").alias("n"), *filled)


# --- 2.5 validation, 2.6 routing --------------------------------------------------------------------


def v1_v5_validate(spark, sf):
    return extracted_orders(spark, sf).filter(F.col("template_id").isNotNull()).select(
        "doc_id", (F.size("errors") == 0).alias("passed"), joined("errors").alias("errors")
    )


def v4_pattern_check(spark, sf):
    """Checks on free-text fields of matched licence notices."""
    dim = load(text_store(spark))
    hits = matching.match(free_texts(spark, sf), dim).filter(F.col("template_id").isNotNull())
    return validate(extraction.extract(hits, dim)).select(
        "doc_id",
        "template_id",
        F.coalesce(_field("version", "s"), F.lit("-")).alias("version"),
        joined("errors").alias("errors"),
    )


def v6_critical(spark, sf):
    return extracted_orders(spark, sf).filter(F.col("template_id").isNotNull()).select(
        "doc_id", long("critical").alias("critical")
    )


def r1_route(spark, sf):
    return order_results(spark, sf).select(
        "doc_id", "route", F.coalesce("existing_template_id", F.lit("-")).alias("existing_template_id"), "validation_passed"
    )


def r2_hits(spark, sf):
    counted = lifecycle.count_hits(order_store(spark), order_results(spark, sf))
    return counted.select("template_id", "hit_count")


def r3_r4_fold(spark, sf):
    folded = lifecycle.fold_updates(order_store(spark), learnt(spark, sf), 1)
    return folded.select(
        "template_id",
        joined("required_keywords").alias("keywords"),
        "doc_type",
        F.round("keyword_quorum", 4).alias("quorum"),
        long(F.size("rules")).alias("n_rules"),
        long("hit_count").alias("hit_count"),
    )


def r4_upsert(spark, sf):
    """Suppliers' templates, half of them replaced and some new, in response order."""
    stored = supplier_templates(spark, sf).withColumn("hit_count", F.lit(5).cast("bigint"))
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    incoming = c.select(
        F.col("c_custkey").alias("response_seq"),
        F.concat(F.lit("supplier_"), (F.col("c_custkey") * 2).cast("string"), F.lit("_v1")).alias("template_id"),
        F.array(F.col("c_name")).alias("required_keywords"),
        F.lit("").alias("supplier_hint"),
        F.concat(F.lit("new_"), F.col("c_nationkey").cast("string")).alias("doc_type"),
        F.lit(0.9).alias("keyword_quorum"),
    )
    blank = stored.limit(0).select("rules", "checks", "metadata", "version", "created_at", "updated_at", "hit_count")
    for f in blank.schema.fields:
        default = {"version": F.lit(1), "hit_count": F.lit(0)}.get(f.name, F.lit(None))
        incoming = incoming.withColumn(f.name, default.cast(f.dataType))
    out = lifecycle.upsert(stored, incoming)
    return out.select(
        "template_id",
        joined("required_keywords").alias("keywords"),
        "doc_type",
        long("hit_count").alias("hit_count"),
        F.when(F.col("hit_count") == 5, F.col("seq")).otherwise(F.lit(-1)).alias("kept_seq"),
    )


def r5_delete(spark, sf):
    stored = supplier_templates(spark, sf)
    ids = table(spark, sf, "orders", "o_custkey").select(
        F.concat(F.lit("supplier_"), F.col("o_custkey").cast("string"), F.lit("_v1")).alias("template_id")
    )
    left, report_ = lifecycle.delete_templates(stored, ids)
    return report_.select("template_id", F.when(F.col("found"), "deleted").otherwise("missing").alias("state")).unionByName(
        left.select("template_id", F.lit("kept").alias("state"))
    )


def settled_orders(spark, sf):
    pending = through_table(routed_with_text(extracted_orders(spark, sf)), "routed")
    answers = through_table(order_responses(spark, sf), "responses")
    return settle(pending, answers, order_store(spark), CFG, 1, F.col("backend") == "remote")


def r6_learn_results(spark, sf):
    """Documents, fixture answers, cleaned templates, overlaid results: one whole round."""
    return settled_orders(spark, sf).results.select(
        "doc_id",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        "llm_used",
        F.coalesce("llm_backend", F.lit("-")).alias("llm_backend"),
        "validation_passed",
        joined("validation_errors").alias("errors"),
        "field_count",
        F.when(F.col("llm_used"), F.col("data_json")).otherwise("-").alias("answer"),
    )


def r7_responder_round(spark, sf):
    """The same round with a responder called per request batch."""
    import json

    import pandas as pd

    def responder(batch: pd.DataFrame) -> pd.DataFrame:
        answers = [
            json.dumps(
                {
                    "template_id": existing or "memo_v1",
                    "fingerprint": {"required_keywords": ["Absender:"]},
                    "extraction_rules": [{"field": "sender", "regex": r"Absender:\s*(\w+)"}],
                    "extracted_data": {"sender": "Nordwind", "length": len(prompt)},
                }
            )
            for existing, prompt in zip(batch["existing_template_id"], batch["prompt"])
        ]
        return pd.DataFrame(
            {
                "response_seq": batch["doc_id"].astype("int64"),
                "doc_id": batch["doc_id"],
                "existing_template_id": batch["existing_template_id"],
                "backend": "fixture",
                "model": "echo",
                "raw": answers,
            }
        )

    round_ = learn_round(orders(spark, sf), order_store(spark), responder)
    return round_.results.groupBy("template_id", "llm_used").agg(
        F.count("*").alias("documents"), F.sum("field_count").alias("fields")
    )


# --- 2.7 mining and sanitising ----------------------------------------------------------------------


def k2_tokens(spark, sf):
    toks = mining.tokens(free_texts(spark, sf))
    return toks.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.md5(joined(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), " ")).alias("digest"),
    )


def _frequency(spark, sf):
    return mining.token_frequency(mining.without_stop_words(mining.tokens(free_texts(spark, sf))))


def k3_k4_frequency(spark, sf):
    return _frequency(spark, sf).select("doc_id", "low", "freq", "token")


def k5_collisions(spark, sf):
    out = mining.with_collisions(_frequency(spark, sf), benchmark_templates(spark, sf))
    return out.filter("collisions > 0").select("doc_id", "low", long("collisions").alias("collisions"))


def k6_ranked_tokens(spark, sf):
    ranked = mining.rank_tokens(mining.with_collisions(_frequency(spark, sf), benchmark_templates(spark, sf)))
    return ranked.select("doc_id", long("rank").alias("rank"), "token", F.round("score", 6).alias("score"))


def k1_k7_fill_keywords(spark, sf):
    docs = free_texts(spark, sf)
    proposals = docs.select(
        "doc_id",
        "full_text",
        F.array(F.col("source"), F.lit("License"), F.lit("and"), F.lit("QUE"), F.lit("Nicht"), F.lit("example.com"), F.lit("the"), F.lit("that")).alias("proposed"),
    )
    return mining.fill_keywords(proposals, benchmark_templates(spark, sf)).select(
        "doc_id", joined("keywords").alias("keywords"), long("kept_count").alias("kept_count")
    )


def k8_k11_rule_verdicts(spark, sf):
    judged = sanitise.judge_rules(supplier_templates(spark, sf))
    return judged.select("template_id", F.posexplode("verdicts").alias("rule_pos", "v")).select(
        "template_id", long("rule_pos").alias("rule_pos"), F.coalesce("v", F.lit("kept")).alias("verdict")
    )


def k12_rule_coverage(spark, sf):
    matched = matching.match(orders(spark, sf), order_store(spark)).filter(F.col("template_id").isNotNull())
    return sanitise.rule_coverage(matched, order_store(spark)).select(
        "template_id", "field", "documents", "matched", F.round("match_rate", 6).alias("match_rate")
    )


def k13_orphan_checks(spark, sf):
    clean = sanitise.sanitise_rules(supplier_templates(spark, sf))
    return clean.select(
        "template_id",
        joined(F.transform("rules", lambda r: r["field"]), ",").alias("rules"),
        joined(F.transform("checks", lambda c: c["field"]), ",").alias("checks"),
        long(F.size("dropped")).alias("dropped"),
    )


def k14_sanitise(spark, sf):
    docs = orders(spark, sf).select("doc_id", "full_text")
    clean = sanitise.sanitise_templates(learnt(spark, sf), docs, order_store(spark))
    return clean.select(
        "response_seq",
        F.get("required_keywords", F.lit(0)).alias("first_keyword"),
        long(F.size("required_keywords")).alias("n_keywords"),
        joined(F.transform("rules", lambda r: r["field"]), ",").alias("rules"),
        joined(F.transform("checks", lambda c: c["field"]), ",").alias("checks"),
        joined(F.transform("dropped", lambda d: d["reason"])).alias("dropped"),
    )


# --- 2.8 reports --------------------------------------------------------------------------------------


def a1_history(spark, sf):
    return report.score_history(order_audit(spark, sf))


def a2_candidates(spark, sf):
    audit_rows = audit.audit_records(order_results(spark, sf), extra={})
    return report.candidate_ranking(audit_rows).select("file", long("rank").alias("rank"), "template", "score")


def a3_summary(spark, sf):
    return report.batch_summary(order_results(spark, sf))


def a4_match_metrics(spark, sf):
    return report.match_metrics(matched_texts(spark, sf)).select(
        F.coalesce("best_template_id", F.lit("-")).alias("best_template_id"),
        "documents",
        "hits",
        F.round("hit_rate", 6).alias("hit_rate"),
        F.round("avg_score", 6).alias("avg_score"),
    )


def a4_match_spans(spark, sf):
    return report.match_spans(matched_texts(spark, sf), CFG.match_threshold).select(
        "doc_id", F.md5("raw_text_preview").alias("preview"), "threshold", long("template_count").alias("template_count"), "match_score", "hit"
    )


def a5_rule_metrics(spark, sf):
    return report.rule_metrics(_hits(spark, sf)).select(
        "template_id", "documents", long("field_count").alias("field_count"), long("non_null_count").alias("non_null_count")
    )


def a6_validator_metrics(spark, sf):
    checks = order_store(spark).select("template_id", long(F.size("checks")).alias("check_count"))
    return report.validator_metrics(extracted_orders(spark, sf), checks).select(
        "template_id", "documents", "passed", long("error_count").alias("error_count"), "check_count"
    )


def a7_responder_metrics(spark, sf):
    return report.responder_metrics(decoded_orders(spark, sf)).select(
        "backend", "model", "calls", "updates", "rejected", long("field_count").alias("field_count")
    )


def a8_field_counts(spark, sf):
    return report.field_counts(extracted_orders(spark, sf))


def a9_batch_duration(spark, sf):
    """The wall time of the run that made the results, spread over them; only its shape can be compared."""
    with report.BatchClock() as clock:
        results = through_table(order_results(spark, sf), "timed")
    n = results.count()
    return audit.audit_records(results, clock.per_document(n)).groupBy("result").agg(
        F.count("*").alias("documents"), F.min(F.col("duration_ms") >= 0).alias("timed")
    )


def full_run(spark, sf):
    """Flagship: rendered orders matched, extracted, validated and routed."""
    return extracted_orders(spark, sf).select(
        "doc_id",
        F.coalesce("template_id", F.lit("-")).alias("template_id"),
        F.round("match_score", 4).alias("match_score"),
        "route",
        F.coalesce(_field("order_number", "s"), F.lit("-")).alias("order_number"),
        F.coalesce(_field("order_date", "s"), F.lit("-")).alias("order_date"),
        F.coalesce(_field("total", "d"), F.lit(-1.0)).alias("total"),
        long(F.coalesce(F.size(_field("lines", "t")), F.lit(-1))).alias("n_lines"),
        long(F.coalesce(F.size("errors"), F.lit(0))).alias("n_errors"),
    )


def full_run_texts(spark, sf):
    """The same plan over free texts."""
    return run_batch(free_texts(spark, sf), text_store(spark)).select(
        "doc_id", F.coalesce("template_id", F.lit("-")).alias("template_id"), "route", "data_json"
    )


QUERIES = [
    s1_discover, s2_dispatch, s3_assemble_pages, s4_assemble_sheets, s5_s6_store_roundtrip, s5_s6_store_lines,
    s6_snapshot, s7_s8_audit, s8_bad_lines, s8_extra, s9_results, s10_export, s11_decode, s12_requests, s13_folder_stream, s13_rematch,
    p1_normalise, p2_sheet_markers, p3_p4_fold_preview, p5_paths, p6_build, p7_listing, p8_lookup,
    p9_in_order, p10_import, p11_questions, p12_response_fields,
    j1_keyword_hits, j3_supplier_contained, j3_supplier_fuzzy, j5_best, j6_decision, j7_candidates,
    j8_near_miss, j9_match_orders, j9_plan_inline, j9_plan_chunks, j9_plan_automaton,
    j9_match_by_grams, j10_family, j10_family_distorted, j11_rules_of_document,
    x1_values, x2_string, x3_date, x4_decimal, x5_integer, x6_list, x6_mails, x6_links,
    x7_x9_table_pages, x8_x9_table_text, x7_x8_python_tables, x10_type_dispatch,
    v1_v5_validate, v4_pattern_check, v4_python_checks, v6_critical,
    r1_route, r2_hits, r3_r4_fold, r4_upsert, r5_delete, r6_learn_results, r7_responder_round,
    k1_k7_fill_keywords, k2_tokens, k3_k4_frequency, k5_collisions, k6_ranked_tokens,
    k8_k11_rule_verdicts, k12_rule_coverage, k13_orphan_checks, k14_sanitise,
    a1_history, a2_candidates, a3_summary, a4_match_metrics, a4_match_spans, a5_rule_metrics,
    a6_validator_metrics, a7_responder_metrics, a8_field_counts, a9_batch_duration,
    full_run, full_run_texts,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
