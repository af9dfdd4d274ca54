"""Discovery, assembly, store files, audit, stream."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import corpus
from docloom.schemas import PAGE_ROWS, SHEET_CELLS
from docloom.sources import assembly, audit, files, store
from docloom.streaming.folder import hit_deltas, run_folder


def test_discovery(spark, tmp_path):
    for name in ("a.pdf", "b.xlsx", "c.PDF", "d.xls", "e.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.pdf").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path))
    assert [(r["listing"], r["path"].rsplit("/", 1)[1], r["length"]) for r in found.collect()] == [(0, "a.pdf", 3), (1, "b.xlsx", 3)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path), ("*.docx",))


def test_pages(spark):
    rows = [
        ("d", "p.pdf", 2, "zwei", [[["a", None]]]),
        ("d", "p.pdf", 1, None, None),
        ("d", "p.pdf", 5, "fünf 5x", []),
        ("e", "q.pdf", 1, "[Sheet: no]", None),
    ]
    d, e = assembly.assemble_pages(spark.createDataFrame(rows, PAGE_ROWS)).orderBy("doc_id").collect()
    assert d["full_text"] == "\nzwei\nfünf 5x" and d["normalised_text"] == "\nzwei\nfünf 5 x"
    assert [(p["page_num"], p["text"], p["tables"]) for p in d["pages"]] == [(1, "", []), (2, "zwei", [[["a", ""]]]), (3, "fünf 5x", [])]
    assert (e["full_text"], e["normalised_text"], e["file_type"]) == ("[Sheet: no]", " ", "pdf")


def test_sheets(spark):
    cells = [
        ("w", "w.xlsx", 1, "B", 0, 0, "x"),
        ("w", "w.xlsx", 0, "A", 2, 0, "a"),
        ("w", "w.xlsx", 0, "A", 2, 2, "c"),
        ("w", "w.xlsx", 0, "A", 1, 1, None),
        ("w", "w.xlsx", 0, "A", 10, 1, "b"),
        ("w", "w.xlsx", 2, "Leer", 0, 0, None),
    ]
    r = assembly.assemble_sheets(spark.createDataFrame(cells, SHEET_CELLS)).first()
    assert r["full_text"] == "[Sheet: A]\na    c\n  b  \n[Sheet: B]\nx\n[Sheet: Leer]\n"
    assert r["sheet_names"] == ["A", "B", "Leer"]
    assert r["pages"][0]["tables"] == [[["a", "", "c"], ["", "b", ""]]] and r["pages"][2]["tables"] == [[]]


def test_store_json(spark, tmp_path):
    assert store.load_store_json(spark, str(tmp_path / "absent.json")).count() == 0
    entry = {
        "z_v1": {
            "template_id": "z_v1",
            "fingerprint": {"required_keywords": ["Ä", "b"], "supplier_hint": "S"},
            "extraction_rules": [{"field": "f"}],
            "confidence_checks": [{"field": "f", "gt": 1}],
            "metadata": {"llm_generated": True, "n": {"m": 1}},
            "created_at": "2024-05-06T07:08:09.123456",
            "hit_count": 3,
        },
        "a_v1": {"template_id": "a_v1", "fingerprint": {}},
    }
    path = tmp_path / "store.json"
    path.write_text(json.dumps(entry, indent=2, ensure_ascii=False), encoding="utf-8")
    z, a = store.load_store_json(spark, str(path)).orderBy("seq").collect()
    assert (z["template_id"], z["keyword_quorum"], z["hit_count"], z["rules"][0]["type"], z["checks"][0]["not_null"]) == ("z_v1", 0.6, 3, "string", False)
    assert z["metadata"] == {"llm_generated": "true", "n": '{"m":1}'} and z["created_at"].microsecond == 123456
    assert (a["doc_type"], a["version"], a["required_keywords"]) == ("unknown", 1, [])
    out = str(tmp_path / "export")
    store.export_store_json(store.load_store_json(spark, str(path)), out)
    exported = json.loads("\n".join(r[0] for r in spark.read.text(out, wholetext=True).collect()))
    assert list(exported) == ["z_v1", "a_v1"] and exported["z_v1"]["fingerprint"]["required_keywords"] == ["Ä", "b"]


def test_store_as_lines(spark, sf, tmp_path):
    from docloom.catalog import supplier_templates

    suppliers = supplier_templates(spark, sf)
    path = str(tmp_path / "lines")
    store.export_store_lines(suppliers, path)
    back = store.load_store_lines(spark, path)
    same = ["seq", "template_id", "required_keywords", "rules", "checks", "keyword_quorum", "created_at"]
    assert back.select(same).orderBy("seq").collect() == suppliers.select(same).orderBy("seq").collect()


@pytest.mark.parametrize(
    "text",
    [
        "{",
        "[]",
        "",
        '{"a": {"template_id": "a"}}',
        '{"a": {"fingerprint": {}}}',
        '{"a": {"template_id": "a", "fingerprint": {"keyword_quorum": 2}}}',
        '{"a": {"template_id": "a", "fingerprint": {"keyword_quorum": "high"}}}',
        '{"a": {"template_id": "a", "fingerprint": {}, "extraction_rules": [{"regex": "x"}]}}',
    ],
)
def test_a_bad_store_is_an_error(spark, tmp_path, text):
    path = tmp_path / "store.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)store|malformed"):
        store.load_store_json(spark, str(path)).collect()


def test_numbers_given_as_text(spark, tmp_path):
    path = tmp_path / "store.json"
    path.write_text('{"a": {"template_id": "a", "fingerprint": {"keyword_quorum": "0.5"}, "hit_count": "7", "confidence_checks": [{"field": "f", "gt": "1.5"}]}}')
    row = store.load_store_json(spark, str(path)).first()
    assert (row["keyword_quorum"], row["hit_count"], row["checks"][0]["gt"]) == (0.5, 7, 1.5)


def test_a_cell_given_twice(spark):
    cells = [("d", "p", 0, "S", 0, 0, "b"), ("d", "p", 0, "S", 0, 0, "a"), ("d", "p", 0, "S", 0, 0, "a"), ("d", "p", 0, "S", 1, 1, "c")]
    row = assembly.assemble_sheets(spark.createDataFrame(cells, SHEET_CELLS)).first()
    assert row["pages"][0]["tables"] == [[["a", ""], ["", "c"]]]


def test_intermediates_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from docloom import session

    def stub(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default: folder)
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stub("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stub("local-cluster[2,1,1024]"))
    assert session.shared_folder(stub("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(stub("local[2]")) == session.shared_folder(stub("local[2]"))


def test_audit_lines(spark):
    lines = ['{"ts": "t", "file": "a.pdf", "match_score": 0.5, "candidate_scores": {"x": 0.5}, "more": 1}', "", "  ", "{broken", "[]", '  {"file": "b"}  ']
    good, bad = audit.parse_audit_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert [(r["file"], r["match_score"], r["extra"]) for r in good.collect()] == [("a.pdf", 0.5, {"more": "1"}), ("b", None, None)]
    assert sorted(r["line"] for r in bad.collect()) == ["[]", "{broken"]


def test_stream_replays_nothing(spark, sf, tmp_path):
    docs = corpus.render_orders(spark, sf)
    templates = corpus.as_store(spark, corpus.order_templates())
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drop(low, high):
        part = docs.filter((F.col("doc_id").cast("int") >= low) & (F.col("doc_id").cast("int") < high))
        part.coalesce(2).write.mode("append").parquet(source)

    def run():
        run_folder(spark, source, templates, out, f"{out}/checkpoint", files_per_batch=1).awaitTermination()
        return spark.read.parquet(f"{out}/results")

    drop(0, 40)
    first = run()
    assert first.count() == first.select("doc_id").distinct().count() == 40
    assert run().count() == 40
    drop(40, 50)
    results = run()
    assert results.select("doc_id").distinct().count() == results.count() == 50
    records, bad = audit.read_audit(spark, f"{out}/audit")
    assert (records.count(), bad.count()) == (50, 0)
    passed = results.filter("route = 'HIT_PASS'").count()
    assert hit_deltas(spark, out).agg(F.sum("hits")).first()[0] == passed
