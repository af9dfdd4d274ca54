"""One JSON object read by lines and splits, and written over several files."""

import json
import random

import pytest

from docloom.sources import json_object

VALUE = "struct<a:bigint,b:string,c:array<struct<d:string>>>"


def an_object(rng, n):
    texts = ["x", 'q"uo\\te', "{[", "]}", "\\", "Ä 😀 \u2028", "", "a,\nb", '"k": {', "é" * 300]
    pick = lambda: rng.choice(texts) + rng.choice(texts)
    return {f"{i}-{pick()}": {"a": rng.randrange(99), "b": pick(), "c": [{"d": pick()} for _ in range(rng.randrange(3))]} for i in range(n)}


def layouts(obj):
    yield json.dumps(obj, indent=2, ensure_ascii=False)
    yield json.dumps(obj)
    yield "{" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in obj.items()) + "}"
    yield "\n\n {\n" + "\n,".join(f"{json.dumps(k)}\n:\r\n{json.dumps(v, indent=1)}" for k, v in obj.items()) + "\n}\n\n"
    yield "{" + ",\n".join(", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in list(obj.items())[i : i + 3]) for i in range(0, len(obj), 3)) + "}"


def read(spark, path):
    rows = json_object.members(spark, str(path), VALUE).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [(r.key, r.value.asDict(True)) for r in rows]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_every_layout_reads_alike(spark, tmp_path, split):
    """Small splits put members and their lines on several tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    obj = an_object(random.Random(3), 40)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for i, text in enumerate(layouts(obj)):
            path = tmp_path / f"{i}.json"
            path.write_bytes(text.encode())
            if split != "128m":
                assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
            assert read(spark, path) == list(obj.items()), i
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_written_over_several_files_and_read_back(spark, tmp_path):
    obj = an_object(random.Random(4), 60)
    rows = [(i * 3, k, json.dumps(v, ensure_ascii=False)) for i, (k, v) in enumerate(obj.items())]
    random.Random(1).shuffle(rows)
    path = tmp_path / "object"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        json_object.write_object(spark.createDataFrame(rows, "seq bigint, key string, entry string"), str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(path.glob("part-*"))
    assert len(files) > 2
    assert list(json.loads("".join(f.read_text() for f in files)).items()) == list(obj.items())
    assert read(spark, path) == list(obj.items())


def test_empty_object(spark, tmp_path):
    json_object.write_object(spark.createDataFrame([], "seq bigint, key string, entry string"), str(tmp_path / "none"))
    assert read(spark, tmp_path / "none") == []
    for i, text in enumerate(["{}", " {\n}\n", "{\n\n\n}"]):
        (tmp_path / f"{i}.json").write_text(text)
        assert read(spark, tmp_path / f"{i}.json") == []


BAD = [
    "{", "}", "[]", "x", '"a"', '{"a": {"a": 1}', '{"a": {"a": 1}}}', '{"a": {"a": 1},}', '{"a": {"a": 1}\n"b": {"a": 1}}',
    '{"a": {"b": "x\ny"}}', "{}\n{}", '{"a": {"a": 1}}\n"b": {"a": 1}', '{"a": {"a": "x"}}', '{"a": 1}', '{\n"a": {"a": 1},\n}', '{"a": {"a": 1},\n,"b": {"a": 1}}',
]


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_whole_object_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        json_object.members(spark, str(path), VALUE).collect()
