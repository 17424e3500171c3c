import json

import pytest

from docsift.sources import io
from docsift.streaming import ingest


def test_records_of_both_shapes(spark, tmp_path):
    rows = [{"is_code": "IS 1", "title": "a", "page_start": "3", "page_end": "x"}, {"is_code": "IS 2", "title": None}]
    for name, whole in (("list.json", rows), ("held.json", {"records": rows})):
        (tmp_path / name).write_text(json.dumps(whole, indent=1))
        got = io.read_records(spark, str(tmp_path / name)).orderBy("source_index").collect()
        assert [(r.source_index, r.is_code, r.page_start, r.page_end) for r in got] == [(1, "IS 1", 3, None), (2, "IS 2", None, None)]
    (tmp_path / "bad.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        io.read_records(spark, str(tmp_path / "bad.json"))


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string")
    assert io.write_dataset(rows, str(tmp_path / "d"), "small") == 2
    back, manifest = io.read_dataset(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "a"), (2, None)] and manifest["dataset_name"] == "small"


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ä", None)], "b long, a string, c string")
    io.write_jsonl(rows, str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.name.startswith("part") and p.stat().st_size).read_text().strip()
    assert list(json.loads(line)) == ["a", "b", "c"]
    (tmp_path / "c.jsonl").write_text('# note\n\n{"a": "x"}\n')
    assert [r.a for r in io.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a string", comments=True).collect()] == ["x"]
    (tmp_path / "e.jsonl").write_text('{"a": \n')
    with pytest.raises(Exception):  # noqa: B017
        io.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a string", strict=True).collect()


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, ["x", "y"]), ("k", 2, ["z"])], "k string, n int, l array<string>")
    io.write_csv(rows, str(tmp_path / "c"), ["k", "n", "l"])
    got = io.read_csv_by_key(spark, str(tmp_path / "c"), "k string, n int, l string", "k", "n").collect()
    assert [tuple(r) for r in got] == [("k", 2, "z")]


def test_pairs_contract(spark, tmp_path):
    good = {"query_id": "1", "query": "q", "document": "d", "label": 1, "standard_code": "c", "pair_type": "positive"}
    bad = [good | {"label": 0}, good | {"query": " "}, good | {"label": 3}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, [good, *bad])))
    keep, broken = io.read_pairs(spark, str(tmp_path / "p.jsonl"))
    assert keep.count() == 1 and sorted(r.rule for r in broken.collect()) == ["blank_text", "label", "type_mismatch"]


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), "k long, v string", "k", ["v"], str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text('{"k": 2, "v": "c"}\n{"k": 3, "v": null}\n')
    run()
    run()
    got = spark.read.parquet(ingest.latest(spark, str(tmp_path / "t"))).select("k", "v").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, "c"), (3, None)]
