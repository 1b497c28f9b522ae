import json
import os

import pytest

from cellwise import session, views
from cellwise.operators import records, selection
from cellwise.sources import readers, sinks
from cellwise.streaming import resume
from tests.conftest import SF


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(
        [("t1", "é"), ("t2", None)],
        "table_id string, question string"
    ).transform(lambda d: sinks.write_jsonl(d.coalesce(1), path) or d)
    with open(tmp_path / "in" / "part-x.json", "w") as f:
        f.write('\n{"table_id": "t3", "evidence_cells": [{"row": 1, "value": 2.5}]}\n{broken\n')
    got = {r["table_id"]: r for r in readers.read_records(spark, path).collect()}
    assert got["t1"]["question"] == "é" and got["t3"]["evidence_cells"][0]["value"] == "2.5" and got[None]["_corrupt"] == "{broken"


def test_json_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        json.dumps(
            [
                {"table": {"uid": "a", "table": [["", "1"]]}, "questions": [{"answer_from": "text"}, {"answer_from": "table"}]},
                {"table": {"uid": "b"}, "questions": None}
            ]
        )
    )
    assert [
        (r["table"]["uid"], r["ordinal"]) for r in readers.read_contexts(spark, str(tmp_path / "c.json"), table_only=True).collect()
    ] == [("a", 0)]
    assert [r["table"]["uid"] for r in readers.read_contexts(spark, str(tmp_path / "c.json"), limit=1).collect()] == ["a"]
    (tmp_path / "r.json").write_text(json.dumps({"agg": {"n": 1}, "details": [{"example_id": "e", "valid": True}]}))
    assert readers.read_results(spark, str(tmp_path / "r.json")).first()["valid"] is True
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "eval_tables_dev": ["d"], "training_tables": ["t", "u"]}))
    m = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r[0], r[1]) for r in m.collect()} == {("d", "eval_tables_dev"), ("t", "training_tables"), ("u", "training_tables")}
    assert json.loads(sinks.report_json(sinks.manifest(m)))["counts"] == {"eval_tables_dev": 1, "training_tables": 2}
    (tmp_path / "k.json").write_text(json.dumps({"7": ["x", "y"]}))
    assert readers.read_keyed(spark, str(tmp_path / "k.json")).first()["value"] == ["x", "y"]
    (tmp_path / "p.txt").write_text("a {TABLE}\nb")
    assert readers.read_template(spark, str(tmp_path / "p.txt")) == "a {TABLE}\nb"


def test_contexts_to_clean_tables(spark, tmp_path):
    grids = [[["", "2001", "2002"], ["Tugs", "3", "(4)"], ["Berths", "5", "n/a"]], [["Tugs"]]]
    (tmp_path / "c.json").write_text(
        json.dumps([{"table": {"uid": f"u{i}", "table": g}, "questions": [{"answer_from": "table"}]} for i, g in enumerate(grids)])
    )
    one, two = readers.ingest_file(spark, str(tmp_path / "c.json"), table_only=True).orderBy("ordinal").collect()
    assert (
        one["uid"],
        one["table_id"],
        one["metric_cols"],
        one["confidence"],
        one["table"]["rows"][1]
    ) == ("u0", "table_0000", ["2001", "2002"], "high", ["Berths", "5", ""])
    assert (two["confidence"], two["table"]["rows"], two["table"]["headers"]) == ("low", [], ["Tugs"])


def test_manifests(spark, tmp_path, monkeypatch):
    roles = spark.createDataFrame([("a", "dev"), ("b", "dev"), ("a", "dev"), ("c", "test")], "base_table_id string, role string")
    sinks.write_manifest(roles, str(tmp_path / "m"))
    assert {
        tuple(r) for r in spark.read.json(str(tmp_path / "m/ids")).select("base_table_id", "role").collect()
    } == {("a", "dev"), ("b", "dev"), ("c", "test")}
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "m/counts")).select("role", "n").collect()} == {("dev", 2), ("test", 1)}
    monkeypatch.setattr(sinks, "MANIFEST_IDS", 2)
    with pytest.raises(ValueError, match="too many"):
        sinks.manifest(roles)


def test_nulls_are_written(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string").coalesce(1), str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":"é","b":null}']


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_views(spark):
    names = views.register(spark, SF, ["model_counts", "gold_ceiling"])
    assert {"documents", "model_counts", "gold_ceiling"} <= set(names)
    assert spark.sql("select sum(n) from model_counts").first()[0] == spark.sql("select count(*) from p3_4b_exec_test_verified").first()[0]
    for n in names:
        spark.catalog.dropTempView(n)


def test_a_cluster_needs_its_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session())


def test_written_tables_go_when_discarded(spark):
    m = session.materialize(spark.range(3), "three")
    path = m.inputFiles()[0].removeprefix("file://")
    assert m.count() == 3 and os.path.exists(path)
    session.discard(m)
    assert not os.path.exists(path)


def test_csv_export(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "i int, s string").coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2


def test_resumed_appends_take_each_key_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for batch in ([("e1", 1), ("e2", 1), ("e1", 2)], [("e2", 3), ("e3", 3)]):
        spark.createDataFrame(batch, "example_id string, n int").coalesce(1).write.mode("append").json(src)
        resume.append_new(resume.stream_records(spark, src, "example_id string, n int"), out, ck, "example_id").awaitTermination()
    assert sorted(r["example_id"] for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e3"]


def test_first_object():
    f = records._first_object
    assert f('so {"a": "} \\" {", "b": {"c": 1}} and }') == '{"a": "} \\" {", "b": {"c": 1}}'
    assert f("none") is None and f('{"open": "') is None and f(None) is None


def test_splits_are_stable_and_disjoint(spark):
    ids = spark.range(500).selectExpr("cast(id as string) as t")
    a = selection.freeze_splits(ids.unionAll(ids), "t", 45, 35).collect()
    assert len({r["t"] for r in a}) == len(a) == 500
    assert sorted(map(tuple, a)) == sorted(map(tuple, selection.freeze_splits(ids.repartition(7), "t", 45, 35).collect()))
    assert sum(r["role"] == "test" for r in a) == 45 and sum(r["role"] == "dev" for r in a) == 35
