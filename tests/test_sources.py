"""Readers and writers on small files, and the stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborstat.sources import readers as R, schemas, writers as W
from arborstat.streaming.qc_stream import first_sent, start_qc, stream_cases


def test_documents_keyed_by_directory(spark, tmp_path):
    docs = {"case_1": {"mean_tortuosity": "1.25", "total_volume_mm3": 10.5, "missing_generations": [3, 4]}, "case_2_gaussian": {"mean_tortuosity": None}}
    for case, d in docs.items():
        (tmp_path / case / "analysis").mkdir(parents=True)
        (tmp_path / case / "analysis" / "metrics.json").write_text(json.dumps(d, indent=2))
    df = R.read_documents(spark, f"{tmp_path}/*/analysis/metrics.json", schemas.METRIC_BAG, r"/([^/]+)/analysis/", arrays={"missing_generations": "int"})
    got = {r["case"]: (r["mean_tortuosity"], r["total_volume_mm3"], r["missing_generations"]) for r in df.collect()}
    assert got == {"case_1": (1.25, 10.5, [3, 4]), "case_2_gaussian": (None, None, None)}


def test_whole_text_reports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "report.txt").write_text("Total branches: 12\nP/C Ratio: 0.4\n")
    r = R.read_reports(spark, f"{tmp_path}/*/report.txt", r"/([^/]+)/report")
    assert [(x["case"], x["body"]) for x in r.collect()] == [("a", "Total branches: 12\nP/C Ratio: 0.4\n")]


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Patient,Weeks,FVC,Percent,Age,Sex,SmokingStatus\np,-3,2925,NaN,73,Male,Never smoked\n")
    r = R.read_csv(spark, str(tmp_path / "v.csv"), schemas.VISITS).first()
    assert (r["Weeks"], r["Percent"]) == (-3, None)
    with pytest.raises(Exception):
        R.read_csv(spark, str(tmp_path / "v.csv"), schemas.VISITS.replace("Weeks", "Month")).collect()


def test_broken_rows_are_set_aside_with_a_reason(spark, tmp_path):
    (tmp_path / "v.csv").write_text('id,week,note,value\n1,2,"a,b",1.5\n2,two,x,1\n3,4,y\n4,4,y,1,9\n5,,,NaN\n6,1,z,1 kg\n')
    good, bad = R.read_csv_checked(spark, str(tmp_path / "v.csv"), "id long, week int, note string, value double")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2, "a,b", 1.5), (5, None, None, None)]
    assert {r.record: r.reason for r in bad.collect()} == {
        "2,two,x,1": "not a number: week", "3,4,y": "wrong number of fields", "4,4,y,1,9": "wrong number of fields", "6,1,z,1 kg": "not a number: value",
    }


def test_broken_documents_are_set_aside_with_a_reason(spark, tmp_path):
    texts = {"a": '{"v": "1.5", "n": 3}', "b": '{"v": ', "c": '{"v": "x", "n": 1}', "d": '{"n": 2.5}', "e": "{}"}
    for case, text in texts.items():
        (tmp_path / case).mkdir()
        (tmp_path / case / "m.json").write_text(text)
    good, bad = R.read_documents_checked(spark, f"{tmp_path}/*/m.json", {"v": "double", "n": "long"}, r"/([^/]+)/m")
    assert {r.case: (r.v, r.n) for r in good.collect()} == {"a": (1.5, 3), "e": (None, None)}
    assert {r.case: r.reason for r in bad.collect()} == {"b": "unreadable", "c": "not a number: v", "d": "not a number: n"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="week"):
        R.require_columns(spark.range(1), ["id", "week"])


def test_file_copies(spark, tmp_path):
    for side in ("o", "c"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "same.bin").write_bytes(b"abc")
        (tmp_path / side / "off.bin").write_bytes(b"abc" if side == "o" else b"abd")
    (tmp_path / "o" / "gone.bin").write_bytes(b"x")
    got = R.copy_integrity(R.read_binary(spark, str(tmp_path / "o")), R.read_binary(spark, str(tmp_path / "c")), "name", "content", "length")
    assert {r["name"]: r["all_checks_passed"] for r in got.collect()} == {"same.bin": True, "off.bin": False, "gone.bin": False}


def test_inventory_counts_header_and_data_together(spark, tmp_path):
    (tmp_path / "s1.mhd").write_bytes(b"12")
    (tmp_path / "s1.zraw").write_bytes(b"12345")
    r = R.file_inventory(R.list_files(spark, str(tmp_path))).first()
    assert (r["stem"], r["n_files"], r["n_bytes"]) == ("s1", 2, 7)


def test_position_sample(spark):
    rows = [("big", i * 3) for i in range(101)] + [("small", i) for i in range(30)]
    got = R.sample_positions(spark.createDataFrame(rows, "k string, seq long"), ["k"], "seq").collect()
    big = sorted(r["seq"] // 3 for r in got if r["k"] == "big")
    assert big == [*range(10), *range(45, 55), *range(91, 101)]
    assert sum(r["k"] == "small" for r in got) == 30


def test_checks_on_a_stream(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") * 1.0).alias("airway_volume_ml"))
    W.write_table(rows, str(tmp_path / "in"), "json")
    q = start_qc(
        stream_cases(spark, str(tmp_path / "in"), "id long, airway_volume_ml double"), "id", {"airway_volume_ml": "airway_volume_ml"}, F.lit(True),
        str(tmp_path / "out"), str(tmp_path / "ck"),
    )
    q.awaitTermination(120)
    out = {r["status"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("status").count().collect()}
    assert out == {"UNRELIABLE": 5, "RELIABLE": 35}


def test_stream_drops_what_is_sent_again_and_goes_on_after_a_stop(spark, tmp_path):
    schema = "id long, airway_volume_ml double, sent timestamp"
    row = lambda i, volume, minute: (i, float(volume), datetime(2024, 1, 1, minute // 60, minute % 60))
    deliveries = [[row(1, 100, 0), row(2, 1, 1), row(2, 1, 1)], [row(1, 100, 30), row(3, 200, 31), row(2, 1, 2)]]
    for rows in deliveries:
        W.write_table(spark.createDataFrame(rows, schema), str(tmp_path / "in"), mode="append")
        cases = first_sent(stream_cases(spark, str(tmp_path / "in"), schema, "parquet"), "id", "sent", "2 hours")
        start_qc(cases, "id", {"airway_volume_ml": "airway_volume_ml"}, F.lit(True), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((r["id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "RELIABLE"), (2, "UNRELIABLE"), (3, "RELIABLE")]
