"""Sinks and listings on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import documents as D
from tessella.sources import exports as X
from tessella.sources import formats


@pytest.fixture(scope="module")
def tiers(spark):
    rows = [("a", "x", i, m, s, e) for i, (m, s, e) in enumerate([("SP", 0.0, 0.333333), ("n", 0.333333, 0.666666), ("i", 0.666666, 1.0)])] + [("b", "y", 0, "SP", 0.0, 2.5)]
    return spark.createDataFrame(rows, "folder string, name string, idx int, mark string, start double, end double")


def test_export_and_read_again(spark, tiers, tmp_path):
    confidences = spark.createDataFrame([("a", "x", 0.5)], "folder string, name string, confidence double")
    assert X.export(["Praat", "lab", "diffsinger", "confidence", "odd"], tiers, confidences, str(tmp_path)) == ["odd"]
    back = formats.read_transcriptions(spark, str(tmp_path / "transcriptions")).orderBy("name", "idx").collect()
    assert [(r["name"], r["mark"], r["duration"]) for r in back] == [("x", "SP", 0.33333), ("x", "n", 0.33334), ("x", "i", 0.33333), ("y", "SP", 2.5)]
    assert spark.read.option("header", True).csv(str(tmp_path / "confidence")).count() == 1
    lab = formats.read_htk(spark, str(tmp_path / "htk" / "*"))
    assert sorted((round(r["start"], 6), r["mark"]) for r in lab.collect()) == [(0.0, "SP"), (0.0, "SP"), (0.333333, "n"), (0.666666, "i")]
    assert {r["name"]: r["ph_dur"] for r in spark.read.json(str(tmp_path / "textgrid")).collect()} == {"a/x": "0.333333 0.333333 0.333334", "b/y": "2.5"}


def test_documents(spark):
    s = spark.createDataFrame([(1, 1, 1.0, 2.0, "b"), (1, 0, 0.0, 1.0, "a")], "k int, idx int, start double, end double, text string")
    assert json.loads(X.segment_documents(s, "k").first()["document"]) == {"text": "ab", "segments": [{"start": 0.0, "end": 1.0, "text": "a"}, {"start": 1.0, "end": 2.0, "text": "b"}]}
    shots = spark.createDataFrame([(1, 30, 59, 1.0), (1, 0, 29, 1.0)], "k int, start int, end int, seconds double")
    assert [x["start"] for x in json.loads(X.shot_documents(shots, "k").first()["document"])["shots"]] == [0, 30]
    assert X.libretto(s.withColumnRenamed("idx", "pos"), "k").first()["text"] == "ab"
    assert spark.range(1).select(X.label_name(F.lit(7), F.lit("l2")).alias("n")).first()["n"] == "007_l2"
    got = spark.createDataFrame([(1234567.8,), (0.00012345678,), (2.0,), (0.0,)], "x double").select(D.significant(F.col("x")).alias("t"))
    assert [r["t"] for r in got.collect()] == ["1234570", "0.000123457", "2", "0"]


def test_listings(spark, tmp_path):
    for name in ("a/1.wav", "a/2.wav", "b/3.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="no transcript"):
        X.with_sidecars(spark, str(tmp_path), "txt")
    (tmp_path / "a/2.txt").write_text("ni hao\n")
    assert [(r["path"].rsplit("/", 1)[1], r["text"]) for r in X.with_sidecars(spark, str(tmp_path), "txt").collect()] == [("2.wav", "ni hao")]
    assert [r["path"].rsplit("/", 1)[1] for r in X.file_pairs(spark, str(tmp_path), "wav", "txt").collect()] == ["2.wav"]
    full = spark.createDataFrame([("p", "full_label", "a b")], "path string, label_type string, ph_seq string")
    assert sorted((r["label_type"], r["ph_seq"] or "") for r in X.with_unlabelled(full, X.listing(spark, str(tmp_path / "b"), "wav")).collect()) == [("full_label", "a b"), ("no_label", "")]


def test_settings(spark, tmp_path):
    good, bad, odd = tmp_path / "s.json", tmp_path / "e.json", tmp_path / "o.json"
    good.write_text(json.dumps({"videos": [{"id": "v"}], "joint_groups": {"m": {"hand": [1]}}}))
    bad.write_text("{}")
    odd.write_text("[1")
    s = X.load_settings(spark, str(good))
    assert X.recording(s, "v") == {"id": "v"} and X.joint_groups(s, "m") == {"hand": [1]}
    for f in (lambda: X.recording(s, "w"), lambda: X.joint_groups(s, "n")):
        with pytest.raises(KeyError):
            f()
    with pytest.raises(ValueError, match="empty"):
        X.load_settings(spark, str(bad))
    with pytest.raises(ValueError, match="no JSON"):
        X.read_document(spark, str(odd))
    good.write_text(json.dumps({"project": {"lines": [{"id": 1}, 3, None], "name": "n"}}))
    assert X.read_document(spark, str(good)) == {"lines": [{"id": 1}], "name": "n"}
    odd.write_text("[1]")
    with pytest.raises(TypeError):
        X.read_document(spark, str(odd))
    assert X.check_run(0, 5, 1.5, None) == ["max_lines", "threshold", "key"] and X.check_run(1, 5, 0.8, None, True) == []
    assert X.default_output("/d/in.json") == "/d/in.draft.json"
