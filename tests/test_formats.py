"""Round trips of files, audio arithmetic, model hooks and resumption."""

import json
import math
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import models
from tessella.sources import grids, waves


def save(path, x, rate=100, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(waves.to_bytes(x.ravel(), width))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_samples_round_trip(width):
    top = 1 << (8 * width - 1)
    x = np.array([[-top, top - 1], [0, -1], [5, 6]])
    assert (waves.pcm(waves.to_bytes(x.ravel(), width), width, 2) == x).all()


def test_wave_mix_clip_and_write(spark, tmp_path):
    x = np.stack([np.arange(200), np.arange(200) + 3], axis=1)
    save(tmp_path / "a.wav", x)
    mean, first = (waves.read_wave(spark, str(tmp_path), m) for m in ("mean", "first"))
    assert np.allclose(np.array(mean.first()["samples"]) * 32768, x.mean(axis=1)) and np.allclose(np.array(first.first()["samples"]) * 32768, x[:, 0])
    spans = first.select("path").crossJoin(spark.createDataFrame([(0.5, 1.0, "c"), (1.85, 2.5, "d")], "start double, end double, name string"))
    made = {r["name"]: r for r in waves.clips(first, spans, 0.1).collect()}
    assert np.allclose(np.array(made["c"]["samples"]) * 32768, np.arange(40, 110)) and len(made["d"]["samples"]) == 25
    out = {r["name"]: r["content"] for r in waves.encode_wave(waves.clips(first, spans)).collect()}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c.wav").write_bytes(out["c"])
    assert np.allclose(np.array(waves.read_wave(spark, str(tmp_path / "out")).first()["samples"]) * 32768, np.arange(50, 100))
    (tmp_path / "out" / "c.wav").write_bytes(waves.downmix((tmp_path / "a.wav").read_bytes(), 0.5, 1.0))
    assert np.allclose(np.array(waves.read_wave(spark, str(tmp_path / "out")).first()["samples"]) * 32768, np.arange(50, 100) + 1)


def test_energy_of_frames(spark):
    x = [math.sin(i) for i in range(1500)]
    r = spark.range(1).select(waves.rms(F.lit(x), 512, 256).alias("r"), waves.pressure_level(F.lit([0.0] * 600)).alias("p"), waves.stem_rest(F.lit([3.0, 2.0, 9.0]), F.lit([1.0, 5.0])).alias("s")).first()
    padded = np.r_[np.zeros(256), x, np.zeros(256)]
    want = [np.sqrt((padded[i : i + 512] ** 2).mean()) for i in range(0, len(padded) - 511, 256)]
    assert np.allclose(r["r"], want) and set(r["p"]) == {None} and r["s"] == [2.0, -3.0]


def test_tier_documents_round_trip(spark, tmp_path):
    rows = [("k", 0, "words", 0.0, 0.5, 'a "b"'), ("k", 0, "words", 0.5, 1.25, ""), ("k", 1, "phones", 0.0, 1.25, "x")]
    df = spark.createDataFrame(rows, "k string, tier_no int, tier string, start double, end double, mark string")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "k.TextGrid").write_text(grids.tier_text(df, "k").first()["text"])
    got = sorted((r["tier_no"], r["tier"], r["idx"], r["time"], r["mark"]) for r in grids.read_tiers(spark, str(tmp_path / "t")).collect())
    assert got == [(0, "words", 0, 0.0, 'a "b"'), (0, "words", 1, 0.5, ""), (0, "words", 2, 1.25, ""), (1, "phones", 0, 0.0, "x"), (1, "phones", 1, 1.25, "")]


def test_lexicon_settings_and_documents(spark, tmp_path, monkeypatch):
    entries = [{"character": "哭", "lookupVariants": ["泣"]}, {"字": "转"}, 5]
    for name, value in (("a", entries[:2]), ("b", {"entries": entries[:2]})):
        grids.write_document(str(tmp_path / name / "x.json"), value)
        assert (tmp_path / name / "x.json").read_text().endswith("]\n" if name == "a" else "}\n") and [p.name for p in (tmp_path / name).iterdir()] == ["x.json"]
        assert sorted((r["character"], r["字"]) for r in grids.read_lexicon(spark, str(tmp_path / name)).fillna("").collect()) == [("", "转"), ("哭", "")]
    monkeypatch.setenv("TESSELLA_B", "own")
    (tmp_path / "env").write_text("# no\n\nTESSELLA_A='x=y'\nTESSELLA_B=z\n")
    assert grids.read_settings(str(tmp_path / "env")) == {"TESSELLA_A": "x=y", "TESSELLA_B": "own"}
    with pytest.raises(FileNotFoundError, match="run the first step"):
        grids.require(str(tmp_path / "none"), "run the first step")
    assert json.loads((tmp_path / "b" / "x.json").read_text())["entries"][1] == {"字": "转"}


def test_models_and_resumption(spark):
    @models.register("double", "id long, y double")
    def load():
        return lambda b: pd.DataFrame({"id": b["id"], "y": b["id"] * 2.0})

    assert [r["y"] for r in models.infer(spark.range(3), "double").orderBy("id").collect()] == [0.0, 2.0, 4.0]
    with pytest.raises(KeyError, match="double"):
        models.infer(spark.range(3), "none")
    work = models.fingerprint(spark.createDataFrame([("b1", 1, None), ("b2", 1, "x")], "batch string, v int, m string"), ["v", "m"])
    assert [r["batch"] for r in models.pending(work, work.where("batch = 'b1'"), "batch").collect()] == ["b2"]
    other = work.where("batch = 'b1'").withColumn("signature", F.lit("old"))
    with pytest.raises(Exception, match="other settings"):
        models.pending(work, other, "batch").collect()
    assert models.pending(work, other, "batch", restart=True).count() == 2

    def fail(key):
        if key == "bad":
            raise ValueError(key)

    assert models.run_steps(["ok", "bad"], [("a", lambda k: None, False), ("b", fail, False)]) == [("ok", "passed", None), ("bad", "failed", "b")]
    assert models.run_steps(["bad"], [("b", fail, True), ("c", lambda k: None, False)]) == [("bad", "skipped", "b")]


def test_scores(spark):
    r = spark.range(1).select(models.softmax(F.lit([1000.0, 1000.0])).alias("s"), models.edge_target(F.lit(-50.0)).alias("e")).first()
    assert r["s"] == [0.5, 0.5] and r["e"] == 0.0
    assert abs(spark.createDataFrame([(0.5,), (0.5,)], "c double").agg(models.total_confidence("c").alias("t")).first()["t"] - (0.5 + 1e-6) ** (1 / 3)) < 1e-12
