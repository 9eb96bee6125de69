"""Sources and sinks of annotation projects, labels, dictionaries, signals and audio files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = """version INT, project STRUCT<subtitleLines: ARRAY<STRUCT<id: STRING, text: STRING, startTime: DOUBLE, endTime: DOUBLE>>,
characterAnnotations: ARRAY<STRUCT<id: STRING, lineId: STRING, char: STRING, startTime: DOUBLE, endTime: DOUBLE, singingStyle: STRING>>,
actionAnnotations: ARRAY<STRUCT<id: STRING, startTime: DOUBLE, endTime: DOUBLE, label: STRING>>,
builtinTracks: ARRAY<STRUCT<id: STRING, name: STRING, attachedPointTracks: ARRAY<STRUCT<id: STRING, name: STRING, points: ARRAY<STRUCT<id: STRING, time: DOUBLE, label: STRING>>>>>>>"""


def read_projects(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotation documents with their file as ``part``."""
    return spark.read.schema(PROJECT).option("multiLine", True).json(list(paths)).withColumn("part", F.input_file_name())


def characters(projects: DataFrame) -> DataFrame:
    return projects.select("part", F.posexplode("project.characterAnnotations").alias("pos", "c")).where("c IS NOT NULL").select("part", "pos", "c.*")


def lines(projects: DataFrame) -> DataFrame:
    return projects.select("part", F.posexplode("project.subtitleLines").alias("pos", "l")).where("l IS NOT NULL").select("part", "pos", "l.*")


def breath_points(projects: DataFrame, name: str = "呼吸") -> DataFrame:
    """Points of the first attached track whose name contains ``name``."""
    tracks = F.flatten(F.transform("project.builtinTracks", lambda t: F.coalesce(t["attachedPointTracks"], F.array())))
    first = F.get(F.filter(tracks, lambda t: t["name"].contains(name)), F.lit(0))
    return projects.select("part", F.posexplode(first["points"]).alias("pos", "p")).select("part", "pos", "p.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones) of a tab-separated pronunciation dictionary."""
    return spark.read.option("sep", "\t").schema("word STRING, p STRING").csv(path).select("word", F.split(F.trim("p"), " +").alias("phones"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, mark, duration) of transcription tables below a folder, all columns as strings first."""
    t = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select("name", F.split("ph_seq", " ").alias("m"), F.split("ph_dur", " ").alias("d"))
    return t.select("name", F.posexplode(F.arrays_zip("m", "d")).alias("idx", "z")).select("name", "idx", F.col("z.m").alias("mark"), F.col("z.d").cast("double").alias("duration"))


def read_htk(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, mark) of label files in 100 ns ticks."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), p.alias("p")).where(F.size("p") >= 3)
    return rows.select("file", (F.col("p")[0].cast("bigint") / 1e7).alias("start"), (F.col("p")[1].cast("bigint") / 1e7).alias("end"), F.col("p")[2].alias("mark"))


def write_lines(df: DataFrame, path: str, name: str, text: str) -> None:
    """One folder of text files for each name."""
    df.select(name, text).write.partitionBy(name).text(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, channel, value) of .npz bundles: one-dimensional channels, NaN as missing."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                for channel, v in np.load(io.BytesIO(content)).items():
                    if v.ndim == 1:
                        yield pd.DataFrame({"file": file, "frame": np.arange(len(v)), "channel": channel, "value": v.astype(float)})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return raw.mapInPandas(run, "file string, frame long, channel string, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, width, frames) of WAV headers."""
    import wave

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((file, w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "width", "frames"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, rate long, channels long, width long, frames long")


def with_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
