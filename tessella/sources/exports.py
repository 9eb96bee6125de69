"""Sinks of tiers, confidences, segments and reports, listings of file pairs, and run settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import carried_durations
from tessella.operators.documents import significant
from tessella.operators.tiers import htk_lines

#: The names that each output format is known by.
FORMATS = {"textgrid": "textgrid", "praat": "textgrid", "htk": "htk", "lab": "htk", "nnsvs": "htk", "sinsy": "htk", "trans": "transcriptions", "transcription": "transcriptions", "transcriptions": "transcriptions", "transcriptions.csv": "transcriptions", "diffsinger": "transcriptions", "confidence": "confidence"}


def listed(column: str, *order: str):
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, column))), lambda x: x[column])


def transcription_rows(tiers: DataFrame) -> DataFrame:
    """(folder, name, ph_seq, ph_dur): durations rounded to five places without drift. tiers: folder, name, idx, mark, end."""
    rows = tiers.groupBy("folder", "name").agg(listed("mark", "idx").alias("marks"), listed("end", "idx").alias("ends"))
    return rows.select("folder", "name", F.array_join("marks", " ").alias("ph_seq"), F.array_join(F.transform(carried_durations(F.col("ends")), lambda d: d.cast("string")), " ").alias("ph_dur"))


def tier_rows(tiers: DataFrame) -> DataFrame:
    """(name, ph_seq, ph_dur) with durations of six significant digits. tiers: name, idx, mark, start, end."""
    rows = tiers.withColumn("d", significant(F.col("end") - F.col("start"))).groupBy("name").agg(listed("mark", "idx").alias("marks"), listed("d", "idx").alias("ds"))
    return rows.select("name", F.array_join("marks", " ").alias("ph_seq"), F.array_join("ds", " ").alias("ph_dur"))


def write_tables(rows: DataFrame, path: str) -> None:
    """CSV with header, one folder of files for each ``folder``."""
    rows.write.partitionBy("folder").option("header", True).mode("overwrite").csv(path)


def export(formats: list[str], tiers: DataFrame, confidences: DataFrame, path: str) -> list[str]:
    """Write each known format below ``path``; names the formats that are not known."""
    writers: dict[str, Callable[[], Any]] = {
        "htk": lambda: htk_lines(tiers.withColumn("file", F.concat_ws("/", "folder", "name")), "file").write.partitionBy("file").mode("overwrite").text(f"{path}/htk"),
        "textgrid": lambda: tier_rows(tiers.withColumn("name", F.concat_ws("/", "folder", "name"))).write.mode("overwrite").json(f"{path}/textgrid"),
        "transcriptions": lambda: write_tables(transcription_rows(tiers), f"{path}/transcriptions"),
        "confidence": lambda: write_tables(confidences.select("folder", "name", "confidence"), f"{path}/confidence"),
    }
    known = dict.fromkeys(FORMATS[f.lower()] for f in formats if f.lower() in FORMATS)
    for name in known:
        writers[name]()
    return [f for f in formats if f.lower() not in FORMATS]


def segment_documents(segments: DataFrame, key: str) -> DataFrame:
    """(key, document): JSON with the whole text and the segments in order. segments: key, idx, start, end, text."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("idx", "start", "end", "text"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return segments.groupBy(key).agg(each.alias("segments")).select(key, F.to_json(F.struct(F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), "segments")).alias("document"))


def shot_documents(shots: DataFrame, key: str) -> DataFrame:
    """(key, document): JSON with the shots of a recording in order of start."""
    each = F.sort_array(F.collect_list(F.struct("start", "end", "seconds")))
    return shots.groupBy(key).agg(each.alias("shots")).select(key, F.to_json(F.struct(F.size("shots").alias("count"), "shots")).alias("document"))


def libretto(lines: DataFrame, key: str) -> DataFrame:
    """(key, text): texts of the lines in document order."""
    return lines.groupBy(key).agg(F.array_join(listed("text", "pos"), "").alias("text"))


def label_name(index, line_id):
    """File name of a segment: its number in three digits and its line."""
    return F.concat_ws("_", F.lpad(index.cast("string"), 3, "0"), line_id)


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, stem) of the files with a suffix below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    return files.withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))


def file_pairs(spark: SparkSession, path: str, one: str, other: str) -> DataFrame:
    """(stem, path) of files that have a partner of the other suffix."""
    return listing(spark, path, one).join(listing(spark, path, other).select("stem"), "stem", "left_semi")


def with_sidecars(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, text) of sound files with a transcript beside them; an error if there is none at all."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path).select(F.trim("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"\.[^./]+$", "")
    found = listing(spark, path, "wav").select("path", bare("path").alias("stem")).join(texts.select(bare("file").alias("stem"), "text"), "stem").select("path", "text")
    if found.isEmpty():
        raise ValueError(f"no transcript of type {suffix} beside a sound file in {path}")
    return found


def with_unlabelled(labelled: DataFrame, listing: DataFrame) -> DataFrame:
    """Labelled rows and the listed files as rows of null labels and of type no_label."""
    both = labelled.unionByName(listing.select("path"), allowMissingColumns=True)
    return both.withColumn("label_type", F.coalesce("label_type", F.lit("no_label")))


def load_settings(spark: SparkSession, path: str) -> dict:
    """Settings of a JSON document; an error if it is missing, empty or not an object."""
    rows = spark.read.option("wholetext", True).text(path).collect()  # one document
    found = json.loads(rows[0][0]) if rows and rows[0][0].strip() else None
    if not isinstance(found, dict) or not found:
        raise ValueError(f"settings are empty: {path}")
    return found


def recording(settings: dict, name: str) -> dict:
    """The entry of a recording; an error names those that there are."""
    entries = {e["id"]: e for e in settings.get("videos", [])}
    if name not in entries:
        raise KeyError(f"{name} is none of {sorted(entries)}")
    return entries[name]


def joint_groups(settings: dict, model: str) -> dict[str, list[int] | None]:
    groups = settings.get("joint_groups", {})
    if model not in groups:
        raise KeyError(f"no joint groups of {model}")
    return groups[model]


def check_run(max_lines: int, max_chars: int, threshold: float, key: str | None, dry_run: bool = False) -> list[str]:
    """What is wrong with the settings of an annotation run."""
    faults = {"max_lines": max_lines <= 0, "max_chars": max_chars <= 0, "threshold": not 0 <= threshold <= 1, "key": not dry_run and not key}
    return [name for name, bad in faults.items() if bad]


def default_output(path: str, ending: str = ".draft.json") -> str:
    """The path with its suffix replaced."""
    p = PurePosixPath(path)
    return str(p.with_name(p.stem + ending))


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON object, with or without a ``project`` around it, without items that are no objects; an error names the file and the reason."""
    rows = spark.read.option("wholetext", True).text(path).collect()  # one document
    try:
        found = json.loads(rows[0][0])
    except (json.JSONDecodeError, IndexError) as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise TypeError(f"{path}: the root is no object")
    inner = found.get("project", found)
    return {k: [x for x in v if isinstance(x, dict)] if isinstance(v, list) else v for k, v in inner.items()}
