"""Tier documents in text form, lexicons, reports and settings."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
#: The three lines of an interval or two of a point in a long-form tier document; quotes are doubled in a mark.
INTERVAL = rf'xmin = {NUMBER}\s*\n\s*xmax = {NUMBER}\s*\n\s*text = "((?:[^"]|"")*)"'
POINT = rf'(?:number|time) = {NUMBER}\s*\n\s*mark = "((?:[^"]|"")*)"'
TIER = r'name = "((?:[^"]|"")*)"'


def read_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(file, tier, idx, time, mark) of tier documents: points; an interval tier ends with an empty mark."""
    doc = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    parts = doc.select("file", F.posexplode(F.slice(F.split("value", r"\n\s*item \[[0-9]+\]:"), 2, 1 << 30)).alias("tier_no", "body"))
    found = lambda pattern, group: F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(group))
    ends = found(INTERVAL, 2)
    spans = F.zip_with(found(INTERVAL, 1), found(INTERVAL, 3), lambda t, m: F.struct(t.cast("double").alias("time"), m.alias("mark")))
    last = F.when(F.size(ends) > 0, F.array(F.struct(F.element_at(ends, -1).cast("double").alias("time"), F.lit("").alias("mark"))))
    points = F.zip_with(found(POINT, 1), found(POINT, 2), lambda t, m: F.struct(t.cast("double").alias("time"), m.alias("mark")))
    rows = parts.select("file", "tier_no", F.regexp_extract("body", TIER, 1).alias("tier"), F.when(F.col("body").contains('"IntervalTier"'), F.concat(spans, F.coalesce(last, F.array().cast(points_type())))).otherwise(points).alias("p"))
    out = rows.select("file", "tier_no", "tier", F.posexplode("p").alias("idx", "p"))
    return out.select("file", "tier_no", "tier", "idx", "p.time", F.regexp_replace("p.mark", '""', '"').alias("mark"))


def points_type() -> str:
    return "array<struct<time: double, mark: string>>"


def tier_text(df: DataFrame, key: str) -> DataFrame:
    """(key, text): a long-form document of interval rows (key, tier_no, tier, start, end, mark)."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    part = F.struct("start", "end", "mark")
    tiers = df.groupBy(key, "tier_no", "tier").agg(F.array_sort(F.collect_list(part)).alias("rows"), F.max("end").alias("top"))
    line = lambda r, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), r["start"].cast("string"), F.lit("\n            xmax = "), r["end"].cast("string"), F.lit("\n            text = "), quoted(r["mark"]), F.lit("\n"))
    body = tiers.select(key, "tier_no", "tier", "top", F.array_join(F.transform("rows", line), "").alias("body"), F.size("rows").alias("n"))
    docs = body.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tier_no", "tier", "top", "body", "n"))).alias("tiers"), F.max("top").alias("top"))
    head = lambda t, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit(']:\n        class = "IntervalTier"\n        name = '), quoted(t["tier"]), F.lit("\n        xmin = 0\n        xmax = "), F.col("top").cast("string"), F.lit("\n        intervals: size = "), t["n"].cast("string"), F.lit("\n"), t["body"])
    start = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), F.col("top").cast("string"), F.lit("\ntiers? <exists>\nsize = "), F.size("tiers").cast("string"), F.lit("\nitem []:\n"))
    return docs.select(key, F.concat(start, F.array_join(F.transform("tiers", head), "")).alias("text"))


ENTRY = "STRUCT<character: STRING, `字`: STRING, lookupVariants: ARRAY<STRING>, toneClass: STRING, yxlzShangSubtype: STRING, rhymeSection: STRING, sourcePage: STRING, sourceText: STRING>"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a lexicon: an array of objects, or an object with ``entries``; what is no object goes."""
    text = spark.read.text(path, wholetext=True)
    own, held = F.from_json("value", f"ARRAY<{ENTRY}>"), F.from_json("value", f"STRUCT<entries: ARRAY<{ENTRY}>>")["entries"]
    listed = F.when(F.trim("value").startswith("["), own).otherwise(held)
    return text.select(F.posexplode(listed).alias("entry", "e")).where("e IS NOT NULL AND coalesce(e.character, e.`字`) IS NOT NULL").select("entry", "e.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole texts without outer white space."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def read_settings(path: str) -> dict[str, str]:
    """KEY=value lines; blank lines and comments go, outer quotes too. The process environment wins."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sep, value = line.strip().partition("=")
        if sep and not name.startswith("#"):
            out[name.strip()] = os.environ.get(name.strip(), value.strip().strip("'\""))
    return out


def write_document(path: str, value: object) -> None:
    """One JSON document, complete or not at all: a temporary file beside it takes its place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, encoding="utf-8", delete=False) as held:
        json.dump(value, held, ensure_ascii=False, indent=2)
        held.write("\n")
    os.replace(held.name, target)


def require(path: str, hint: str) -> str:
    """The path, or an error that says which step makes it."""
    if not Path(path).exists():
        raise FileNotFoundError(f"{path} is missing: {hint}")
    return path
