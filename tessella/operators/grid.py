"""Intervals and points onto frame grids, masks, resampling, joins of modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import to_frame


def dense(df: DataFrame, key: str, frames: int) -> DataFrame:
    """Every frame 0..frames-1 of every key."""
    return df.select(key).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))


def raster_intervals(df: DataFrame, key: str, fps: float, value: Column, order: list[str], frames: int) -> DataFrame:
    """(key, frame, value): half-open [start, end) in frames; of overlapping intervals the later one wins."""
    first, last = F.greatest(to_frame(F.col("start"), fps), F.lit(0)), F.least(to_frame(F.col("end"), fps), F.lit(frames)) - 1
    hit = df.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("frame"), F.struct(*order).alias("o"), value.alias("value"))
    return hit.groupBy(key, "frame").agg(F.max_by("value", "o").alias("value"))


def raster_points(df: DataFrame, key: str, fps: float, frames: int) -> DataFrame:
    """(key, frame, n): points add up in a frame; those outside the grid are left out."""
    frame = to_frame(F.col("time"), fps)
    return df.select(key, frame.alias("frame")).where(F.col("frame").between(0, frames - 1)).groupBy(key, "frame").agg(F.count("*").alias("n"))


def band_mask(points: DataFrame, key: str, margin: int, frames: int) -> DataFrame:
    """Distinct (key, frame) within ``margin`` frames of a point at ``frame``."""
    near = F.sequence(F.greatest(F.col("frame") - margin, F.lit(0)), F.least(F.col("frame") + margin, F.lit(frames - 1)))
    return points.select(key, F.explode(near).alias("frame")).distinct()


def neighbours(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds the last valid (order, value) at or before each row and the first at or after it."""
    w = Window.partitionBy(key).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("__b", back).withColumn("__a", ahead)


def interpolated(order: str) -> Column:
    """Linear between the neighbours, held beyond the ends."""
    b, a = F.col("__b"), F.col("__a")
    share = F.try_divide(F.col(order) - b["at"], a["at"] - b["at"])
    return F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * F.coalesce(share, F.lit(0.0)))


def resample(samples: DataFrame, grid: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, value) on the grid's times: linear between samples, clamped at the ends. A value is missing
    where the interpolated share of missing samples exceeds one half; missing samples count as the next valid one, else
    the last."""
    filled = neighbours(samples, key, time, value).select(key, time, F.coalesce(F.col("__a.v"), F.col("__b.v")).alias("v"), F.col(value).isNull().cast("double").alias("gone"))
    rows = filled.select(key, time, F.lit(0).alias("on_grid"), "v", "gone").unionByName(grid.select(key, time, F.lit(1).alias("on_grid")), allowMissingColumns=True)
    for name in ("v", "gone"):
        rows = neighbours(rows, key, time, name).withColumn(f"i_{name}", interpolated(time)).drop("__a", "__b")
    return rows.where("on_grid = 1").select(key, time, F.when(F.col("i_gone") <= 0.5, F.col("i_v")).alias(value))


def join_modalities(key: str, base: DataFrame, *others: DataFrame) -> DataFrame:
    """Wide rows by (key, frame); what a modality lacks is missing."""
    for other in others:
        base = base.join(other, [key, "frame"], "left")
    return base


def fit_length(df: DataFrame, key: str, frames: int, flags: tuple[str, ...] = ()) -> DataFrame:
    """Cut or pad to ``frames`` frames: numbers missing, flags true."""
    out = dense(df, key, frames).join(df, [key, "frame"], "left")
    return out.fillna(dict.fromkeys(flags, True)) if flags else out


def common_length(lengths: DataFrame, key: str, tolerance: float = 0.5) -> DataFrame:
    """Shortest duration of each key over its modalities, with a warning flag beyond the tolerance."""
    return lengths.groupBy(key).agg(F.min("duration").alias("duration"), (F.max("duration") - F.min("duration") > tolerance).alias("mismatch"))
