"""Filters over the frame axis. Rows are (key, frame, value) on a dense grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import interpolated, neighbours


def by_frame(key: str):
    return Window.partitionBy(key).orderBy("frame")


def mirrored(df: DataFrame, key: str, frames: int, radius: int) -> DataFrame:
    """Adds ``radius`` reflected rows (d c b a | a b c d | d c b a) at both ends."""
    if radius > frames:
        raise ValueError("the filter is longer than the signal")
    low = df.where(F.col("frame") < radius).withColumn("frame", -1 - F.col("frame"))
    high = df.where(F.col("frame") >= frames - radius).withColumn("frame", 2 * frames - 1 - F.col("frame"))
    return df.unionByName(low).unionByName(high)


def inside(df: DataFrame, frames: int) -> DataFrame:
    return df.where(F.col("frame").between(0, frames - 1))


def uniform(df: DataFrame, key: str, frames: int, size: int, value: str = "value", out: str = "smooth") -> DataFrame:
    """Moving average over [i - size // 2, i + size - 1 - size // 2] with reflected edges."""
    w = by_frame(key).rowsBetween(-(size // 2), size - 1 - size // 2)
    return inside(mirrored(df, key, frames, size).withColumn(out, F.avg(value).over(w)), frames)


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(k) for x in k]


def gaussian(df: DataFrame, key: str, frames: int, sigma: float, value: str = "value", out: str = "smooth") -> DataFrame:
    """Gaussian filter cut at four sigma, with reflected edges; the value must not be missing."""
    k = kernel(sigma)
    radius = len(k) // 2
    held = F.collect_list(value).over(by_frame(key).rowsBetween(-radius, radius))
    padded = mirrored(df, key, frames, radius).withColumn("__held", held)
    return inside(padded, frames).withColumn(out, weighted_of("__held", k)).drop("__held")


def weighted_of(name: str, k: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.col(name), F.array(*[F.lit(x) for x in k]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def normalised_gaussian(df: DataFrame, key: str, frames: int, sigma: float, value: str = "value", out: str = "smooth") -> DataFrame:
    """Gaussian over valid samples only: smoothed values over smoothed validity; missing stays missing."""
    both = df.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0))).withColumn("__w", F.col(value).isNotNull().cast("double"))
    both = gaussian(gaussian(both, key, frames, sigma, "__v", "__sv"), key, frames, sigma, "__w", "__sw")
    return both.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("__sw") >= 1e-6), F.col("__sv") / F.col("__sw"))).drop("__v", "__w", "__sv", "__sw")


def islands(df: DataFrame, key: str, flag: Column, out: str = "island") -> DataFrame:
    """Number of the run of equal flags that a row is in."""
    w = by_frame(key)
    changed = df.withColumn("__f", flag).withColumn("__c", F.coalesce((F.col("__f") != F.lag("__f").over(w)).cast("int"), F.lit(1)))
    return changed.withColumn(out, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c", "__f")


def runs(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """(key, first, last, n) of each run of rows where the flag holds."""
    marked = islands(df.withColumn("__on", flag), key, F.col("__on"))
    return marked.where("__on").groupBy(key, "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).drop("island")


def median(df: DataFrame, key: str, size: int, value: str = "value", out: str = "smooth") -> DataFrame:
    """Median over each run of valid rows, zeros beyond its ends; runs shorter than ``size`` stay as they are."""
    marked = islands(df, key, F.col(value).isNotNull())
    w = Window.partitionBy(key, "island").orderBy("frame").rowsBetween(-(size // 2), size // 2)
    held = marked.withColumn("__h", F.collect_list(value).over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(key, "island")))
    padded = F.sort_array(F.concat("__h", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("__h"))))
    return held.withColumn(out, F.when(F.col(value).isNull() | (F.col("__n") < size), F.col(value)).otherwise(F.element_at(padded, size // 2 + 1))).drop("__h", "__n", "island")


def fill_gaps(df: DataFrame, key: str, longest: int, value: str = "value", out: str = "filled") -> DataFrame:
    """Linear fill of missing runs of at most ``longest`` frames with valid rows on both sides."""
    near = neighbours(df, key, "frame", value)
    gap = F.col("__a.at") - F.col("__b.at") - 1
    return near.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(gap <= longest, interpolated("frame"))).drop("__a", "__b")


def filled_linear(df: DataFrame, key: str, value: str = "value", out: str = "filled") -> DataFrame:
    """Linear fill of everything, held beyond the ends."""
    return neighbours(df, key, "frame", value).withColumn(out, interpolated("frame")).drop("__a", "__b")


def rolling_same(df: DataFrame, key: str, size: int, value: str = "value", out: str = "smooth") -> DataFrame:
    """Centred mean that counts rows beyond the ends as zero."""
    w = by_frame(key).rowsBetween(-(size // 2), size - 1 - size // 2)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0.0)) / size)


def best_window(df: DataFrame, key: str, size: int, frames: int, value: str = "value") -> DataFrame:
    """(key, frame, total) of the window frame+1..frame+size with the largest sum, the first of equals."""
    w = by_frame(key).rowsBetween(1, size)
    sums = df.withColumn("total", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)).where(F.col("frame") + size < frames)
    return sums.groupBy(key).agg(F.max_by(F.struct("frame", "total"), F.struct(F.round("total", 6), -F.col("frame"))).alias("b")).select(key, "b.frame", "b.total")


def abs_difference(df: DataFrame, key: str, value: str = "value", out: str = "delta") -> DataFrame:
    """|x[t] - x[t-1]|; 0 on the first row and where either side is missing."""
    return df.withColumn(out, F.coalesce(F.abs(F.col(value) - F.lag(value).over(by_frame(key))), F.lit(0.0)))


def velocity(df: DataFrame, keys: list[str], fps: float, x: str = "x", y: str = "y", masked: Column | None = None) -> DataFrame:
    """Speed between a row and the next, on one row less; missing where either frame is masked."""
    w = Window.partitionBy(*keys).orderBy("frame")
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    out = df.withColumn("__m", masked if masked is not None else F.lit(False)).withColumn("__n", F.lead("frame").over(w)).withColumn("speed", F.sqrt(dx * dx + dy * dy) * fps).withColumn("__mn", F.lead("__m").over(w))
    return out.where(F.col("__n").isNotNull()).withColumn("speed", F.when(~(F.col("__m") | F.col("__mn")), F.col("speed"))).drop("__m", "__n", "__mn")
