"""Motion from keypoints: masks, root and scale, joint groups, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Coordinates below the confidence threshold become missing."""
    return df.withColumns({c: F.when(F.col("conf") >= threshold, F.col(c)) for c in ("x", "y")})


def midpoint(df: DataFrame, keys: list[str], joints: tuple[int, int], prefix: str) -> DataFrame:
    """(keys, prefix_x, prefix_y): centre of two joints, missing unless both are present."""
    pair = df.where(F.col("joint").isin(*joints))
    both = F.count("x") == 2
    return pair.groupBy(*keys).agg(*[F.when(both, F.avg(c)).alias(f"{prefix}_{c}") for c in ("x", "y")])


def root_mode(df: DataFrame, keys: list[str], hips: tuple[int, int], limit: float = 0.5) -> DataFrame:
    """One row (missing, mode): the shoulder is the root where hips are missing in over half of the frames."""
    hip = midpoint(df, keys, hips, "hip")
    return hip.agg(F.avg(F.col("hip_x").isNull().cast("double")).alias("missing")).withColumn("mode", F.when(F.col("missing") > limit, "shoulder").otherwise("hip"))


def normalised(df: DataFrame, root: DataFrame, scale: DataFrame, keys: list[str], smallest: float = 5.0) -> DataFrame:
    """Coordinates from the root in units of the scale; a missing or small scale makes them missing."""
    ok = F.when(F.col("scale") >= smallest, F.col("scale"))
    out = df.join(root, keys, "left").join(scale, keys, "left")
    return out.withColumn("x", (F.col("x") - F.col("root_x")) / ok).withColumn("y", (F.col("y") - F.col("root_y")) / ok)


def group_means(df: DataFrame, keys: list[str], groups: dict[str, list[int] | None], joints: int, value: str) -> DataFrame:
    """Mean of each joint group, missing if all of it is; a None group is all joints, joints beyond the model are left out."""
    means = [F.avg(F.when(F.col("joint").isin(*[j for j in (g if g is not None else range(joints)) if j < joints]), F.col(value))).alias(name) for name, g in groups.items()]
    return df.groupBy(*keys).agg(*means)


def mean_of_two(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


def quality(df: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """Share of confident joints and mean confidence of each frame."""
    return df.groupBy(*keys).agg(F.avg((F.col("conf") >= threshold).cast("double")).alias("valid"), F.avg("conf").alias("confidence"))


def summary(value: str) -> list[Column]:
    """Missing share, mean, population deviation and their ratio of a column."""
    return [F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv")]


def best_person(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The highest-scoring person of each frame, the first of equals."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(score, -F.col("person"))).alias("p")).select(*keys, "p.*")
