"""Correlation, lags, event-triggered averages, mutual information, agreement, ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid_pair(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull()


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are present; NULL for a constant side or fewer than two rows."""
    x, y = F.when(valid_pair(a, b), F.col(a)), F.when(valid_pair(a, b), F.col(b))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((spread > 1e-12) & (F.count(x) > 1), F.try_divide(F.covar_pop(x, y), spread))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p_value(r: float, n: int) -> float | None:
    """Two-sided p of a correlation r over n rows."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def with_p_value(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds p_value; one call for each statistic row, not for each sample."""
    schema = T.StructType([*df.schema.fields, T.StructField("p_value", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_value=[pearson_p_value(None if pd.isna(x) else x, k) for x, k in zip(b[r], b[n], strict=True)])

    return df.mapInPandas(run, schema)


def unpivot(df: DataFrame, ids: list[str], names: list[str], name: str = "region", value: str = "value") -> DataFrame:
    return df.unpivot(ids, names, name, value)


def cross_correlation(df: DataFrame, key: str, a: str, b: str, lags: int, time_true: bool = False) -> DataFrame:
    """(key, lag, r) for |lag| <= lags. Both sides are z-scored over valid rows (population deviation + 1e-10), which
    are closed up first unless ``time_true``; the sum of products is divided by their full number."""
    every = Window.partitionBy(key)
    ok = df.where(valid_pair(a, b))
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / (F.stddev_pop(c).over(every) + 1e-10)
    at = F.col("frame") if time_true else F.row_number().over(every.orderBy("frame"))
    scored = ok.select(key, at.cast("int").alias("i"), z(a).alias("za"), z(b).alias("zb"), F.count("*").over(every).alias("n"))
    left = scored.select(key, "za", "n", F.col("i").alias("ia"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")).withColumn("i", F.col("ia") - F.col("lag"))
    return left.join(scored.select(key, "i", "zb"), [key, "i"]).groupBy(key, "lag").agg((F.sum(F.col("za") * F.col("zb")) / F.first("n")).alias("r"))


def peak_lag(xcorr: DataFrame, key: str) -> DataFrame:
    """The lag with the largest r (to nine places), the smallest of equals."""
    return xcorr.groupBy(key).agg(F.max_by(F.struct("lag", "r"), F.struct(F.round("r", 9), -F.col("lag"))).alias("p")).select(key, "p.lag", "p.r")


def event_triggered(events: DataFrame, signal: DataFrame, key: str, before: int, after: int, value: str = "value") -> DataFrame:
    """(lag, mean, sem, n): signal around events at ``frame``, lags -before..after-1, missing samples left out."""
    around = events.select(key, F.col("frame").alias("at"), F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("lag")).withColumn("frame", F.col("at") + F.col("lag"))
    joined = around.join(signal.select(key, "frame", value), [key, "frame"])
    n = F.count(value)
    return joined.groupBy("lag").agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.greatest(n, F.lit(1)))).alias("sem"), n.alias("n"))


def quantile_bins(df: DataFrame, value: str, bins: int, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Equal-width bins 0..bins-1 between two exact percentiles; outer values fall into the end bins."""
    edges = df.agg(F.percentile(value, F.lit(low)).alias("__lo"), F.percentile(value, F.lit(high)).alias("__hi"))
    width = F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins
    number = F.least(F.greatest(F.floor(F.coalesce(width, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, number).drop("__lo", "__hi")  # edges: one row


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mi, n): nats from the contingency table of two bin columns."""
    counts = df.groupBy(a, b).agg(F.count("*").cast("double").alias("c"))
    table = counts.withColumn("ca", F.sum("c").over(Window.partitionBy(a))).withColumn("cb", F.sum("c").over(Window.partitionBy(b))).withColumn("t", F.sum("c").over(Window.partitionBy(F.lit(0))))
    return table.agg(F.sum(F.col("c") / F.col("t") * F.log(F.col("c") * F.col("t") / (F.col("ca") * F.col("cb")))).alias("mi"), F.sum("c").cast("bigint").alias("n"))


def surrogate_information(df: DataFrame, a: str, b: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(round, mi): mutual information of a with b after random permutations of b.

    A permutation of rows is a contingency table drawn with the same margins (multivariate hypergeometric, row by row),
    so only the margins, whose size is the number of bins, leave the cluster's partial sums.
    """
    import numpy as np
    import pandas as pd

    margins = [[int(r["count"]) for r in df.groupBy(c).count().orderBy(c).collect()] for c in (a, b)]

    def run(batches):
        for batch in batches:
            out = []
            for k in batch["id"]:
                rng, left, mi = np.random.default_rng([seed, int(k)]), np.array(margins[1]), 0.0
                share, n = left / max(left.sum(), 1), max(left.sum(), 1)
                for total in margins[0]:
                    row = rng.multivariate_hypergeometric(left, total)
                    left = left - row
                    some = row > 0
                    mi += float((row[some] / n * np.log(row[some] / (total * share[some]))).sum())
                out.append((int(k), mi))
            yield pd.DataFrame(out, columns=["round", "mi"])

    return df.sparkSession.range(rounds).mapInPandas(run, "round long, mi double")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts, agreement and Cohen's kappa of two boolean columns, in one row."""
    n = {f"n{i}{j}": F.count_if((F.col(a) == bool(i)) & (F.col(b) == bool(j))).cast("double") for i in (0, 1) for j in (0, 1)}
    t = df.agg(*[c.alias(k) for k, c in n.items()]).withColumn("n", F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    po = F.try_divide(F.col("n00") + F.col("n11"), F.col("n"))
    pe = F.try_divide((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")), F.col("n") * F.col("n"))
    return t.withColumn("agreement", po).withColumn("kappa", F.try_divide(po - pe, F.when(pe != 1, 1 - pe)))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """U of the first group and z with tie and continuity correction, in one row."""
    held = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t"), F.count_if(F.col(group) == first).alias("t1"))
    before = F.coalesce(F.sum("t").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = held.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum("t1").cast("double").alias("n1"), F.sum(F.col("t") - F.col("t1")).cast("double").alias("n2"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    return s.select(u.alias("u"), F.try_divide(F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5, sd).alias("z"), "n1", "n2")


def local_maxima(df: DataFrame, key: str, height: float | Column, distance: int, value: str = "value") -> DataFrame:
    """Peaks of at least ``height``, at least ``distance`` frames apart; the tallest is kept first, later ones of equals.

    Candidates are found by lag and lead; only they meet in one group for each key.
    """
    w = Window.partitionBy(key).orderBy("frame")
    v = F.col(value)
    peaks = df.withColumn("__p", F.lag(value).over(w)).withColumn("__n", F.lead(value).over(w)).where((v > F.col("__p")) & (v > F.col("__n")) & (v >= height)).select(key, F.col("frame").cast("long").alias("frame"), v.cast("double").alias("value"))

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frames, values = pdf["frame"].to_numpy(), pdf["value"].to_numpy()
        keep = [True] * len(pdf)
        for i in sorted(range(len(pdf)), key=lambda i: (values[i], frames[i]), reverse=True):
            if keep[i]:
                for step in (-1, 1):
                    j = i + step
                    while 0 <= j < len(pdf) and abs(frames[j] - frames[i]) < distance:
                        keep[j] = False
                        j += step
        return pdf[keep]

    return peaks.groupBy(key).applyInPandas(thin, peaks.schema)
