"""Scalar functions: rounding rules, times, text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def missing(x: Column) -> Column:
    """NaN becomes NULL, the engine's only missing value."""
    return F.nanvl(x, F.lit(None).cast("double"))


def to_frame(t: Column, fps: float) -> Column:
    """Nearest frame, halves to even."""
    return F.rint(t * fps).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, k: int = 4) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, k) + F.lit(0.0)


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def first_han(text: Column) -> Column:
    """First Han character, NULL without one."""
    return F.nullif(F.regexp_extract(text, HAN, 0), F.lit(""))


def timestamp(seconds: Column, legacy: bool = False) -> Column:
    """``HH:MM:SS,mmm``. legacy keeps a rounded-up fraction as ``,1000`` instead of carrying it."""
    if legacy:
        whole = F.floor(seconds)
        ms = F.rint((seconds - whole) * 1000).cast("bigint")
    else:
        total = F.rint(seconds * 1000).cast("bigint")
        whole, ms = F.floor(total / 1000).cast("bigint"), F.pmod(total, F.lit(1000))
    whole = whole.cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), ms)


def to_ticks(seconds: Column, truncate: bool = True) -> Column:
    """Time in 100 ns, truncated or rounded half to even."""
    return (seconds * 1e7).cast("bigint") if truncate else F.rint(seconds * 1e7).cast("bigint")


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def ramp_up(x: Column) -> Column:
    """exp(-5 (1 - x)^2), 0 before 0 and 1 after 1."""
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(F.exp(-5.0 * (1 - x) * (1 - x)))


def cents_to_hz(cents: Column) -> Column:
    return 10.0 * F.pow(F.lit(2.0), cents / 1200.0)


def carried_durations(ends: Column, k: int = 5) -> Column:
    """Durations rounded so that their running sum stays next to the true ends (array in, array out)."""
    start = F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        d = F.bround(e - s["acc"], k)
        return F.struct((s["acc"] + d).alias("acc"), F.concat(s["out"], F.array(d)).alias("out"))

    return F.aggregate(ends, start, step, lambda s: s["out"])
