"""Model hooks, resume bookkeeping and the steps of a run.

A model is a Python function over pandas batches, named in a registry and loaded once per worker process; the engine ships
no weights. Training of networks is outside an analytics engine and has no operator here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(NamedTuple):
    """load() gives a function from a batch to its result rows, which have ``schema``."""

    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str


MODELS: dict[str, Model] = {}


def register(name: str, schema: str) -> Callable:
    def add(load: Callable) -> Callable:
        MODELS[name] = Model(load, schema)
        return load

    return add


def infer(df: DataFrame, name: str) -> DataFrame:
    """Rows of the model ``name`` over ``df``; an unknown name is an error before anything runs."""
    if name not in MODELS:
        raise KeyError(f"no model {name!r}; known: {', '.join(sorted(MODELS))}")
    load, schema = MODELS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def plug_in(found: dict[str, Callable], name: str, suffix: str) -> Callable:
    """A plug-in by its name, with or without the family's suffix."""
    key = name if name.endswith(suffix) else name + suffix
    if key not in found:
        raise KeyError(f"no {suffix} named {name!r}")
    return found[key]


def softmax(scores: Column) -> Column:
    """Softmax of an array, stable for large scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def total_confidence(c: str) -> Column:
    """Confidence of a path: exp of a third of the mean log of its frames'."""
    return F.exp(F.avg(F.ln(F.col(c) + 1e-6)) / 3)


def edge_target(edge: Column) -> Column:
    """Trained edge values back to probabilities: the sigmoid's 0.1 .. 0.9 range, clipped to 0 .. 1."""
    return F.least(F.greatest((sigmoid(edge) - 0.1) / 0.8, F.lit(0.0)), F.lit(1.0))


def fingerprint(df: DataFrame, fields: list[str]) -> DataFrame:
    """A digest of the fields that must agree before a run may resume."""
    parts = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return df.withColumn("signature", F.sha2(parts, 256))


def pending(batches: DataFrame, stored: DataFrame, key: str, restart: bool = False) -> DataFrame:
    """Batches still to run. A stored result with another signature is an error unless everything restarts."""
    if restart:
        return batches
    known = stored.select(key, F.col("signature").alias("__stored"))
    joined = batches.join(known, key, "left")
    clash = F.col("__stored").isNotNull() & (F.col("__stored") != F.col("signature"))
    checked = joined.withColumn("__stored", F.when(clash, F.raise_error(F.format_string("batch %s was stored with other settings", F.col(key).cast("string")))).otherwise(F.col("__stored")))
    return checked.where("__stored IS NULL").drop("__stored")


def run_steps(keys: list[str], steps: list[tuple[str, Callable[[str], None], bool]]) -> list[tuple[str, str, str | None]]:
    """(key, status, step) of each recording: passed, or failed at a step; a failing optional step is skipped."""
    out = []
    for key in keys:
        status, at = "passed", None
        for name, step, optional in steps:
            try:
                step(key)
            except Exception:
                if optional:
                    status, at = "skipped", name
                    continue
                status, at = "failed", name
                break
        out.append((key, status, at))
    return out
