"""PCM audio: samples of WAV files, clips, stems and WAV output, a file at a time.

A file is one row; its samples are an array. Files are the parallel unit, so decoding needs no shuffle.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Integer samples (frames x channels) of little-endian PCM of 1 (unsigned), 2, 3 or 4 bytes."""
    if width == 1:
        flat = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        flat = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        flat -= (flat >> 23) << 24
    else:
        flat = np.frombuffer(raw, f"<i{width}").astype(np.int64)
    return flat.reshape(-1, channels)


def to_bytes(samples: np.ndarray, width: int) -> bytes:
    """The PCM bytes of integer samples."""
    if width == 1:
        return (samples + 128).astype(np.uint8).tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def read_wave(spark: SparkSession, path: str, mix: str = "mean") -> DataFrame:
    """(path, rate, width, samples) of WAV files, as mono in [-1, 1): mean of channels, or their ``first``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rate, width = w.getframerate(), w.getsampwidth()
                    x = pcm(w.readframes(w.getnframes()), width, w.getnchannels())
                mono = (x[:, 0] if mix == "first" else x.mean(axis=1)) / float(1 << (8 * width - 1))
                yield pd.DataFrame({"path": [file], "rate": [rate], "width": [width], "samples": [mono]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, rate long, width long, samples array<double>")


def crop(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Samples of [int(start * rate), int(end * rate)), cut at the array's end."""
    a, b = (start * rate).cast("int"), (end * rate).cast("int")
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


def stem_rest(mix: Column, voice: Column) -> Column:
    """The mix without one stem, sample by sample over their common length."""
    n = F.least(F.size(mix), F.size(voice))
    return F.zip_with(F.slice(mix, 1, n), F.slice(voice, 1, n), lambda a, b: a - b)


def frame_energy(samples: Column, size: int, hop: int) -> Column:
    """Mean square of each whole frame of ``size`` samples, ``hop`` apart, after ``size // 2`` zeros on both sides."""
    zeros = F.array_repeat(F.lit(0.0), size // 2)
    x = F.concat(zeros, samples, zeros)
    n = F.floor((F.size(x) - size) / hop).cast("int")
    mean = lambda i: F.aggregate(F.slice(x, i * hop + 1, size), F.lit(0.0), lambda s, v: s + v * v) / size
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), n), mean)).otherwise(F.array().cast("array<double>"))


def rms(samples: Column, size: int = 2048, hop: int = 512) -> Column:
    return F.transform(frame_energy(samples, size, hop), F.sqrt)


def pressure_level(samples: Column, size: int = 512, hop: int = 512) -> Column:
    """20 log10(rms / 2 * 10e5) of each frame; missing for silence."""
    return F.transform(frame_energy(samples, size, hop), lambda m: F.when(m > 0, 20 * F.log10(F.sqrt(m) / 2 * 10e5)))


def clips(files: DataFrame, spans: DataFrame, pad: float = 0.0) -> DataFrame:
    """Clip of each span (path, start, end, name), widened by ``pad`` seconds within the file."""
    total = F.size("samples") / F.col("rate")
    held = spans.join(files, "path")
    start, end = F.greatest(F.col("start") - pad, F.lit(0.0)), F.least(F.col("end") + pad, total)
    return held.select("path", "name", "rate", "width", crop(F.col("samples"), F.col("rate"), start, end).alias("samples"))


def encode_wave(df: DataFrame) -> DataFrame:
    """(name, content): a mono WAV file of each row's samples, rounded to its width and clipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rate, width, samples in zip(b["rate"], b["width"], b["samples"], strict=True):
                top = 1 << (8 * int(width) - 1)
                x = np.clip(np.rint(np.asarray(samples, float) * top), -top, top - 1).astype(np.int64)
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(int(width))
                    w.setframerate(int(rate))
                    w.writeframes(to_bytes(x, int(width)))
                out.append(held.getvalue())
            yield pd.DataFrame({"name": b["name"], "content": out})

    return df.select("name", "rate", "width", "samples").mapInPandas(run, "name string, content binary")


def downmix(content: bytes, start: float, end: float) -> bytes:
    """A clip of a WAV file as mono of the same width: integer floor of the channels' mean."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        a, b = int(start * rate), min(int(end * rate), w.getnframes())
        w.setpos(min(a, w.getnframes()))
        x = pcm(w.readframes(max(b - a, 0)), width, channels)
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(to_bytes(x.sum(axis=1) // channels, width))
    return held.getvalue()
