"""Shared text handling: Arrow batches to word codes, cluster-safe storage, doc_id folds.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``. Everything here works on whole
texts; batches are cut only between rows.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by a Python worker; a longer single text is handled alone.
SLICE_BYTES = 8 << 20


class Words(NamedTuple):
    """codes[i] indexes vocab; the words of row r are codes[offsets[r]:offsets[r + 1]]."""

    codes: np.ndarray
    vocab: pa.Array
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that a slice holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def plain(text: pa.Array) -> pa.Array:
    """Null texts become empty. The result owns its bytes from offset zero: some kernels misread a cast slice."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if len(text) and (text.offset or np.frombuffer(text.buffers()[1], np.int64, 1)[0]):
        text = text.take(pa.array(np.arange(len(text))))
    return text


def split_lists(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flattened values and offsets from zero of an Arrow list array."""
    offsets = values.offsets.to_numpy().astype(np.int64)
    return values.flatten(), offsets - offsets[0]


def keep_where(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets after the elements outside ``mask`` are gone."""
    return np.r_[0, np.cumsum(mask)][offsets]


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    flat, offsets = split_lists(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text)))
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat, offsets = flat.filter(pa.array(~empty)), keep_where(~empty, offsets)
    return flat, offsets


def encode(flat: pa.Array, offsets: np.ndarray) -> Words:
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets)


def words(text: pa.Array, lower: bool = False) -> Words:
    text = plain(text)
    return encode(*word_lists(pc.ascii_lower(text) if lower else text))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give 0. Exact for integers."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets into them."""
    values = values.cast(pa.large_binary())
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_values(values: pa.Array) -> np.ndarray:
    """XXH64 (seed 42) of each string, computed for all of them at once."""
    data, offsets = bytes_view(values)
    return xxh64(data, offsets[:-1], offsets[1:])


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for every i; ranges may overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    lane_at = lambda at: lanes[at].view("<u8").ravel()
    start, length = np.asarray(start, np.int64), (np.asarray(end) - start).astype(np.int64)
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed + P5, np.uint64)
        at, left = start.copy(), length.copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            acc = [np.full(len(long), v, np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live, pos = np.arange(len(long)), at[long].copy()
            stripes = length[long] // 32
            for s in range(int(stripes.max())):
                live = live[stripes[live] > s]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], lane_at(pos[live] + 8 * k))
                pos[live] += 32
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                merged = (merged ^ _round(np.zeros_like(v), v)) * P1 + P4
            h[long], at[long], left[long] = merged, pos, length[long] % 32
        h = h + length.astype(np.uint64)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), lane_at(at[i])), 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        if len(i):
            h[i] = _rotl(h[i] ^ ((lane_at(at[i]) & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[i] += 4
            left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (padded[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def shingle_spans(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Space-joined shingles of each row as spans of one byte buffer: (data, start, end, row offsets).

    A row with fewer words gives its whole sequence, a row without words nothing.
    """
    data, offs = bytes_view(w.vocab)
    lens = np.diff(offs)[w.codes]
    at = np.cumsum(lens + 1) - (lens + 1)  # each word is followed by one space
    out = np.full(int(lens.sum() + len(lens)), 32, np.uint8)
    if len(lens):
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(at, lens) + inner] = data[np.repeat(offs[:-1][w.codes], lens) + inner]
    counts = w.counts
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row_offsets = np.r_[0, np.cumsum(number)]
    first = np.arange(int(row_offsets[-1])) - np.repeat(row_offsets[:-1] - w.offsets[:-1], number)
    last = first + np.repeat(np.minimum(counts, size), number) - 1
    return out, at[first], at[last] + lens[last], row_offsets


def hash_text(values: list[str | bytes]) -> np.ndarray:
    return hash_values(pa.array([v.encode() if isinstance(v, str) else v for v in values], pa.large_binary()))


def crc(data: bytes | np.ndarray) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        with contextlib.suppress(Exception):
            named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, **options: object) -> DataFrame:
    """Write to the shared folder, with Parquet's ``options``, and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
