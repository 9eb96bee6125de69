"""Best-fit-decreasing packing of token ids into fixed windows, with binary output.

Texts become ids (see ``tokens``). Overlong documents are cut losslessly: full windows first, then the
rest. Rests are pooled, ``POOL`` at a time in each task, and placed by decreasing length into the open
window with the least room that suffices; a segment tree over the possible amounts of room finds it. A task
holds one pool, whatever the size of the input, and no shuffle is needed.

A sequence has its ids (unsigned 32-bit, little-endian, zero-padded to the window), ``cu_seqlens`` (ends of its
pieces, from 0), ``position_ids`` (unsigned 16-bit, from 0 in every piece) and its pieces. Null and empty
texts are one id; repeated rows are packed each; ties keep the order of rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .tokens import Encoder

WINDOW, POOL = 1024, 16384


class RoomTree:
    """Segment tree over room 0..size-1; a leaf stacks the windows with that much room."""

    def __init__(self, size: int):
        self.base = 1 << (size - 1).bit_length()
        self.some = [0] * (2 * self.base)
        self.leaf: list[list[int]] = [[] for _ in range(size)]

    def add(self, room: int, window: int) -> None:
        self.leaf[room].append(window)
        i = room + self.base
        while i:
            self.some[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least ``need``."""
        i = need + self.base
        if need >= len(self.leaf):
            return None
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.base
        window = self.leaf[room].pop()
        while i:
            self.some[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of piece numbers; every length is 1 to ``window``."""
    tree, out = RoomTree(window + 1), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            out.append([i])
            tree.add(window - lengths[i], len(out) - 1)
        else:
            room, w = found
            out[w].append(i)
            tree.add(room - lengths[i], w)
    return out


PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>"
SCHEMA = f"sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, pieces array<{PIECE}>"
ARROW_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")])
ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("pieces", pa.list_(ARROW_PIECE))])


def pack(docs: DataFrame, window: int = WINDOW, pool: int = POOL, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row for each packed sequence, in the form of SCHEMA."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary))
    source = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        steps = np.arange(window, dtype="<u2")

        def rows(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for a in range(0, len(groups), 512):
                columns: list[list] = [[], [], [], [], [], []]
                for group in groups[a : a + 512]:
                    ends = np.cumsum([len(p[4]) for p in group])
                    ids = np.zeros(window, "<u4")
                    ids[: ends[-1]] = np.concatenate([p[4] for p in group]) if len(group) > 1 else group[0][4]
                    positions = np.zeros(window, "<u2")
                    positions[: ends[-1]] = np.concatenate([steps[: len(p[4])] for p in group])
                    pieces = [{"doc_id": p[0], "start": p[1], "length": len(p[4]), "ids_crc32": p[3], "doc_tokens": p[2], "offset": int(e) - len(p[4])} for p, e in zip(group, ends, strict=True)]
                    for c, v in zip(columns, (made, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(), pieces), strict=True):
                        c.append(v)
                    made += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for b in K.slices(batches):
            ids, offsets = encoder.value.encode(b.column("text"))
            ids = ids.astype("<u4", copy=False)
            full = []
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for a in range(lo, hi, window):
                    part = ids[a : min(a + window, hi)]
                    piece = (doc, a - lo, hi - lo, K.crc(part.tobytes()), part)
                    if len(part) == window:
                        full.append([piece])
                    else:
                        rests.append((*piece[:4], part.copy()))
            yield from rows(full)
            while len(rests) >= pool:
                head, rests = rests[:pool], rests[pool:]
                yield from rows([[head[i] for i in w] for w in best_fit_decreasing([len(p[4]) for p in head], window)])
        yield from rows([[rests[i] for i in w] for w in best_fit_decreasing([len(p[4]) for p in rests], window)])

    return source.mapInArrow(run, SCHEMA)


def pieces(packed: DataFrame) -> DataFrame:
    """One row for each piece of the packed sequences."""
    return packed.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed sequences as Parquet: id matrix rows, cumulative lengths and position resets."""
    pack(docs, **options).write.parquet(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(K.read(spark, sf_dir, "documents")))
