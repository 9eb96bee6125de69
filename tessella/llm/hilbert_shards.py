"""Sharding along a Hilbert curve, with DataFrame operations only.

Several metadata columns are quantised to ``bits`` bits each: numbers by approximate quantiles, strings by exact ones
of whole values (counted by value, range-sorted and summed up). The cells are numbered along a Hilbert curve, rows are range-sorted by that
number and cut into runs. Rows near in all dimensions share a shard, so minimum and maximum of each
dimension in the shard's files prune many of them.

Law ``rows``: shard sizes differ by one row at most. Rows of one cell are ordered by size, checksum and
doc_id, so equal texts with equal metadata are neighbours. Null dimensions fall into the lowest
cell, null texts count as empty (size 1, checksum 0), rows that repeat get slots of their own, an
empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K


def ordered_number(df: DataFrame, name: str) -> Column:
    """A double in the order of the column; a string as it is."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        return c
    if kind in ("date", "timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def quantised(value: Column, cuts: list) -> Column:
    """How many cut points lie below the value; null gives 0."""
    below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value) if cuts else F.array()
    return F.when(value.isNull(), 0).otherwise(F.size(below))


def _undo(q: int):
    """The step for one bit and one dimension: swap or flip the lower bits of the first coordinate."""
    p = F.lit(q - 1)

    def step(v: Column, i: Column) -> Column:
        own = F.element_at(v, i + 1)
        swap = v[0].bitwiseXOR(own).bitwiseAND(p)
        flip = own.bitwiseAND(F.lit(q)) != 0
        flipped = lambda e, k: F.when(k == 0, e.bitwiseXOR(p)).otherwise(e)
        swapped = lambda e, k: F.when((i != 0) & ((k == 0) | (k == i)), e.bitwiseXOR(swap)).otherwise(e)
        return F.transform(v, lambda e, k: F.when(flip, flipped(e, k)).otherwise(swapped(e, k)))

    return step


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell: undo the rotations bit by bit, Gray-code, interleave."""
    n = len(cells)
    x = F.array(*[c.cast("int") for c in cells])
    for b in range(bits - 1, 0, -1):
        x = F.aggregate(F.array(*[F.lit(i) for i in range(n)]), x, _undo(1 << b))
    gray = F.aggregate(x, F.array().cast("array<int>"), lambda a, e: F.concat(a, F.array(F.when(F.size(a) == 0, e).otherwise(e.bitwiseXOR(F.element_at(F.concat(F.array(F.lit(0)), a), -1))))))
    twist = lambda v: F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(F.element_at(v, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    turned = F.transform(F.array(gray), lambda v: F.struct(v.alias("v"), twist(v).alias("t")))[0]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.aggregate(
        F.transform(F.array(turned), lambda s: F.transform(places, lambda p: F.call_function("shiftright", F.element_at(s["v"], p["i"] + 1).bitwiseXOR(s["t"]), p["b"]).bitwiseAND(F.lit(1))))[0],
        F.lit(0).cast("long"),
        lambda acc, b: acc * 2 + b.cast("long"),
    )


def string_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """Exact quantiles of a string column: at most 2 ** bits - 1 values, whatever their length or number."""
    kinds = df.select(F.col(f"`{name}`").alias("v")).where("v IS NOT NULL").groupBy("v").count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = K.stored(kinds.repartitionByRange(partitions, "v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)))
    runs = placed.groupBy("run").agg(F.sum("count").alias("held"))  # a row for each partition
    before = runs.select("run", F.coalesce(F.sum("held").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(F.lit(0))).alias("n"))
    upto = F.sum("count").over(Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("upto", upto).join(F.broadcast(before), "run").withColumn("upto", F.col("upto") + F.col("before"))
    crosses = F.expr(f"upto * {1 << bits} div n > (upto - count) * {1 << bits} div n AND upto < n")
    return sorted(r[0] for r in summed.where(crosses).select("v").collect())


def cut_points(df: DataFrame, names: list[str], bits: int) -> dict[str, list]:
    """Quantiles of each dimension: approximate ones of numbers, by sketches of bounded size; exact ones of strings."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = {n for n, kind in df.dtypes if kind == "string"}
    numbers = [n for n in names if n not in texts]
    found = df.agg(*[F.percentile_approx(F.col(f"`{n}`"), shares, 2000).alias(n) for n in numbers]).first() if numbers else {}
    return {n: string_cuts(df, n, bits) if n in texts else sorted(set(found[n] or [])) for n in names}


def shards(docs: DataFrame, count: int = 16, dimensions: tuple[str, ...] = ("lang", "source", "size"), bits: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, the quantised dimensions q_*, curve (Hilbert position), shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), *[F.col(f"`{d}`") for d in dimensions if d != "size"])
    numbers = {d: ordered_number(base, d).alias(f"d_{d}") for d in dimensions}
    narrow = K.stored(base.select("doc_id", "size", "text_crc32", *numbers.values()))
    cuts = cut_points(narrow, [f"d_{d}" for d in dimensions], bits)
    cells = narrow.select("doc_id", "size", "text_crc32", *[quantised(F.col(f"d_{d}"), cuts[f"d_{d}"]).alias(f"q_{d}") for d in dimensions])
    curved = cells.withColumn("curve", hilbert_index([F.col(f"q_{d}") for d in dimensions], bits))
    by = ["curve", "size", "text_crc32", "doc_id"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = K.stored(curved.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    runs = placed.groupBy("run").count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("run", before.alias("before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n"))
    rank = F.col("before") + F.col("place")
    ranked = placed.join(F.broadcast(starts), "run").withColumn("rank", rank)
    shard = F.expr(f"cast(rank * {count} div n as int)")
    return ranked.withColumn("shard", shard).withColumn("slot", F.expr(f"rank - (cast(shard as bigint) * n + {count - 1}) div {count}")).drop("run", "at", "place", "before", "n", "rank")


def manifest(placed: DataFrame) -> DataFrame:
    """Rows, bytes and the range of each quantised dimension of every shard: what file pruning uses."""
    dims = [c for c in placed.columns if c.startswith("q_")]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{n}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents' placement as one folder for each shard."""
    shards(docs, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(K.read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
