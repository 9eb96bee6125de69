"""Views of the star-schema tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.grid import band_mask, dense

EPOCH, FRAMES = 1704067200, 720
TYPES = ("click", "view", "signup", "purchase", "error")
#: Order of line items in an utterance. Windows in this very order share one sort.
PLACE = ("l_linenumber", "l_partkey", "l_shipdate", "l_suppkey", "l_extendedprice")
PART_ROWS = 1_000_000


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def parted(df: DataFrame, key: str) -> DataFrame:
    """Dealt by key into parts of about a million rows, where the session's shuffle partitions would be larger."""
    n = -(-df.count() // PART_ROWS)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6) - F.lit(float(EPOCH))


def base(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select((F.col("user_id") % 10).alias("vid"), F.floor(seconds("ts") / 3600).cast("int").alias("frame"), "event_type", "value").where(F.col("frame").between(0, FRAMES - 1))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """(vid, frame): hourly event counts, mean value of each type (missing without events), cut near errors."""
    b = base(spark, sf)
    means = [F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"m_{t}") for t in TYPES]
    agg = b.groupBy("vid", "frame").agg(F.count("*").cast("double").alias("n"), *means)
    cut = band_mask(b.where("event_type = 'error'").select("vid", "frame"), "vid", 1, FRAMES).withColumn("cut", F.lit(True))
    full = dense(b, "vid", FRAMES).join(agg, ["vid", "frame"], "left").join(cut, ["vid", "frame"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0.0))).withColumn("cut", F.coalesce("cut", F.lit(False)))


def chars(spark: SparkSession, sf: str) -> DataFrame:
    """Events as intervals: start in hours, a length of value / 60."""
    e = read(spark, sf, "events")
    start = seconds("ts") / 3600
    return e.select((F.col("user_id") % 10).alias("vid"), F.col("event_id").alias("pos"), F.col("user_id").alias("lineId"), F.col("event_type").alias("char"), start.alias("start"), (start + F.col("value") / 60).alias("end"), F.col("value").alias("value"))


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 32 joints of a frame; 50 frames to a shot."""
    e = read(spark, sf, "embeddings")
    j = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("joint"), F.element_at("embedding", 2 * i + 1).cast("double").alias("x"), F.element_at("embedding", 2 * i + 2).cast("double").alias("y")))
    return e.select(F.expr("vec_id div 50").alias("shot"), F.col("vec_id").alias("frame"), F.explode(j).alias("j")).select("shot", "frame", "j.joint", "j.x", "j.y", (F.abs("j.x") * 4).alias("conf"))


def tiers(spark: SparkSession, sf: str, *also: str, even: bool = False) -> DataFrame:
    """Line items as labels of an utterance (order): predicted and target durations; further columns as they are.
    ``even``: in parts that do not grow with the table."""
    from pyspark.sql import Window

    li = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "utt")
    li = parted(li, "utt") if even else li
    w = Window.partitionBy("utt").orderBy(*PLACE)
    return li.select("utt", F.row_number().over(w).alias("idx"), F.col("l_returnflag").alias("mark"), F.col("l_quantity").alias("pred"), F.round(F.col("l_quantity") * (1 + F.col("l_discount") - 0.05), 4).alias("target"), *also)


GRID_SQL = """
base AS (SELECT user_id % 10 AS vid, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 3600) AS INT) AS frame, event_type, value FROM events),
inside AS (SELECT * FROM base WHERE frame BETWEEN 0 AND 719),
agg AS (SELECT vid, frame, count(*)::DOUBLE AS n, avg(value) FILTER (event_type = 'click') AS m_click, avg(value) FILTER (event_type = 'view') AS m_view,
  avg(value) FILTER (event_type = 'signup') AS m_signup, avg(value) FILTER (event_type = 'purchase') AS m_purchase, avg(value) FILTER (event_type = 'error') AS m_error,
  count(*) FILTER (event_type = 'error') AS err FROM inside GROUP BY vid, frame),
dense AS (SELECT vid, CAST(f AS INT) AS frame FROM (SELECT DISTINCT vid FROM inside), range(720) r(f)),
grid AS (SELECT vid, frame, coalesce(n, 0) AS n, m_click, m_view, m_signup, m_purchase, m_error,
  coalesce(max(err) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) > 0 AS cut FROM dense LEFT JOIN agg USING (vid, frame))"""
CHARS_SQL = """
chars AS (SELECT user_id % 10 AS vid, event_id AS pos, user_id AS lineId, event_type AS char, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS start,
  (epoch_us(ts) / 1e6 - 1704067200) / 3600 + value / 60 AS "end", value FROM events)"""
KP_SQL = """
kp AS (SELECT vec_id // 50 AS shot, vec_id AS frame, CAST(j AS INT) AS joint, embedding[2 * j + 1]::DOUBLE AS x, embedding[2 * j + 2]::DOUBLE AS y, abs(embedding[2 * j + 1]::DOUBLE) * 4 AS conf
  FROM embeddings, range(32) r(j))"""
TIERS_SQL = """
tiers AS (SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_suppkey, l_extendedprice) AS idx,
  l_returnflag AS mark, l_quantity AS pred, round(l_quantity * (1 + l_discount - 0.05), 4) AS target FROM lineitem)"""
