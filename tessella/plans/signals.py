"""Queries on gridded signals: filters, correlation, events, information, motion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import views as V
from tessella.functions.scalars import rounded as r4
from tessella.operators import dsp, grid, motion, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REGIONS = ["m_click", "m_signup", "m_purchase", "n"]
LONG_SQL = "long AS (SELECT vid, frame, cut, m_view AS ref, region, value FROM (SELECT * FROM grid), LATERAL (VALUES ('m_click', m_click), ('m_signup', m_signup), ('m_purchase', m_purchase), ('n', n)) u(region, value))"
R_SQL = "CASE WHEN sqrt(var_pop(a) * var_pop(b)) > 1e-12 AND count(*) > 1 THEN round(covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)), 4) + 0.0 END"


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def region_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stats.unpivot(V.grid(spark, sf), ["vid", "frame", "cut", "m_view"], REGIONS)


@query("q_region_corr", f"SELECT region, {R_SQL} AS r, count(*) AS n FROM (SELECT region, ref AS a, value AS b FROM long WHERE NOT cut AND ref IS NOT NULL AND value IS NOT NULL) GROUP BY region", V.GRID_SQL, LONG_SQL)
def region_corr(spark, sf):
    ok = region_rows(spark, sf).where(~F.col("cut") & stats.valid_pair("m_view", "value"))
    return ok.groupBy("region").agg(r4(stats.pearson("m_view", "value")).alias("r"), F.count("*").alias("n"))


@query("q_region_p_value")
def region_p(spark, sf):
    return stats.with_p_value(region_corr(spark, sf))


@query("q_quality", "SELECT region, round(avg((value IS NULL)::INT), 4) AS missing, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(stddev_pop(value) / avg(value), 4) AS cv FROM long GROUP BY region", V.GRID_SQL, LONG_SQL)
def quality(spark, sf):
    t = region_rows(spark, sf).groupBy("region").agg(*motion.summary("value"))
    return t.select("region", *[r4(F.col(c)).alias(c) for c in ("missing", "mean", "std", "cv")])


@query("q_segment_corr", f"SELECT vid, segment, {R_SQL} AS r, count(*) AS n FROM (SELECT vid, frame // 120 AS segment, m_view AS a, m_click AS b FROM grid WHERE m_view IS NOT NULL AND m_click IS NOT NULL) GROUP BY vid, segment HAVING count(*) > 5", V.GRID_SQL)
def segment_corr(spark, sf):
    g = V.grid(spark, sf)
    cuts = g.select("vid").distinct().withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("t0", F.col("segment") * 120).withColumn("frame", F.explode(F.sequence(F.col("t0"), F.col("t0") + 119)))
    ok = g.where(stats.valid_pair("m_view", "m_click")).join(cuts.select("vid", "frame", F.col("segment").cast("int").alias("segment")), ["vid", "frame"])
    return ok.groupBy("vid", "segment").agg(r4(stats.pearson("m_view", "m_click")).alias("r"), F.count("*").alias("n")).where("n > 5")


XCORR_SQL = """ok AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY frame) AS i, m_view AS a, m_click AS b, count(*) OVER (PARTITION BY vid) AS n FROM grid WHERE m_view IS NOT NULL AND m_click IS NOT NULL),
z AS (SELECT vid, i, n, (a - avg(a) OVER (PARTITION BY vid)) / (stddev_pop(a) OVER (PARTITION BY vid) + 1e-10) AS za, (b - avg(b) OVER (PARTITION BY vid)) / (stddev_pop(b) OVER (PARTITION BY vid) + 1e-10) AS zb FROM ok),
x AS (SELECT l.vid, CAST(lag AS INT) AS lag, sum(l.za * r.zb) / max(l.n) AS r FROM z l, range(-12, 13) g(lag), z r WHERE r.vid = l.vid AND r.i = l.i - lag GROUP BY l.vid, lag)"""


@query("q_xcorr", "SELECT vid, lag, round(r, 4) + 0.0 AS r FROM x", V.GRID_SQL, XCORR_SQL)
def xcorr(spark, sf):
    return stats.cross_correlation(V.grid(spark, sf), "vid", "m_view", "m_click", 12).select("vid", "lag", r4(F.col("r")).alias("r"))


@query("q_peak_lag", "SELECT vid, lag, round(r, 4) + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY round(r, 9) DESC, lag) AS k FROM x) WHERE k = 1", V.GRID_SQL, XCORR_SQL)
def peak(spark, sf):
    return stats.peak_lag(stats.cross_correlation(V.grid(spark, sf), "vid", "m_view", "m_click", 12), "vid").select("vid", "lag", r4(F.col("r")).alias("r"))


@query("q_sliding_corr", f"SELECT vid, win, CASE WHEN count(*) > 14 THEN {R_SQL} END AS r, count(*) AS n FROM (SELECT vid, CAST(w AS INT) AS win, m_view AS a, m_click AS b FROM grid, range(29) k(w) WHERE frame >= w * 24 AND frame < w * 24 + 48 AND w * 24 < 720 - 48 AND NOT cut AND m_view IS NOT NULL AND m_click IS NOT NULL) GROUP BY vid, win", V.GRID_SQL)
def sliding(spark, sf):
    size, step = 48, 24
    g = V.grid(spark, sf).where(~F.col("cut") & stats.valid_pair("m_view", "m_click"))
    last = F.floor(F.col("frame") / step).cast("int")
    wins = g.withColumn("win", F.explode(F.array(last - 1, last))).where((F.col("win") >= 0) & (F.col("win") * step < V.FRAMES - size) & (F.col("frame") < F.col("win") * step + size))
    return wins.groupBy("vid", "win").agg(F.when(F.count("*") > 0.3 * size, r4(stats.pearson("m_view", "m_click"))).alias("r"), F.count("*").alias("n"))


TUMBLE_SQL = """rare AS (SELECT vid, frame, count(*)::DOUBLE AS k, avg(value) AS m, count(*) FILTER (event_type = 'error' AND CAST(round(value * 100) AS BIGINT) % 20 = 0) AS hits FROM inside GROUP BY vid, frame),
steady AS (SELECT vid, frame, coalesce(k, 0) AS n, m, coalesce(max(hits) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) > 0 AS cut FROM dense LEFT JOIN rare USING (vid, frame)),
act AS (SELECT vid, frame // 24 AS win, avg(n) AS rms, avg(m) AS motion FROM steady WHERE frame < 696 GROUP BY vid, win HAVING avg(cut::INT) <= 0.3 AND avg((m IS NULL)::INT) <= 0.5)"""


def activity(spark, sf):
    """Windows of 24 hours, without the one that ends with the recording: cut in 30 % at most, motion missing in half at most."""
    b = V.base(spark, sf)
    hits = b.where("event_type = 'error' AND cast(round(value * 100) AS bigint) % 20 = 0").select("vid", "frame")
    cut = grid.band_mask(hits, "vid", 1, V.FRAMES).withColumn("cut", F.lit(1))
    held = b.groupBy("vid", "frame").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"))
    g = grid.dense(b, "vid", V.FRAMES).join(held, ["vid", "frame"], "left").join(cut, ["vid", "frame"], "left").where(F.col("frame") < V.FRAMES - 24)
    t = g.groupBy("vid", F.floor(F.col("frame") / 24).cast("int").alias("win")).agg(F.avg(F.coalesce("n", F.lit(0.0))).alias("rms"), F.avg("m").alias("motion"), F.avg(F.coalesce("cut", F.lit(0))).alias("c"), F.avg(F.col("m").isNull().cast("int")).alias("missing"))
    return t.where("c <= 0.3 AND missing <= 0.5").select("vid", "win", "rms", "motion")


@query("q_tumbling_activity", "SELECT vid, win, round(rms + 1e-9, 4) AS rms, round(motion + 1e-9, 4) AS motion FROM act", V.GRID_SQL, TUMBLE_SQL)
def tumbling(spark, sf):
    return activity(spark, sf).select("vid", "win", r4(F.col("rms") + 1e-9).alias("rms"), r4(F.col("motion") + 1e-9).alias("motion"))


SPLIT_SQL = "split AS (SELECT vid, win, rms > (SELECT median(rms) FROM act) AS hi_rms, motion > (SELECT median(motion) FROM act) AS hi_motion FROM act)"


def median_split(spark, sf):
    t = activity(spark, sf)
    mid = t.agg(F.median("rms").alias("mr"), F.median("motion").alias("mm"))
    return t.crossJoin(F.broadcast(mid)).select("vid", "win", (F.col("rms") > F.col("mr")).alias("hi_rms"), (F.col("motion") > F.col("mm")).alias("hi_motion"))  # mid: one row


@query("q_median_split", "SELECT * FROM split", V.GRID_SQL, TUMBLE_SQL, SPLIT_SQL)
def split(spark, sf):
    return median_split(spark, sf)


@query("q_kappa", """SELECT n00, n01, n10, n11, n00 + n01 + n10 + n11 AS n, round((n00 + n11) / (n00 + n01 + n10 + n11), 4) AS agreement,
round(((n00 + n11) / t - pe) / (1 - pe), 4) + 0.0 AS kappa FROM (SELECT *, n00 + n01 + n10 + n11 AS t, ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11)) / ((n00 + n01 + n10 + n11) * (n00 + n01 + n10 + n11)) AS pe FROM (
SELECT count(*) FILTER (NOT hi_rms AND NOT hi_motion)::DOUBLE AS n00, count(*) FILTER (NOT hi_rms AND hi_motion)::DOUBLE AS n01, count(*) FILTER (hi_rms AND NOT hi_motion)::DOUBLE AS n10, count(*) FILTER (hi_rms AND hi_motion)::DOUBLE AS n11 FROM split))""", V.GRID_SQL, TUMBLE_SQL, SPLIT_SQL)
def agreement(spark, sf):
    t = stats.kappa(median_split(spark, sf), "hi_rms", "hi_motion")
    return t.select("n00", "n01", "n10", "n11", "n", r4(F.col("agreement")).alias("agreement"), r4(F.col("kappa")).alias("kappa"))


def mirror_sql(r: int) -> str:
    return f"mir AS (SELECT vid, frame, n FROM grid UNION ALL SELECT vid, -1 - frame, n FROM grid WHERE frame < {r} UNION ALL SELECT vid, 1439 - frame, n FROM grid WHERE frame >= {720 - r})"


@query("q_uniform", "SELECT vid, frame, round(s, 4) AS smooth FROM (SELECT vid, frame, avg(n) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS s FROM mir) WHERE frame BETWEEN 0 AND 719", V.GRID_SQL, mirror_sql(12))
def uniform(spark, sf):
    return dsp.uniform(V.grid(spark, sf).select("vid", "frame", "n"), "vid", V.FRAMES, 12, "n").select("vid", "frame", r4(F.col("smooth")).alias("smooth"))


FILL_SQL = """near AS (SELECT vid, frame, cut, n, m_view AS v, last_value(CASE WHEN m_view IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, last_value(m_view IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN m_view IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1, first_value(m_view IGNORE NULLS) OVER a AS v1 FROM grid
  WINDOW b AS (PARTITION BY vid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lin AS (SELECT vid, frame, cut, n, v, CASE WHEN f0 IS NULL THEN v1 WHEN f1 IS NULL OR f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END AS filled, f1 - f0 - 1 AS gap FROM near)"""


@query("q_gapfill", "SELECT vid, frame, round(CASE WHEN v IS NOT NULL THEN v WHEN gap <= 3 THEN filled END + 1e-9, 4) AS filled FROM lin", V.GRID_SQL, FILL_SQL)
def gapfill(spark, sf):
    return dsp.fill_gaps(V.grid(spark, sf), "vid", 3, "m_view").select("vid", "frame", r4(F.col("filled") + 1e-9).alias("filled"))


MULTI_SQL = "m AS (" + " UNION ALL ".join(f"SELECT vid, frame, {s} AS size, avg(filled) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN {s // 2} PRECEDING AND {s - 1 - s // 2} FOLLOWING) AS a, avg(n) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN {s // 2} PRECEDING AND {s - 1 - s // 2} FOLLOWING) AS b FROM mir{s}" for s in (2, 6, 24)) + ")"
MIRS_SQL = ", ".join(f"mir{s} AS (SELECT vid, frame, filled, n FROM lin UNION ALL SELECT vid, -1 - frame, filled, n FROM lin WHERE frame < {s} UNION ALL SELECT vid, 1439 - frame, filled, n FROM lin WHERE frame >= {720 - s})" for s in (2, 6, 24))


@query("q_multiscale", f"SELECT size, {R_SQL} AS r, count(*) AS n FROM (SELECT size, m.a, m.b FROM m JOIN grid g ON g.vid = m.vid AND g.frame = m.frame WHERE NOT g.cut AND g.m_view IS NOT NULL) GROUP BY size", V.GRID_SQL, FILL_SQL, MIRS_SQL, MULTI_SQL)
def multiscale(spark, sf):
    sizes = (2, 6, 24)  # fill, filter, mask again
    both = dsp.mirrored(dsp.filled_linear(V.grid(spark, sf), "vid", "m_view").select("vid", "frame", "cut", "m_view", "filled", "n"), "vid", V.FRAMES, max(sizes))
    at = [dsp.by_frame("vid").rowsBetween(-(size // 2), size - 1 - size // 2) for size in sizes]
    scales = both.select("frame", "cut", "m_view", F.array(*[F.struct(F.lit(size).alias("size"), F.avg("filled").over(w).alias("a"), F.avg("n").over(w).alias("b")) for size, w in zip(sizes, at, strict=True)]).alias("s"))
    ok = dsp.inside(scales, V.FRAMES).where(~F.col("cut") & F.col("m_view").isNotNull()).select(F.inline("s"))
    return ok.groupBy("size").agg(r4(stats.pearson("a", "b")).alias("r"), F.count("*").alias("n"))


@query("q_envelope_z", "SELECT vid, frame, CASE WHEN v IS NOT NULL THEN round((s - avg(s) OVER (PARTITION BY vid)) / stddev_pop(s) OVER (PARTITION BY vid), 4) + 0.0 END AS z FROM (SELECT vid, frame, v, avg(filled) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS s FROM (SELECT vid, frame, v, filled FROM lin UNION ALL SELECT vid, -1 - frame, v, filled FROM lin WHERE frame < 6 UNION ALL SELECT vid, 1439 - frame, v, filled FROM lin WHERE frame >= 714)) WHERE frame BETWEEN 0 AND 719", V.GRID_SQL, FILL_SQL)
def envelope(spark, sf):
    s = dsp.uniform(dsp.filled_linear(V.grid(spark, sf), "vid", "m_view").select("vid", "frame", "m_view", "filled"), "vid", V.FRAMES, 6, "filled")
    w = Window.partitionBy("vid")
    z = F.try_divide(F.col("smooth") - F.avg("smooth").over(w), F.stddev_pop("smooth").over(w))
    return s.withColumn("z", z).select("vid", "frame", F.when(F.col("m_view").isNotNull(), r4(F.col("z"))).alias("z"))


@query("q_best_window", "SELECT vid, frame, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY round(total, 6) DESC, frame) AS k FROM (SELECT vid, frame, sum(coalesce(m_view, 0)) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING) AS total FROM grid) WHERE frame + 48 < 720) WHERE k = 1", V.GRID_SQL)
def best(spark, sf):
    return dsp.best_window(V.grid(spark, sf), "vid", 48, V.FRAMES, "m_view").select("vid", "frame", r4(F.col("total")).alias("total"))


@query("q_rolling_same", "SELECT vid, frame, round(sum(n) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30, 4) AS smooth FROM grid", V.GRID_SQL)
def rolling(spark, sf):
    return dsp.rolling_same(V.grid(spark, sf), "vid", 30, "n").select("vid", "frame", r4(F.col("smooth")).alias("smooth"))


KERNEL_SQL = "kern AS (SELECT k, exp(-0.5 * k * k / 9.0) / (SELECT sum(exp(-0.5 * j * j / 9.0)) FROM range(-12, 13) q(j)) AS w FROM range(-12, 13) r(k))"


@query("q_gaussian", "SELECT m.vid, m.frame, round(sum(o.n * kern.w), 4) AS smooth FROM grid m, kern, mir o WHERE o.vid = m.vid AND o.frame = m.frame + k GROUP BY m.vid, m.frame", V.GRID_SQL, mirror_sql(12), KERNEL_SQL)
def gaussian(spark, sf):
    return dsp.gaussian(V.grid(spark, sf).select("vid", "frame", "n"), "vid", V.FRAMES, 3.0, "n").select("vid", "frame", r4(F.col("smooth")).alias("smooth"))


@query("q_norm_conv", "SELECT m.vid, m.frame, CASE WHEN max(m.m_view) IS NOT NULL THEN round(sum(coalesce(o.v, 0) * kern.w) / sum((o.v IS NOT NULL)::INT * kern.w), 4) END AS smooth FROM grid m, kern, (SELECT vid, frame, m_view AS v FROM grid UNION ALL SELECT vid, -1 - frame, m_view FROM grid WHERE frame < 12 UNION ALL SELECT vid, 1439 - frame, m_view FROM grid WHERE frame >= 708) o WHERE o.vid = m.vid AND o.frame = m.frame + k GROUP BY m.vid, m.frame", V.GRID_SQL, KERNEL_SQL)
def norm_conv(spark, sf):
    return dsp.normalised_gaussian(V.grid(spark, sf).select("vid", "frame", "m_view"), "vid", V.FRAMES, 3.0, "m_view").select("vid", "frame", r4(F.col("smooth")).alias("smooth"))


ISLAND_SQL = "isl AS (SELECT *, sum(c) OVER (PARTITION BY vid ORDER BY frame) AS island FROM (SELECT vid, frame, m_view AS v, CASE WHEN (m_view IS NULL) = (lag(m_view) OVER (PARTITION BY vid ORDER BY frame) IS NULL) AND frame > 0 THEN 0 ELSE 1 END AS c FROM grid))"


@query("q_medfilt", "SELECT vid, frame, round(CASE WHEN v IS NULL OR nn < 5 THEN v ELSE list_sort(list_concat(h, list_resize([0.0::DOUBLE], (5 - len(h))::BIGINT, 0.0::DOUBLE)))[3] END, 4) AS smooth FROM (SELECT vid, frame, v, list(v) OVER (PARTITION BY vid, island ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h, count(*) OVER (PARTITION BY vid, island) AS nn FROM isl)", V.GRID_SQL, ISLAND_SQL)
def medfilt(spark, sf):
    return dsp.median(V.grid(spark, sf).select("vid", "frame", "m_view"), "vid", 5, "m_view").select("vid", "frame", r4(F.col("smooth")).alias("smooth"))


@query("q_runs", "SELECT vid, min(frame) AS first, max(frame) AS last, count(*) AS n FROM isl WHERE v IS NULL GROUP BY vid, island", V.GRID_SQL, ISLAND_SQL)
def mask_runs(spark, sf):
    return dsp.runs(V.grid(spark, sf).select("vid", "frame", "m_view"), "vid", F.col("m_view").isNull())


@query("q_pitch_delta", "SELECT vid, frame, round(coalesce(abs(m_view - lag(m_view) OVER (PARTITION BY vid ORDER BY frame)), 0), 4) AS delta FROM grid", V.GRID_SQL)
def pitch(spark, sf):
    return dsp.abs_difference(V.grid(spark, sf), "vid", "m_view").select("vid", "frame", r4(F.col("delta")).alias("delta"))


@query("q_velocity", "SELECT shot, joint, frame, CASE WHEN NOT (m OR lead(m) OVER w) THEN round(sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) * 30, 4) END AS speed FROM (SELECT *, frame % 50 = 25 AS m FROM kp) WINDOW w AS (PARTITION BY shot, joint ORDER BY frame) QUALIFY lead(frame) OVER w IS NOT NULL", V.KP_SQL)
def velocity(spark, sf):
    t = dsp.velocity(V.keypoints(spark, sf), ["shot", "joint"], 30.0, masked=F.col("frame") % 50 == 25)
    return t.select("shot", "joint", "frame", r4(F.col("speed")).alias("speed"))


GROUPS = {"head": list(range(0, 8)), "torso": list(range(8, 16)), "hand": list(range(24, 40)), "total": None}


@query("q_motion_regions", """SELECT frame, round(avg(v) FILTER (joint < 8), 4) AS head, round(avg(v) FILTER (joint BETWEEN 8 AND 15), 4) AS torso, round(avg(v) FILTER (joint >= 24), 4) AS hand, round(avg(v), 4) AS total
FROM (SELECT k.frame, joint, CASE WHEN conf >= 0.3 AND rx IS NOT NULL AND scale >= 0.05 THEN sqrt(((x - rx) / scale) * ((x - rx) / scale) + ((y - ry) / scale) * ((y - ry) / scale)) END AS v
FROM kp k LEFT JOIN (SELECT frame, CASE WHEN count(*) FILTER (joint IN (11, 12) AND conf >= 0.3) = 2 THEN avg(x) FILTER (joint IN (11, 12)) END AS rx, CASE WHEN count(*) FILTER (joint IN (11, 12) AND conf >= 0.3) = 2 THEN avg(y) FILTER (joint IN (11, 12)) END AS ry,
  sqrt(pow(max(x) FILTER (joint = 1) - max(x) FILTER (joint = 2), 2) + pow(max(y) FILTER (joint = 1) - max(y) FILTER (joint = 2), 2)) AS scale FROM kp GROUP BY frame) c USING (frame)) GROUP BY frame""", V.KP_SQL)
def regions(spark, sf):
    raw = V.keypoints(spark, sf)
    kp = motion.masked(raw)
    root = motion.midpoint(kp, ["frame"], (11, 12), "root")
    ends = raw.where("joint IN (1, 2)").groupBy("frame").agg(*[F.max(F.when(F.col("joint") == j, F.col(c))).alias(f"{c}{j}") for j in (1, 2) for c in ("x", "y")])
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    placed = motion.normalised(kp, root, ends.select("frame", F.sqrt(dx * dx + dy * dy).alias("scale")), ["frame"], 0.05)
    moved = placed.withColumn("v", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    t = motion.group_means(moved, ["frame"], GROUPS, 32, "v")
    return t.select("frame", *[r4(F.col(g)).alias(g) for g in GROUPS])


@query("q_root_auto", "SELECT round(avg((rx IS NULL)::INT), 4) AS missing, CASE WHEN avg((rx IS NULL)::INT) > 0.5 THEN 'shoulder' ELSE 'hip' END AS mode FROM (SELECT frame, CASE WHEN count(*) FILTER (conf >= 0.3) = 2 THEN avg(x) END AS rx FROM kp WHERE joint IN (23, 24) GROUP BY frame)", V.KP_SQL)
def root_auto(spark, sf):
    return motion.root_mode(motion.masked(V.keypoints(spark, sf)), ["frame"], (23, 24)).select(r4(F.col("missing")).alias("missing"), "mode")


@query("q_pose_quality", "SELECT frame, round(avg((conf >= 0.3)::INT), 4) AS valid, round(avg(conf), 4) AS confidence FROM kp GROUP BY frame", V.KP_SQL)
def pose_quality(spark, sf):
    return motion.quality(V.keypoints(spark, sf), ["frame"]).select("frame", r4(F.col("valid")).alias("valid"), r4(F.col("confidence")).alias("confidence"))


@query("q_eta_onset", "SELECT CAST(lag AS INT) AS lag, round(avg(g.n), 4) AS mean, round(stddev_pop(g.n) / sqrt(greatest(count(g.n), 1)), 4) AS sem, count(g.n) AS n FROM (SELECT vid, frame FROM grid WHERE n >= 3) e, range(-12, 12) r(lag), grid g WHERE g.vid = e.vid AND g.frame = e.frame + lag GROUP BY lag", V.GRID_SQL)
def eta(spark, sf):
    g = V.grid(spark, sf)
    t = stats.event_triggered(g.where("n >= 3"), g, "vid", 12, 12, "n")
    return t.select("lag", r4(F.col("mean")).alias("mean"), r4(F.col("sem")).alias("sem"), "n")


BINS_SQL = "edges AS (SELECT quantile_cont(m_view, 0.01) AS la, quantile_cont(m_view, 0.99) AS ha, quantile_cont(m_click, 0.01) AS lb, quantile_cont(m_click, 0.99) AS hb FROM grid WHERE m_view IS NOT NULL AND m_click IS NOT NULL), bins AS (SELECT CAST(least(greatest(floor((m_view - la) / (ha - la) * 20), 0), 19) AS INT) AS ba, CAST(least(greatest(floor((m_click - lb) / (hb - lb) * 20), 0), 19) AS INT) AS bb FROM grid, edges WHERE m_view IS NOT NULL AND m_click IS NOT NULL)"


def binned(spark, sf):
    ok = V.grid(spark, sf).where(stats.valid_pair("m_view", "m_click"))
    return stats.quantile_bins(stats.quantile_bins(ok, "m_view", 20, "ba"), "m_click", 20, "bb")


@query("q_hist", "SELECT ba, bb, count(*) AS n FROM bins GROUP BY ba, bb", V.GRID_SQL, BINS_SQL)
def hist(spark, sf):
    return binned(spark, sf).groupBy("ba", "bb").agg(F.count("*").alias("n"))


@query("q_mi", "SELECT round(sum(c / t * ln(c * t / (ca * cb))), 4) AS mi, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, sum(c) OVER (PARTITION BY ba) AS ca, sum(c) OVER (PARTITION BY bb) AS cb, sum(c) OVER () AS t FROM (SELECT ba, bb, count(*)::DOUBLE AS c FROM bins GROUP BY ba, bb))", V.GRID_SQL, BINS_SQL)
def mi(spark, sf):
    return stats.mutual_information(binned(spark, sf), "ba", "bb").select(r4(F.col("mi")).alias("mi"), "n")


@query("q_mi_surrogate")
def mi_surrogate(spark, sf):
    b = binned(spark, sf).select("vid", "frame", "ba", "bb")
    real, surr = stats.mutual_information(b, "ba", "bb"), stats.surrogate_information(b, "ba", "bb")
    s = surr.crossJoin(F.broadcast(real.withColumnRenamed("mi", "real"))).groupBy("real").agg(F.avg("mi").alias("mean"), F.stddev_pop("mi").alias("sd"), F.avg((F.col("mi") >= F.col("real")).cast("int")).alias("p_value"))  # real: one row
    return s.withColumn("z", (F.col("real") - F.col("mean")) / (F.col("sd") + 1e-10))


@query("q_mwu", """SELECT round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 4) AS z, n1, n2
FROM (SELECT sum(rk * t1) AS r1, sum(t1)::DOUBLE AS n1, sum(t - t1)::DOUBLE AS n2, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT value, t, t1, coalesce(sum(t) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rk
FROM (SELECT value, count(*)::DOUBLE AS t, count(*) FILTER (event_type = 'click')::DOUBLE AS t1 FROM events WHERE event_type IN ('click', 'view') GROUP BY value)))""")
def mwu(spark, sf):
    t = stats.mann_whitney(V.read(spark, sf, "events"), "event_type", "value", "click", "view")
    return t.select(r4(F.col("u")).alias("u"), r4(F.col("z")).alias("z"), "n1", "n2")


@query("q_find_peaks")
def peaks(spark, sf):
    smooth = dsp.uniform(V.grid(spark, sf).select("vid", "frame", "n"), "vid", V.FRAMES, 5, "n")
    height = smooth.agg(F.percentile("smooth", F.lit(0.85)).alias("height"))
    return stats.local_maxima(smooth.crossJoin(F.broadcast(height)), "vid", F.col("height"), 6, "smooth")  # height: one row


@query("q_cut_mask", "SELECT vid, frame FROM grid WHERE cut", V.GRID_SQL)
def cut_mask(spark, sf):
    return V.grid(spark, sf).where("cut").select("vid", "frame")


@query("q_resample", """SELECT vid, frame, round(CASE WHEN m.i <= 0.5 THEN f.i END + 1e-9, 4) AS value FROM (SELECT vid, g.t AS frame, CASE WHEN b.frame IS NULL THEN a.v ELSE b.v + (coalesce(a.v, b.v) - b.v) * (CASE WHEN a.frame IS NULL OR a.frame = b.frame THEN 0 ELSE (g.t - b.frame) / (a.frame - b.frame) END) END AS i
FROM (SELECT DISTINCT vid FROM lin) k CROSS JOIN (SELECT x * 0.75 AS t FROM range(960) r(x)) g LEFT JOIN (SELECT vid, frame, coalesce(v1, v0) AS v FROM near) b USING (vid) LEFT JOIN (SELECT vid, frame, coalesce(v1, v0) AS v FROM near) a USING (vid)
WHERE b.frame = floor(g.t) AND a.frame = least(ceil(g.t), 719)) f JOIN (SELECT vid, g.t AS frame, b.v + (a.v - b.v) * (CASE WHEN a.frame = b.frame THEN 0 ELSE (g.t - b.frame) / (a.frame - b.frame) END) AS i
FROM (SELECT x * 0.75 AS t FROM range(960) r(x)) g, (SELECT vid, frame, (v IS NULL)::INT::DOUBLE AS v FROM near) b JOIN (SELECT vid, frame, (v IS NULL)::INT::DOUBLE AS v FROM near) a USING (vid) WHERE b.frame = floor(g.t) AND a.frame = least(ceil(g.t), 719)) m USING (vid, frame)""", V.GRID_SQL, FILL_SQL)
def resample(spark, sf):
    g = V.grid(spark, sf).select("vid", F.col("frame").cast("double").alias("frame"), "m_view")
    target = g.select("vid").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(959)))).withColumn("frame", F.col("frame") * 0.75)
    return grid.resample(g, target, "vid", "frame", "m_view").select("vid", "frame", r4(F.col("m_view") + 1e-9).alias("value"))
