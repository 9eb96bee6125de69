"""Queries on character annotations: rasters, sessions, merges, tone annotation, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import views as V
from tessella.functions.scalars import rounded as r4
from tessella.functions.scalars import timestamp, to_frame
from tessella.operators import dsp, grid, sequences, tiers, tone

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = ("WITH " + "RECURSIVE " * recursive + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


HITS_SQL = """spans AS (SELECT vid, pos, value, greatest(CAST(round_even(start, 0) AS INT), 0) AS i0, least(CAST(round_even("end", 0) AS INT), 720) - 1 AS i1, start FROM chars),
hits AS (SELECT vid, CAST(f AS INT) AS frame, start, pos, value FROM spans, range(720) r(f) WHERE f BETWEEN i0 AND i1)"""


@query("q_raster_onset", 'SELECT vid, CAST(round_even(start, 0) AS INT) AS frame, count(*) AS n FROM chars WHERE round_even(start, 0) BETWEEN 0 AND 719 GROUP BY vid, frame', V.CHARS_SQL)
def raster_onset(spark, sf):
    return grid.raster_points(V.chars(spark, sf).withColumn("time", F.col("start")), "vid", 1.0, V.FRAMES)


@query("q_raster_duration", "SELECT vid, frame, round(arg_max(value, (start, pos)), 4) AS value FROM hits GROUP BY vid, frame", V.CHARS_SQL, HITS_SQL)
def raster_duration(spark, sf):
    return grid.raster_intervals(V.chars(spark, sf), "vid", 1.0, F.col("value"), ["start", "pos"], V.FRAMES).select("vid", "frame", r4(F.col("value")).alias("value"))


@query("q_silence", "SELECT vid, 720 - count(DISTINCT frame) AS silent FROM hits GROUP BY vid", V.CHARS_SQL, HITS_SQL)
def silence(spark, sf):
    c = V.chars(spark, sf)
    on = grid.raster_intervals(c, "vid", 1.0, F.lit(1), ["start", "pos"], V.FRAMES)
    return grid.fit_length(on, "vid", V.FRAMES).groupBy("vid").agg(F.count_if(F.col("value").isNull()).alias("silent"))


IOI_SQL = """onset AS (SELECT vid, CAST(round_even(start, 0) AS INT) AS frame, arg_max(start - prev, (start, pos)) AS ioi FROM (SELECT *, lag(start) OVER (PARTITION BY vid ORDER BY start, pos) AS prev FROM chars) WHERE round_even(start, 0) BETWEEN 0 AND 719 AND prev IS NOT NULL GROUP BY vid, frame),
full_grid AS (SELECT vid, CAST(f AS INT) AS frame, ioi FROM (SELECT DISTINCT vid FROM chars) CROSS JOIN range(720) r(f) LEFT JOIN onset ON onset.vid = chars.vid AND onset.frame = f),
near AS (SELECT vid, frame, last_value(CASE WHEN ioi IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, last_value(ioi IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN ioi IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1, first_value(ioi IGNORE NULLS) OVER a AS v1 FROM full_grid
WINDOW b AS (PARTITION BY vid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("q_ioi", "SELECT vid, frame, round(CASE WHEN f0 = f1 THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END + 1e-9, 4) AS ioi FROM near WHERE f0 IS NOT NULL AND f1 IS NOT NULL", V.CHARS_SQL, IOI_SQL.replace("onset.vid = chars.vid AND onset.frame = f", "o.v2 = k.vid AND o.frame = f").replace("(SELECT DISTINCT vid FROM chars) CROSS JOIN", "(SELECT DISTINCT vid FROM chars) k CROSS JOIN").replace("LEFT JOIN onset ON", "LEFT JOIN (SELECT vid AS v2, frame, ioi FROM onset) o ON").replace("SELECT vid, CAST(f AS INT) AS frame, ioi FROM", "SELECT k.vid, CAST(f AS INT) AS frame, ioi FROM"))
def ioi(spark, sf):
    c = V.chars(spark, sf)
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("vid").orderBy("start", "pos"))
    at = c.withColumn("g", gap).withColumn("frame", to_frame(F.col("start"), 1.0)).where(F.col("g").isNotNull() & F.col("frame").between(0, V.FRAMES - 1))
    onset = at.groupBy("vid", "frame").agg(F.max_by("g", F.struct("start", "pos")).alias("ioi"))
    full = grid.neighbours(grid.dense(c, "vid", V.FRAMES).join(onset, ["vid", "frame"], "left"), "vid", "frame", "ioi")
    return full.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select("vid", "frame", r4(grid.interpolated("frame") + 1e-9).alias("ioi"))


@query("q_sessionize", 'SELECT vid, pos, sum(CASE WHEN start - prev > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY start, pos)::BIGINT AS session FROM (SELECT *, lag("end") OVER (PARTITION BY vid ORDER BY start, pos) AS prev FROM chars)', V.CHARS_SQL)
def sessionize(spark, sf):
    return sequences.gap_sessions(V.chars(spark, sf), "vid", 0.2, ("start", "pos")).select("vid", "pos", "session")


@query("q_breath_dedup", "SELECT vid, round(t, 6) AS start FROM kept", V.CHARS_SQL, "o AS (SELECT vid, start AS t, row_number() OVER (PARTITION BY vid ORDER BY start, pos) AS k FROM chars WHERE char = 'view')", "kept AS (SELECT vid, t, k FROM o WHERE k = 1 UNION ALL SELECT vid, t, k FROM (SELECT o.vid, o.t, o.k, row_number() OVER (PARTITION BY o.vid, x.k ORDER BY o.k) AS j FROM kept x JOIN o ON o.vid = x.vid AND o.k > x.k AND o.t - x.t > 2.0) WHERE j = 1)", recursive=True)
def breath_dedup(spark, sf):
    return sequences.tolerance_dedup(V.chars(spark, sf).where("char = 'view'"), "vid", "start", 2.0).select("vid", F.round("start", 6).alias("start"))


@query("q_action_dedup", "SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY round_even(start, 0), round_even(value / 60, 1), char ORDER BY pos) AS k FROM chars) WHERE k = 1", V.CHARS_SQL)
def action_dedup(spark, sf):
    return sequences.first_wins(V.chars(spark, sf), [F.rint("start"), F.bround(F.col("value") / 60, 1), F.col("char")], ["pos"]).select("pos")


@query("q_line_build", 'SELECT vid, lineId, string_agg(char, \'\' ORDER BY start, pos) AS text, round(min(start), 6) AS start, round(arg_max("end", (start, pos)), 6) AS "end" FROM chars GROUP BY vid, lineId', V.CHARS_SQL)
def line_build(spark, sf):
    return sequences.line_rows(V.chars(spark, sf), "vid").select("vid", "lineId", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("q_reid", "SELECT vid, pos, 'line-' || (dense_rank() OVER (PARTITION BY vid ORDER BY f, p) - 1) AS line, 'char-' || (row_number() OVER (PARTITION BY vid ORDER BY start, pos) - 1) AS id FROM (SELECT *, first_value(start) OVER w AS f, first_value(pos) OVER w AS p FROM chars WINDOW w AS (PARTITION BY vid, lineId ORDER BY start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", V.CHARS_SQL)
def reid(spark, sf):
    named = sequences.by_first_appearance(V.chars(spark, sf), "vid", "lineId", ["start", "pos"], "line-", "line")
    return sequences.renumber(named, "vid", ["start", "pos"], "char-", "id").select("vid", "pos", "line", "id")


@query("q_timing_faults", 'SELECT vid, count(*) FILTER ("end" <= start) AS inverted, count(*) FILTER ("end" > nxt + 0.05) AS overlapping FROM (SELECT *, lead(start) OVER (PARTITION BY vid ORDER BY start, pos) AS nxt FROM chars) GROUP BY vid', V.CHARS_SQL)
def timing(spark, sf):
    return sequences.timing_faults(V.chars(spark, sf), "vid")


@query("q_overlap_merge")
def overlap_merge(spark, sf):
    """Six overlapping parts of each video, merged again: the number of characters of the whole."""
    parts = V.chars(spark, sf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(5)))).where((F.col("start") >= F.col("part") * 120 - 2) & (F.col("start") < F.col("part") * 120 + 120))
    return sequences.merge_parts(parts, "vid", "part").groupBy("vid").agg(F.count("*").cast("int").alias("n"))


@query("q_srt", "SELECT conv_id, turn, round(CASE WHEN nxt IS NOT NULL AND long > nxt THEN greatest(s + 0.1, nxt - 0.01) ELSE long END, 6) AS new_end, printf('%02d:%02d:%02d,%03d', CAST(ms // 3600000 AS BIGINT), CAST(ms // 60000 % 60 AS BIGINT), CAST(ms // 1000 % 60 AS BIGINT), CAST(ms % 1000 AS BIGINT)) AS stamp FROM (SELECT *, greatest(e, s + 0.5) AS long, lead(s) OVER (PARTITION BY conv_id ORDER BY s, turn) AS nxt, CAST(round_even(s * 1000, 0) AS BIGINT) AS ms FROM (SELECT conv_id, turn, turn * 2.37::DOUBLE AS s, turn * 2.37::DOUBLE + length(text) / 100.0::DOUBLE AS e FROM conversations))")
def srt(spark, sf):
    cues = V.read(spark, sf, "conversations").select("conv_id", F.col("turn"), F.col("turn").alias("pos"), (F.col("turn") * 2.37).alias("start"), "text").withColumn("end", F.col("start") + F.length("text") / 100.0)
    return sequences.repair_cues(cues, "conv_id").select("conv_id", "turn", F.round("new_end", 6).alias("new_end"), timestamp(F.col("start")).alias("stamp"))


LOOKUP_SQL = "keys AS (SELECT DISTINCT regexp_extract(lower(text), '[^ .,\n]+') AS lookup, item_id FROM benchmark), turns AS (SELECT conv_id, turn, regexp_extract(lower(text), '[^ .,\n]+') AS lookup FROM conversations)"


def turns(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", "text", F.regexp_extract(F.lower("text"), "[^ .,\n]+", 0).alias("lookup"))


def lexicon(spark, sf):
    b = V.read(spark, sf, "benchmark")
    return b.select(F.regexp_extract(F.lower("text"), "[^ .,\n]+", 0).alias("character"), F.lit(None).cast("array<string>").alias("variants"), F.col("item_id").alias("pos"), F.col("item_id").alias("entry"))


@query("q_lookup_join", "SELECT conv_id, turn, lookup, count(item_id) > 0 AS available, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS entries FROM turns LEFT JOIN keys USING (lookup) GROUP BY conv_id, turn, lookup", LOOKUP_SQL)
def lookup_join(spark, sf):
    t = tone.with_references(turns(spark, sf), tone.lookup_index(lexicon(spark, sf)))
    return t.select("conv_id", "turn", "lookup", F.col("referenceAvailable").alias("available"), F.coalesce(F.array_join("references", ","), F.lit("")).alias("entries"))


@query("q_prev_next", "SELECT conv_id, turn, lag(lookup) OVER w AS prev, lead(lookup) OVER w AS next FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", LOOKUP_SQL)
def prev_next(spark, sf):
    return tone.with_context(turns(spark, sf), "conv_id", "lookup", "turn").select("conv_id", "turn", F.col("previousChar").alias("prev"), F.col("nextChar").alias("next"))


@query("q_batching", "SELECT conv_id, turn, b AS batch FROM walk", "o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS s FROM conversations)", "walk AS (SELECT conv_id, turn, k, 0 AS b, 1 AS n, s::BIGINT AS tot FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, w.b + (w.n >= 3 OR w.tot + o.s > 600)::INT, CASE WHEN w.n >= 3 OR w.tot + o.s > 600 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.tot + o.s > 600 THEN o.s ELSE w.tot + o.s END FROM walk w JOIN o ON o.conv_id = w.conv_id AND o.k = w.k + 1)", recursive=True)
def batching(spark, sf):
    t = turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("s")))).alias("t"))
    b = t.withColumn("b", sequences.batch_numbers(F.transform("t", lambda x: x["s"]), 3, 600))
    return b.select("conv_id", F.explode(F.arrays_zip("t", "b")).alias("z")).select("conv_id", "z.t.turn", F.col("z.b").alias("batch"))


#: Annotations made up from events: classes and subtypes by remainders.
CLASSES = [*tone.TONE_CLASSES, "none"]
TONES_SQL = "tones AS (SELECT event_id AS id, event_type AS char, (['yin_ping', 'yang_ping', 'yin_shang', 'yang_shang', 'yin_qu', 'yang_qu', 'yin_ru', 'yang_ru', 'none'])[1 + user_id % 9] AS tc, (['yin_shang', 'yang_shang', 'yinyang_tongyong', NULL])[1 + event_id % 4] AS st, value / 300 AS conf FROM events)"


def tones(spark, sf):
    e = V.read(spark, sf, "events")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int") + 1)
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("char"), pick(CLASSES, F.col("user_id") % 9).alias("toneClass"), pick([*tone.SHANG_SUBTYPES, None], F.col("event_id") % 4).alias("subtype"), (F.col("value") / 300).alias("confidence"))


@query("q_validate", """SELECT id, concat_ws(',', CASE WHEN tc = 'none' THEN 'tone_class' END, CASE WHEN tc IN ('yin_shang', 'yang_shang') AND st IS NULL THEN 'subtype_missing' END,
CASE WHEN tc IN ('yin_shang', 'yang_shang') AND ((st = 'yin_shang' AND tc <> 'yin_shang') OR (tc = 'yin_shang' AND st <> 'yin_shang')) THEN 'subtype_mismatch' END, CASE WHEN tc NOT IN ('yin_shang', 'yang_shang') AND st IS NOT NULL THEN 'subtype_unexpected' END, CASE WHEN NOT conf BETWEEN 0 AND 1 THEN 'confidence' END) AS faults FROM tones""", TONES_SQL)
def validate(spark, sf):
    return tones(spark, sf).select("id", F.array_join(tone.annotation_faults(F.col("toneClass"), F.col("subtype"), F.col("confidence")), ",").alias("faults"))


@query("q_conf_policy", "SELECT id, round(CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN least(conf, 0.79) ELSE conf END, 6) AS confidence, CASE WHEN id % 3 = 0 THEN 'context_inference' WHEN id % 5 = 0 THEN 'context_inference' ELSE 'lexicon' END AS source, id % 3 = 0 OR (CASE WHEN id % 5 = 0 THEN least(conf, 0.79) ELSE conf END) < 0.8 AS review FROM tones", TONES_SQL)
def policy(spark, sf):
    t = tones(spark, sf).withColumn("referenceAvailable", F.col("id") % 3 != 0).withColumn("source", F.when(F.col("id") % 5 == 0, "context_inference").otherwise("lexicon")).withColumn("needsReview", F.lit(False))
    return tone.confidence_policy(t).select("id", F.round("confidence", 6).alias("confidence"), "source", F.col("needsReview").alias("review"))


@query("q_conflicts", "SELECT char, count(*) AS occurrences, count(DISTINCT tc || '/' || coalesce(st, '')) AS options FROM tones GROUP BY char HAVING count(DISTINCT tc || '/' || coalesce(st, '')) > 1", TONES_SQL)
def conflicts(spark, sf):
    return tone.glyph_conflicts(tones(spark, sf)).select("char", "occurrences", F.size("options").cast("bigint").alias("options"))


@query("q_reconcile", "SELECT batch, count(*) FILTER (want IS NULL) AS unknown, count(*) FILTER (times > 1) AS duplicate, count(*) FILTER (times IS NULL) AS missing FROM (SELECT user_id % 20 AS batch, event_id AS id, 1 AS want FROM events WHERE event_id % 7 <> 0) e FULL JOIN (SELECT user_id % 20 AS batch, event_id - event_id % 2 AS id, count(*) AS times FROM events WHERE event_id % 5 <> 0 GROUP BY ALL) r USING (batch, id) GROUP BY batch")
def reconcile(spark, sf):
    e = V.read(spark, sf, "events").select((F.col("user_id") % 20).alias("batch"), F.col("event_id").alias("id"))
    returned = e.where("id % 5 <> 0").withColumn("id", F.col("id") - F.col("id") % 2)
    return tone.reconcile(e.where("id % 7 <> 0"), returned, "batch")


@query("q_write_back", "SELECT id, CASE WHEN conf < 0.2 THEN NULL ELSE tc END AS tone, CASE WHEN conf >= 0.2 AND tc IN ('yin_shang', 'yang_shang') THEN st END AS subtype FROM tones", TONES_SQL)
def write_back(spark, sf):
    t = tones(spark, sf).withColumn("needsReview", F.col("confidence") < 0.2)
    return tone.write_back(t.select("id"), t, omit_low=True).select("id", F.col("tone.toneClass").alias("tone"), F.col("tone.subtype").alias("subtype"))


@query("q_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, sf):
    return V.read(spark, sf, "events").withColumn("p", F.from_json("props", "k BIGINT")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("q_style_table", "SELECT char AS style, count(*) AS n, round(avg(value) + 1e-9, 4) AS duration, round(avg(m) + 1e-9, 4) AS motion FROM (SELECT c.char, c.pos, c.value, avg(g.m_view) AS m FROM spans s JOIN chars c USING (pos) LEFT JOIN grid g ON g.vid = c.vid AND g.frame BETWEEN s.i0 AND s.i1 GROUP BY c.char, c.pos, c.value) GROUP BY char", V.CHARS_SQL, HITS_SQL, V.GRID_SQL)
def style_table(spark, sf):
    c = V.chars(spark, sf)
    first, last = F.greatest(to_frame(F.col("start"), 1.0), F.lit(0)), F.least(to_frame(F.col("end"), 1.0), F.lit(V.FRAMES)) - 1
    frames = c.where(first <= last).select("vid", "pos", F.explode(F.sequence(first, last)).alias("frame"))
    means = frames.join(V.grid(spark, sf).select("vid", "frame", "m_view"), ["vid", "frame"], "left").groupBy("pos").agg(F.avg("m_view").alias("m"))
    return c.join(means, "pos", "left").groupBy(F.col("char").alias("style")).agg(F.count("*").alias("n"), r4(F.avg("value") + 1e-9).alias("duration"), r4(F.avg("m") + 1e-9).alias("motion"))


@query("q_vocab", "SELECT phone, CAST(row_number() OVER (ORDER BY phone) AS INT) AS id FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS phone FROM benchmark) WHERE phone NOT IN ('SP', 'the', '') UNION ALL SELECT 'SP', 0")
def vocab(spark, sf):
    b = V.read(spark, sf, "benchmark").withColumn("ph", F.split(F.lower("text"), " "))
    return tiers.vocabulary(b, "ph", ["the", ""])


@query("q_runs_text", "SELECT vid, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT vid, frame, frame - row_number() OVER (PARTITION BY vid ORDER BY frame) AS k FROM (SELECT DISTINCT vid, frame FROM hits)) GROUP BY vid, k", V.CHARS_SQL, HITS_SQL)
def runs_text(spark, sf):
    on = grid.raster_intervals(V.chars(spark, sf), "vid", 1.0, F.lit(1), ["start", "pos"], V.FRAMES)
    return dsp.runs(grid.fit_length(on, "vid", V.FRAMES), "vid", F.col("value").isNotNull())
