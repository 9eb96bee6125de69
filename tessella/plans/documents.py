"""Queries on annotation documents and dataset tables, over orders, line items, parts and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import views as V
from tessella.functions.scalars import rounded as r4
from tessella.operators import documents as D
from tessella.operators import tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def chars(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as characters: the customer is the line; some have no character, start or line, some a tone."""
    o = V.read(spark, sf, "orders")
    return o.select(
        F.format_string("c%08d", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey").cast("string")).alias("lineId"), F.when(F.col("o_orderkey") % 89 != 0, F.substring("o_orderpriority", 3, 1)).alias("char"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("start"), F.when(F.col("o_orderstatus") == "P", F.lit("yin_ping")).alias("tone"), F.col("o_orderkey").alias("pos"))


C_SQL = """c AS (SELECT printf('c%08d', o_orderkey) AS id, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey::VARCHAR END AS lineId, CASE WHEN o_orderkey % 89 <> 0 THEN substr(o_orderpriority, 3, 1) END AS char,
CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS start, CASE WHEN o_orderstatus = 'P' THEN 'yin_ping' END AS tone, o_orderkey AS pos FROM orders)"""


@query("q_required_fields", f"WITH {C_SQL} SELECT coalesce(CASE WHEN id IS NULL THEN 'id' END, CASE WHEN lineId IS NULL THEN 'lineId' END, CASE WHEN char IS NULL THEN 'char' END, 'none') AS fault, count(*) AS n FROM c WHERE tone IS NULL GROUP BY 1")
def required_fields(spark, sf):
    return D.required(D.open_items(chars(spark, sf)), "id", "lineId", "char").groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


@query("q_line_payloads", f"WITH {C_SQL}, g AS (SELECT lineId, list(id ORDER BY coalesce(start, 0), id) AS ids, min(pos) AS seen FROM c WHERE tone IS NULL AND lineId IS NOT NULL AND char IS NOT NULL GROUP BY lineId) "
       "SELECT lineId, array_to_string(ids, ' ') AS ids, lineId::BIGINT % 3 = 0 AS orphan, CASE WHEN lineId::BIGINT % 3 = 0 THEN seen ELSE -lineId::BIGINT END AS place FROM g")  # fmt: skip
def line_payloads(spark, sf):
    good = D.required(D.open_items(chars(spark, sf)), "id", "lineId", "char").where("fault IS NULL")
    lines = V.read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("lineId"), (-F.col("c_custkey")).alias("pos"))
    return D.ordered_lines(lines, good).select("lineId", F.array_join("ids", " ").alias("ids"), F.col("place.col1").alias("orphan"), F.col("place.col2").alias("place"))


@query("q_batch_faults", """SELECT o_orderkey AS batch, CASE o_orderkey % 8 WHEN 0 THEN 'not_json,batch_id,annotations,missing_id' WHEN 1 THEN 'batch_id' WHEN 2 THEN 'annotations,missing_id' WHEN 3 THEN 'not_object' WHEN 4 THEN 'unknown_id'
WHEN 5 THEN 'repeated_id' WHEN 6 THEN 'char' ELSE '' END AS faults, CASE WHEN o_orderkey % 8 IN (0, 2) THEN 'a b' ELSE '' END AS missing FROM orders""")
def batch_faults(spark, sf):
    notes = '{"id": "a", "char": "x", "confidence": 0.5}, {"id": "b", "char": "y"}'
    kinds = ["no json", f'{{"batchId": "other", "annotations": [{notes}]}}', '{"batchId": "@"}', f'{{"batchId": "@", "annotations": [{notes}, null]}}', f'{{"batchId": "@", "annotations": [{notes}, {{"id": "z", "char": "x"}}]}}', f'{{"batchId": "@", "annotations": [{notes}, {{"id": "a", "char": "x"}}]}}', '{"batchId": "@", "annotations": [{"id": "a", "char": "q"}, {"id": "b", "char": "y"}]}', f'{{"batchId": "@", "annotations": [{notes}]}}']
    text = F.element_at(F.array(*[F.lit(f"```json\n{k}\n```") for k in kinds]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    items = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("char")) for i, c in (("a", "x"), ("b", "y"))])
    asked = V.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("batch"), items.alias("items"), F.replace(text, F.lit("@"), F.col("o_orderkey").cast("string")).alias("text"))
    return D.batch_faults(asked).select(F.col("batch").cast("bigint").alias("batch"), F.array_join("faults", ",").alias("faults"), F.array_join("missing", " ").alias("missing"))


@query("q_review_counts", "SELECT count(*) AS target, count(*) FILTER (o_orderstatus = 'P') AS written, count(*) FILTER (o_orderstatus <> 'P') AS omitted, count(*) FILTER (o_totalprice < 50000) AS review, count(DISTINCT o_custkey) AS batches FROM orders")
def review_counts(spark, sf):
    o = V.read(spark, sf, "orders")
    return D.review_counts(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"), F.when(F.col("o_orderstatus") == "P", F.lit("yin_ping")).alias("tone"), (F.col("o_totalprice") < 50000).alias("needsReview")))


@query("q_actions_from_start", "SELECT l_orderkey AS part, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS k, o_totalprice / 4 AS s FROM orders) ON k = l_orderkey WHERE l_extendedprice >= s GROUP BY l_orderkey")
def actions_from_start(spark, sf):
    starts = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("part"), (F.col("o_totalprice") / 4).alias("start"))
    actions = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_extendedprice").alias("end")).join(starts.select("part"), "part", "left_semi")
    return D.from_first_char(actions, starts, "part").groupBy("part").agg(F.count("*").alias("n"))


RUNS = "SELECT utt, idx, row_number() OVER (PARTITION BY utt ORDER BY idx) * 10 AS frame, CASE WHEN mark = 'N' THEN 'SP' ELSE mark END AS phone, pred % 3 AS word, (target - pred) AS slope FROM tiers"
PHONES_SQL = f"WITH {V.TIERS_SQL}, r AS ({RUNS}), p AS (SELECT *, frame + least(greatest(slope / 2, -0.5), 0.5) AS start FROM r), q AS (SELECT *, lead(start) OVER (PARTITION BY utt ORDER BY idx) AS \"end\" FROM p), ph AS (SELECT * FROM q WHERE phone <> 'SP' AND \"end\" IS NOT NULL)"


def phones(spark, sf):
    t = V.tiers(spark, sf)
    return D.phone_intervals(t.select("utt", "idx", (F.col("idx") * 10).alias("frame"), F.when(F.col("mark") == "N", F.lit("SP")).otherwise(F.col("mark")).alias("phone"), (F.col("pred") % 3).alias("word"), (F.col("target") - F.col("pred")).alias("slope")), "utt")


@query("q_phone_intervals", PHONES_SQL + ' SELECT utt, idx, phone, round(start, 4) + 0.0 AS start, round("end", 4) + 0.0 AS "end" FROM ph')
def phone_intervals(spark, sf):
    return phones(spark, sf).select("utt", "idx", "phone", r4(F.col("start")).alias("start"), r4(F.col("end")).alias("end"))


@query("q_word_intervals", PHONES_SQL + ', m AS (SELECT *, CASE WHEN lag(word) OVER (PARTITION BY utt ORDER BY idx) = word THEN 0 ELSE 1 END AS n FROM ph), s AS (SELECT *, sum(n) OVER (PARTITION BY utt ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m) SELECT utt, run, any_value(word) AS word, round(min(start), 4) + 0.0 AS start, round(max("end"), 4) + 0.0 AS "end" FROM s GROUP BY utt, run')
def word_intervals(spark, sf):
    return D.word_intervals(phones(spark, sf), "utt").select("utt", "run", "word", r4(F.col("start")).alias("start"), r4(F.col("end")).alias("end"))


@query("q_soft_edges", f"WITH {V.TIERS_SQL}, e AS (SELECT utt, floor(target)::INT AS f, target - floor(target) AS p FROM tiers), s AS (SELECT utt, f AS frame, 1 - p AS s FROM e UNION ALL SELECT utt, f + 1, p FROM e) SELECT utt, frame, round(max(s) * 0.8 + 0.1, 4) + 0.0 AS target FROM s GROUP BY utt, frame")
def soft_edges(spark, sf):
    return D.soft_edges(V.tiers(spark, sf), "utt", "target").select("utt", "frame", r4(F.col("target")).alias("target"))


@query("q_dense_path", "WITH s AS (SELECT o_custkey AS k, (o_orderkey % 20)::INT AS frame, count(*) AS step FROM orders GROUP BY 1, 2) SELECT k, frame::INT AS frame, sum(coalesce(step, 0)) OVER (PARTITION BY k ORDER BY frame)::BIGINT AS state FROM (SELECT g.k, g.frame, s.step FROM (SELECT k, f::INT AS frame FROM (SELECT DISTINCT k FROM s), range(20) r(f)) g LEFT JOIN s ON s.k = g.k AND s.frame = g.frame)")
def dense_path(spark, sf):
    return D.dense_path(V.read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 20).cast("int").alias("frame"), F.lit(1).alias("step")), "k", 20)


@query("q_prompt_sequence", "SELECT o_orderkey AS id, 'SP ' || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'a SP ' ELSE 'b SP ' END || 'a SP' AS seq FROM orders")
def prompt_sequence(spark, sf):
    names = F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit("b"))
    return V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(D.prompt_sequence(F.array((F.col("o_orderkey") % 3).cast("int"), F.lit(0), F.lit(1)), names), " ").alias("seq"))


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as clips: a path, phones and durations, seconds."""
    kind = F.element_at(F.array(*map(F.lit, ("no_label", "weak_label", "full_label", "extra"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.lit("data"), kind, "p_brand", "p_name").alias("path"), F.split(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_name")), " ").alias("raw"), F.col("p_size").alias("seconds"))


P_SQL = """p AS (SELECT p_partkey AS id, p_brand, p_name, p_size, CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS k FROM part),
d AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN 0 WHEN k = 2 AND p_size % 2 = 1 THEN 1 ELSE k END AS kind FROM p WHERE p_size <= 45)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    t = dataset(spark, sf).where("seconds <= 45").withColumn("phones", F.filter("raw", lambda x: x != ""))
    durations = F.when(F.col("seconds") % 2 == 1, F.array(F.lit(0.5))).otherwise(F.transform("phones", lambda x: F.lit(0.5)))
    return t.withColumn("kind", D.downgraded(D.label_type(F.col("path")), F.col("phones"), durations))


@query("q_label_rules", f"WITH {P_SQL} SELECT kind, count(*) AS n, sum(p_size)::BIGINT AS seconds, round(count(*) / (SELECT count(*) FROM d), 4) AS share, count(*) FILTER (p_brand IN ('Brand#13', 'Brand#5')) AS preferred, max(p_name) AS last FROM d GROUP BY kind")
def label_rules(spark, sf):
    t = labelled(spark, sf)
    total = t.agg(F.count("*").alias("all"))
    out = t.groupBy("kind").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.count_if(D.preferred(F.col("path"), ["Brand#13", "Brand#5"])).alias("preferred"), F.max(D.last_part(F.col("path"))).alias("last"))
    return out.crossJoin(F.broadcast(total)).select("kind", "n", "seconds", F.round(F.col("n") / F.col("all"), 4).alias("share"), "preferred", "last")  # total: one row


@query("q_valid_split", f"WITH {P_SQL}, v AS (SELECT id FROM d ORDER BY p_brand IN ('Brand#13', 'Brand#5') DESC, md5(id::VARCHAR || '114514'), id LIMIT 20) SELECT id, CASE WHEN id IN (SELECT id FROM v) THEN 'valid' ELSE 'train' END AS part FROM d")
def valid_split(spark, sf):
    t = labelled(spark, sf).select("id", D.preferred(F.col("path"), ["Brand#13", "Brand#5"]).alias("preferred"))
    valid, train = D.valid_split(t, 20, "114514")
    return valid.select("id", F.lit("valid").alias("part")).union(train.select("id", F.lit("train")))


@query("q_oversampling", f"WITH {P_SQL}, g AS (SELECT p_size // 10 AS bin, kind, count(*) AS n, CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.5 END AS w FROM d GROUP BY 1, 2) SELECT bin, kind, n, round_even(n * (w / min(w) OVER (PARTITION BY bin) - 1), 0)::BIGINT AS extra FROM g")
def oversampling(spark, sf):
    return D.oversampling(labelled(spark, sf).withColumn("bin", F.expr("cast(seconds div 10 as int)")), {0: 1.0, 1: 2.0, 2: 3.5})


@query("q_tier_pairs", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'only_pred' WHEN k IS NULL THEN 'only_target' ELSE 'both' END AS state FROM (SELECT DISTINCT l_orderkey + 7 AS k FROM lineitem) FULL JOIN orders ON k = o_orderkey) GROUP BY state")
def tier_pairs(spark, sf):
    path = lambda c: F.format_string("tier/%d.TextGrid", c).alias("path")
    pred = V.read(spark, sf, "lineitem").select((F.col("l_orderkey") + 7).alias("k")).distinct().select(path(F.col("k")))
    return D.paired(pred, V.read(spark, sf, "orders").select(path(F.col("o_orderkey"))), "path").groupBy("state").agg(F.count("*").alias("n"))


SHOT_SQL = "cuts AS (SELECT DISTINCT user_id % 50 AS v, (event_id % 3000)::INT AS start FROM events WHERE event_type = 'error'), st AS (SELECT v, start FROM cuts UNION SELECT DISTINCT user_id % 50, 0 FROM events), sh AS (SELECT v, start, coalesce(lead(start) OVER (PARTITION BY v ORDER BY start), 3000) - 1 AS \"end\" FROM st)"


def shot_rows(spark, sf):
    e = V.read(spark, sf, "events").withColumn("v", F.col("user_id") % 50)
    return D.shots(e.where("event_type = 'error'").select("v", (F.col("event_id") % 3000).cast("int").alias("frame")), e.select("v").distinct().withColumn("frames", F.lit(3000)), "v", 30.0)


@query("q_shots", f'WITH {SHOT_SQL} SELECT v, start, "end", round_even(("end" - start + 1) / 30.0, 2)::DOUBLE AS seconds FROM sh')
def shot_segments(spark, sf):
    return shot_rows(spark, sf)


@query("q_shot_length", f'WITH {SHOT_SQL} SELECT v, count(*) AS n, round(avg(round_even(("end" - start + 1) / 30.0, 2)::DOUBLE), 3) AS mean, avg(round_even(("end" - start + 1) / 30.0, 2)::DOUBLE) < 60 AS too_short FROM sh GROUP BY v')
def shot_length(spark, sf):
    return shot_rows(spark, sf).groupBy("v").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 3).alias("mean"), (F.avg("seconds") < 60).alias("too_short"))


@query("q_breath_merge", f"""WITH {V.TIERS_SQL}, b AS (SELECT utt, target AS start, target + (idx % 3) * 0.06 AS "end", 'AP' AS mark, 1 AS source, idx FROM tiers WHERE mark = 'A'),
a AS (SELECT utt, pred AS start, pred + 1 AS "end", mark, 0 AS source, idx FROM tiers UNION ALL SELECT * FROM b WHERE "end" - start > 0.1) SELECT utt, mark, start, round("end", 4) AS "end", row_number() OVER (PARTITION BY utt ORDER BY start, source, idx)::INT AS place FROM a""")
def breath_merge(spark, sf):
    t = V.tiers(spark, sf)
    words = t.select("utt", F.col("pred").alias("start"), (F.col("pred") + 1).alias("end"), "mark", "idx")
    breaths = t.where("mark = 'A'").select("utt", F.col("target").alias("start"), (F.col("target") + (F.col("idx") % 3) * 0.06).alias("end"), "idx")
    return D.with_breaths(words, breaths, "utt").select("utt", "mark", "start", F.round("end", 4).alias("end"), "place")


@query("q_line_chars", "SELECT c_custkey AS line, coalesce(own, array_to_string(string_split(c_mktsegment, ''), '-')) AS chars FROM customer LEFT JOIN (SELECT o_custkey, string_agg(substr(o_orderpriority, 1, 1), '-' ORDER BY o_orderkey) AS own FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def line_chars(spark, sf):
    lines = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("lineId"), F.col("c_mktsegment").alias("text"))
    own = V.read(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("lineId"), F.col("o_orderkey").alias("pos"), F.substring("o_orderpriority", 1, 1).alias("char"))
    return D.line_chars(lines, own).select(F.col("lineId").alias("line"), F.array_join("chars", "-").alias("chars"))


@query("q_zip_segments", "SELECT p_partkey AS id, least(len(p_name), p_size % 9)::INT AS n, array_to_string([i || substr(p_name, i::INT + 1, 1) for i in range(least(len(p_name), p_size % 9))], ',') AS pairs FROM part")
def zip_segments(spark, sf):
    segments = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < F.col("p_size") % 9)
    z = D.zipped(segments, F.filter(F.split("p_name", ""), lambda c: c != ""))
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), z.alias("z")).select("id", F.size("z").alias("n"), F.array_join(F.transform("z", lambda x: F.concat(x["segment"].cast("string"), x["char"])), ",").alias("pairs"))


@query("q_boxes", "SELECT o_orderkey AS id, round((o_totalprice - 10) * (o_custkey + 1), 2) + 0.0 AS area, round(o_totalprice / 1e6 * 1920, 4) AS x, o_custkey * 1080 AS y, floor((o_custkey * 1000 * 0.5 * 2.0 + 0.5) / 512)::INT AS frames FROM orders")
def boxes(spark, sf):
    x, y = D.to_pixels(F.col("o_totalprice") / 1e6, F.col("o_custkey"), 1920, 1080)
    return V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r4(D.box_area(F.lit(10), F.lit(-1), F.col("o_totalprice"), F.col("o_custkey")), 2).alias("area"), F.round(x, 4).alias("x"), y.alias("y"), D.frame_count(F.col("o_custkey") * 1000, 0.5, 2.0, 512).alias("frames"))


@query("q_nonzero_mean", "SELECT l_returnflag AS flag, round(sum(greatest(l_discount - 0.05, 0)) / (count(*) FILTER (l_discount - 0.05 > 0) + 1e-6), 6) AS loss FROM lineitem GROUP BY 1")
def nonzero(spark, sf):
    return V.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(D.nonzero_mean(F.greatest(F.col("l_discount") - 0.05, F.lit(0.0))), 6).alias("loss"))


@query("q_moving_density", "SELECT p_partkey AS id, round(((p_size * 0.1) * 0.9 + p_retailprice * 0.1) * 0.9 + 1 * 0.1, 6) AS ema FROM part")
def moving_density(spark, sf):
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(D.moving_density(F.array(F.col("p_size").cast("double"), "p_retailprice", F.lit(1.0)), 0.1), 6).alias("ema"))


@query("q_clean_syllables", "SELECT p_partkey AS id, replace(lower(p_name), ' ', '|') AS words FROM part")
def syllables(spark, sf):
    raw = F.concat(F.array(F.lit(" "), F.lit("曲"), F.lit("。!")), F.transform(F.split(F.upper("p_name"), " "), lambda w: F.concat(F.lit(" "), w)), F.array(F.lit("...")))
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(D.clean_syllables(raw), "|").alias("words"))


@query("q_latest_step", "SELECT max(o_orderkey) AS step FROM orders WHERE o_orderkey % 7 <> 0")
def latest_step(spark, sf):
    names = V.read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.format_string("ckpt/model_step_%d.ckpt", "o_orderkey")).otherwise(F.lit("ckpt/last.ckpt")).alias("path"))
    return D.latest_step(names, "path").select("step")


@query("q_box_inputs", "SELECT o_orderpriority AS style, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 3) AS q1, round(quantile_cont(o_totalprice, 0.5), 3) AS q2, round(quantile_cont(o_totalprice, 0.75), 3) AS q3 FROM orders GROUP BY 1")
def box_inputs(spark, sf):
    q = V.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("style")).agg(F.count("*").alias("n"), F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("style", "n", *[F.round(F.col("q")[i], 3).alias(f"q{i + 1}") for i in range(3)])


@query("q_total_duration", "SELECT greatest((SELECT max(o_totalprice) FROM orders), (SELECT max(l_extendedprice) FROM lineitem), (SELECT max(value) FROM events)) AS duration")
def total_duration(spark, sf):
    ends = [V.read(spark, sf, t).select(F.col(c).alias("e")) for t, c in (("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("events", "value"))]
    return ends[0].union(ends[1]).union(ends[2]).agg(F.max("e").alias("duration"))


@query("q_oov", "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(*) AS n FROM w WHERE word NOT IN (SELECT DISTINCT string_split(p_name, ' ')[1] FROM part WHERE p_size % 5 = 0) GROUP BY word")
def oov(spark, sf):
    p = V.read(spark, sf, "part")
    known = p.where("p_size % 5 = 0").select(F.split("p_name", " ")[0].alias("word")).distinct()
    return p.select(F.explode(F.split("p_name", " ")).alias("word")).join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


@query("q_g2p", "SELECT p_partkey AS id, CASE WHEN string_split(p_name, ' ')[2] = 'widget' THEN 'SP w i SP' ELSE 'SP' END AS dictionary, 'SP ' || replace(p_name, ' ', ' SP ') || ' SP' AS phoneme, 'SP ' || p_name || ' SP' AS plain FROM part")
def g2p(spark, sf):
    words = F.split("p_name", " ")
    phones_of = F.create_map(F.lit("widget"), F.array(F.lit("w"), F.lit("i")))
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(tiers.g2p_dictionary(F.slice(words, 2, 1), phones_of), " ").alias("dictionary"), F.array_join(tiers.g2p_phoneme(words), " ").alias("phoneme"), F.array_join(tiers.g2p_none(words), " ").alias("plain"))


@query("q_scale_cv", f"WITH {V.KP_SQL}, s AS (SELECT shot, frame, sqrt(power(max(x) FILTER (joint = 1) - max(x) FILTER (joint = 0), 2) + power(max(y) FILTER (joint = 1) - max(y) FILTER (joint = 0), 2)) AS scale FROM kp GROUP BY 1, 2) SELECT shot, round(stddev_pop(scale) / avg(scale), 4) AS cv FROM s GROUP BY shot")
def scale_cv(spark, sf):
    from tessella.functions.scalars import norm2

    k = V.keypoints(spark, sf)
    at = lambda c, j: F.max(F.when(F.col("joint") == j, F.col(c)))
    s = k.groupBy("shot", "frame").agg(norm2(at("x", 1) - at("x", 0), at("y", 1) - at("y", 0)).alias("scale"))
    return s.groupBy("shot").agg(F.round(F.stddev_pop("scale") / F.avg("scale"), 4).alias("cv"))
