"""Literal cases of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.scalars import timestamp
from tessella.operators import sequences, stats, tiers, tone

EDITS = [
    ([(0, "a"), (100, "b"), (200, "")], [(0, "a"), (100, "b"), (200, "")], 0),
    ([(0, "a"), (100, "")], [(0, "a"), (50, "a"), (100, "")], 1),
    ([(0, "a"), (100, "")], [(0, "a"), (50, "b"), (100, "")], 2),
    ([(0, "a"), (50, "b"), (100, "")], [(0, "a"), (100, "")], 1),
    ([(0, "a"), (100, "b"), (200, "")], [(0, "a"), (121, "b"), (200, "")], 1),
    ([(0, "a"), (100, "b"), (200, "")], [(0, "a"), (120, "b"), (200, "")], 0),
    ([(0, "a"), (100, "b"), (200, "")], [(0, "b"), (100, "c"), (200, "")], 2),
]


@pytest.mark.parametrize(("pred", "target", "edits"), EDITS)
def test_edit_count(pred, target, edits):
    assert tiers.edit_count(pred, target) == edits


def test_iou(spark):
    schema = "utt string, mark string, start double, end double"
    p = spark.createDataFrame([("u", "a", 0.0, 50.0), ("u", "b", 50.0, 250.0)], schema)
    t = spark.createDataFrame([("u", "a", 0.0, 100.0), ("u", "b", 100.0, 200.0)], schema)
    assert {r["mark"]: r["iou"] for r in tiers.iou(p, t, "utt", 64.0).collect()} == {"a": 0.5, "b": 0.5}


def test_tolerance_dedup(spark):
    df = spark.createDataFrame([("k", t) for t in (0.0, 0.6, 1.2, 2.0, 2.3)], "k string, t double")
    assert sorted(r["t"] for r in sequences.tolerance_dedup(df, "k", "t", 1.0).collect()) == [0.0, 1.2, 2.3]


def test_batches_and_bins(spark):
    df = spark.range(1).select(sequences.batch_numbers(F.array(*[F.lit(x) for x in (10, 10, 30, 5, 5, 5, 5)]), 3, 24).alias("b"), sequences.length_bins(F.array(*[F.lit(x) for x in (9.0, 8.0, 3.0)]), 15.0, False).alias("l"))
    r = df.first()
    assert r["b"] == [0, 0, 1, 2, 2, 2, 3] and r["l"] == [0, 0, None]


def test_timestamp_carries(spark):
    r = spark.range(1).select(timestamp(F.lit(59.9996)).alias("a"), timestamp(F.lit(59.9996), legacy=True).alias("b")).first()
    assert (r["a"], r["b"]) == ("00:01:00,000", "00:00:59,1000")


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert df.agg(stats.pearson("a", "b").alias("r")).first()["r"] is None


def test_p_value():
    assert abs(stats.pearson_p_value(0.5, 20) - 0.02476) < 1e-4  # t = 2.449 with 18 degrees of freedom


def test_confidence_cap(spark):
    df = spark.createDataFrame([(0.98, False, "lexicon", False), (0.95, False, None, False)], "confidence double, referenceAvailable boolean, source string, needsReview boolean")
    assert {tuple(r) for r in tone.confidence_policy(df).select("confidence", "source", "needsReview").collect()} == {(0.79, "context_inference", True)}


def test_viterbi_follows_the_states():
    p = np.log(np.array([[0.9, 0.05, 0.05]] * 4 + [[0.05, 0.9, 0.05]] * 4 + [[0.05, 0.05, 0.9]] * 4))
    edge = np.full(12, 0.1)
    edge[[4, 8]] = 0.9
    path, confidence = tiers.viterbi(p, edge, np.zeros(3, bool))
    assert path[0] == 0 and path[-1] == 2 and (np.diff(path) >= 0).all() and confidence.max() <= 1


def test_streaming_activity(spark, tmp_path):
    from tessella.streaming.activity import activity
    from tessella.views import read

    schema = read(spark, "/root/testdata/sf0.001", "events").schema
    (tmp_path / "in").mkdir()
    read(spark, "/root/testdata/sf0.001", "events").coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    q = activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e"))).writeStream.outputMode("complete").format("memory").queryName("act").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM act").first()[0] == 1000


def test_surrogates_are_those_of_permuted_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessella.operators import stats

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 300)

    def information(a, b):
        t = np.zeros((4, 3))
        np.add.at(t, (a, b), 1 / len(a))
        some = t > 0
        return (t[some] * np.log((t / np.outer(t.sum(1), t.sum(0)))[some])).sum()

    want = [information(a, rng.permutation(b)) for _ in range(2000)]
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    got = stats.surrogate_information(df, "a", "b", 2000).agg(F.count("*").alias("n"), F.avg("mi").alias("m"), F.stddev_pop("mi").alias("s"), F.percentile("mi", 0.95).alias("q")).first()
    assert got["n"] == 2000
    assert abs(got["m"] / np.mean(want) - 1) < 0.06 and abs(got["s"] / np.std(want) - 1) < 0.12 and abs(got["q"] / np.quantile(want, 0.95) - 1) < 0.1


def test_bins_of_long_shelves(spark):
    """Shelves of several batches have the bins of the rule, one item after the other."""
    n, limit = 50_000, 1500.0
    df = spark.range(2 * n).select((F.col("id") % 2).alias("shelf"), "id", (F.pmod(F.hash("id"), F.lit(700)) + F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.0)).alias("length"))
    got = sequences.binned(df, "shelf", "length", "id", limit).toPandas()
    assert len(got) == 2 * n
    for _, t in got.sort_values(["length", "id"], ascending=False).groupby("shelf"):
        b = k = 0
        for length, bin_ in zip(t["length"], t["bin"], strict=True):
            top = length if k == 0 else top
            assert bin_ == b
            b, k = (b + 1, 0) if top * (k + 1) > limit else (b, k + 1)


def test_bins_of_odd_lengths():
    bins, last, room = sequences.fill_bins(np.array([np.nan, np.inf, 7.0, 5.0, 0.0, -1.0, 0.0]), 6.0)
    assert bins.tolist() == [0, 1, 2, 3, 3, 4, 4] and last == 4 and room > 0
    assert sequences.bin_sizes(np.array([0.1, 0.3]), 0.3).tolist() == [3, 2]


def brute_merge(parts):
    """Items of (start, pos, char, end) merged by trying every prefix at every place."""
    text = list(parts[0])
    for p in parts[1:]:
        end, n = text[-1][3], 0
        if end is not None and p[0][0] < end + 5:
            a, b = [x[2] for x in text], [x[2] for x in p]
            most = sum(x[0] < end + 2 for x in p)
            n = next((k for k in range(min(most, len(a)), 0, -1) for s in range(max(len(a) - k - 10, 0), len(a) - k + 1) if a[s : s + k] == b[:k]), 0)
        text += p[n:]
    return text


def test_merged_parts_are_those_of_all_prefixes(spark):
    rng, items, want = np.random.default_rng(3), [], {}
    for key in range(60):
        said, parts, pos = "".join(rng.choice(list("ab" if key % 2 else "abcde"), 90)), [], 0
        for part in range(4):
            first = part * 25 - int(rng.integers(0, 12)) if part else 0
            last = first + int(rng.integers(1, 40))
            parts.append([(i + 0.25 * float(rng.integers(0, 2)), (pos := pos + 1), None if said[i] == "a" and key % 3 == 0 else said[i], None if key == 7 else i + float(rng.integers(0, 9))) for i in range(max(first, 0), last) if i < 90])
        if key == 5:
            parts[1] = parts[0][-3:]
        parts = [p for p in parts if p]
        want[key] = sorted((x[1], x[0]) for x in brute_merge([sorted(p) for p in parts]))
        items += [(key, i, *x) for i, p in enumerate(parts) for x in p]
    df = spark.createDataFrame(items, "vid int, part int, start double, pos long, char string, end double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequences.merge_parts(df, "vid", "part").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(zip(t["pos"], t["start"], strict=True)) for k, t in got.groupby("vid")} == want
    assert len(got) < len(items)


def test_overlap_of_a_long_repeat():
    n = 100_000
    assert sequences.overlap_count(np.arange(n), np.arange(n // 2, n)) == n // 2
    assert sequences.overlap_count(np.zeros(n), np.zeros(n)) == n
    assert sequences.overlap_count(np.arange(n), np.arange(n // 2, n - 11)) == 0
