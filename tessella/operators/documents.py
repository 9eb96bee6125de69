"""Operators on annotation documents, aligner output and dataset tables: selection, ordering, intervals, label rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The label types, strongest first, with the path part that names them.
LABEL_TYPES = (("full_label", 2), ("weak_label", 1), ("no_label", 0))


def required(df: DataFrame, *names: str) -> DataFrame:
    """Adds fault: the first of the string columns that is missing, NULL where none is."""
    return df.withColumn("fault", F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def open_items(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows to annotate: without a tone, or all of them with ``overwrite``."""
    return df if overwrite else df.where(F.col("tone").isNull())


def ordered_lines(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """(lineId, rank, ids): lines in the order of ``lines`` (lineId, pos), orphans after them by first appearance; ids by (start or 0, id)."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("start", F.lit(0.0)).alias("start"), "id"))), lambda x: x["id"])
    grouped = chars.groupBy("lineId").agg(ids.alias("ids"), F.min("pos").alias("seen"))
    place = F.struct(F.col("line_pos").isNull(), F.coalesce("line_pos", "seen"))
    found = grouped.join(lines.select("lineId", F.col("pos").alias("line_pos")), "lineId", "left")
    return found.select("lineId", "ids", place.alias("place"))


def strip_fence(text: Column) -> Column:
    """Text of a fenced code block, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


RESULT = "struct<batchId: string, annotations: array<struct<id: string, char: string, confidence: double>>>"


def batch_faults(df: DataFrame) -> DataFrame:
    """(batch, faults) of an answer (text) to a request with items of struct(id, char): rules broken by the whole batch."""
    answer = F.from_json(strip_fence(F.col("text")), RESULT)
    notes = F.filter(F.coalesce(answer["annotations"], F.array().cast("array<struct<id: string, char: string, confidence: double>>")), lambda x: x.isNotNull())
    known = F.map_from_entries(F.transform("items", lambda i: F.struct(i["id"], i["char"])))
    ids = F.transform(notes, lambda x: x["id"])
    missing = F.array_sort(F.array_except(F.transform("items", lambda i: i["id"]), ids))
    rules = {
        "not_json": F.try_parse_json(strip_fence(F.col("text"))).isNull(),
        "batch_id": ~F.coalesce(answer["batchId"] == F.col("batch"), F.lit(False)),
        "annotations": answer["annotations"].isNull(),
        "not_object": F.coalesce(F.exists(answer["annotations"], lambda x: x.isNull()), F.lit(False)),
        "unknown_id": F.exists(ids, lambda i: ~F.coalesce(F.map_contains_key(known, i), F.lit(False))),
        "repeated_id": F.size(ids) > F.size(F.array_distinct(ids)),
        "char": F.exists(notes, lambda x: F.coalesce(F.map_contains_key(known, x["id"]), F.lit(False)) & ~F.coalesce(x["char"] == F.element_at(known, x["id"]), F.lit(False))),
        "missing_id": F.size(missing) > 0,
    }
    return df.select("batch", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])).alias("faults"), F.slice(missing, 1, 10).alias("missing"))


def review_counts(df: DataFrame) -> DataFrame:
    """Summary of a run: targets, written, omitted, to review, batches. df: id, batch, tone, needsReview."""
    return df.agg(F.count("*").alias("target"), F.count_if(F.col("tone").isNotNull()).alias("written"), F.count_if(F.col("tone").isNull()).alias("omitted"), F.count_if("needsReview").alias("review"), F.countDistinct("batch").alias("batches"))


def from_first_char(actions: DataFrame, chars: DataFrame, key: str) -> DataFrame:
    """Actions of a part that do not end before its first character; parts without characters keep theirs."""
    first = chars.groupBy(key).agg(F.min("start").alias("__first"))
    return actions.join(first, key, "left").where(F.col("__first").isNull() | (F.col("end") >= F.col("__first"))).drop("__first")


def phone_intervals(df: DataFrame, key: str) -> DataFrame:
    """Runs of phones with start, end and word: the start moves by half the edge slope, 0.5 at most; an interval ends where the next starts; SP is left out.

    df: key, idx, frame, phone, word, slope.
    """
    w = Window.partitionBy(key).orderBy("idx")
    start = F.col("frame") + F.least(F.greatest(F.col("slope") / 2, F.lit(-0.5)), F.lit(0.5))
    return df.withColumn("start", start).withColumn("end", F.lead("start").over(w)).where((F.col("phone") != "SP") & F.col("end").isNotNull()).select(key, "idx", "phone", "word", "start", "end")


def word_intervals(phones: DataFrame, key: str) -> DataFrame:
    """Neighbouring phones of one word as one interval."""
    w = Window.partitionBy(key).orderBy("idx")
    new = F.when(F.lag("word").over(w) == F.col("word"), 0).otherwise(1)
    runs = phones.withColumn("__n", new).withColumn("run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first("word").alias("word"), F.min("start").alias("start"), F.max("end").alias("end"))


def soft_edges(times: DataFrame, key: str, time: str) -> DataFrame:
    """(key, frame, target): a boundary at a fractional frame is shared by it and the next, scaled to 0.1..0.9; larger shares win."""
    at, part = F.floor(time).cast("int"), F.col(time) - F.floor(time)
    shares = F.explode(F.array(F.struct((at).alias("frame"), (1 - part).alias("s")), F.struct((at + 1).alias("frame"), part.alias("s"))))
    return times.select(key, shares.alias("e")).groupBy(key, F.col("e.frame").alias("frame")).agg((F.max("e.s") * 0.8 + 0.1).alias("target"))


def dense_path(steps: DataFrame, key: str, length: int) -> DataFrame:
    """(key, frame, state): sparse step changes summed up along all frames."""
    grid = steps.select(key).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    step = steps.groupBy(key, "frame").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(step, [key, "frame"], "left").select(key, "frame", F.sum(F.coalesce("step", F.lit(0))).over(w).alias("state"))


def prompt_sequence(numbers: Column, names: Column) -> Column:
    """Decoded phones without padding, SP before, between and after. names: map of number to phone."""
    seen = F.filter(numbers, lambda x: x != 0)
    return F.concat(F.array(F.lit("SP")), F.flatten(F.transform(seen, lambda p: F.array(F.element_at(names, p), F.lit("SP")))))


def label_type(path: Column) -> Column:
    """2, 1 or 0 by what the path contains, 0 without any."""
    return F.coalesce(*[F.when(path.contains(name), F.lit(n)) for name, n in LABEL_TYPES], F.lit(0))


def downgraded(kind: Column, phones: Column, durations: Column) -> Column:
    """A full label whose durations do not fit is a weak one; without phones there is no label."""
    return F.when(F.size(phones) == 0, 0).when((kind == 2) & (F.size(phones) != F.size(durations)), 1).otherwise(kind)


def preferred(path: Column, folders: list[str]) -> Column:
    """Whether a part of the path is one of the folders."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders]))


def valid_split(df: DataFrame, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(validation, training): n rows, preferred ones first and at random by seed, and the rest. df: id, preferred."""
    drawn = df.withColumn("draw", F.md5(F.concat(F.col("id").cast("string"), F.lit(seed)))).orderBy(F.desc("preferred"), "draw", "id").limit(n).drop("draw")
    return drawn, df.join(drawn.select("id"), "id", "left_anti")


def oversampling(df: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(bin, kind, n, extra): copies to add of each label type in a bin, by weights relative to the least one present."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    counts = df.groupBy("bin", "kind").count().withColumn("w", F.element_at(table, F.col("kind")))
    least = F.min("w").over(Window.partitionBy("bin"))
    return counts.select("bin", "kind", F.col("count").alias("n"), F.rint(F.col("count") * (F.col("w") / least - 1)).cast("bigint").alias("extra"))


def paired(pred: DataFrame, target: DataFrame, path: str) -> DataFrame:
    """(path, state): both, only_pred or only_target of two listings."""
    both = pred.select(path, F.lit(1).alias("p")).join(target.select(path, F.lit(1).alias("t")), path, "full_outer")
    return both.select(path, F.when(F.col("p").isNull(), "only_target").when(F.col("t").isNull(), "only_pred").otherwise("both").alias("state"))


def shots(cuts: DataFrame, lengths: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, start, end, seconds): segments between cuts, to the frame before the next; without cuts one segment. lengths: key, frames."""
    starts = lengths.select(key, F.lit(0).alias("start")).union(cuts.select(key, F.col("frame").alias("start"))).distinct()
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    held = starts.withColumn("next", nxt).join(lengths, key).withColumn("end", F.coalesce(F.col("next"), F.col("frames")) - 1)
    return held.select(key, "start", "end", F.bround((F.col("end") - F.col("start") + 1) / fps, 2).alias("seconds"))


def with_breaths(words: DataFrame, breaths: DataFrame, key: str, least: float = 0.1) -> DataFrame:
    """Words and breaths longer than ``least`` in order of start; words first where starts are equal, in their own order."""
    kept = breaths.where(F.col("end") - F.col("start") > least)
    both = words.select(key, "start", "end", "mark", F.lit(0).alias("source"), "idx").union(kept.select(key, "start", "end", F.lit("AP").alias("mark"), F.lit(1).alias("source"), "idx"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", "source", "idx"))).drop("source", "idx")


def line_chars(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """(lineId, chars): the characters of each line in order of pos, or those of its text where it has none."""
    own = chars.groupBy("lineId").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]).alias("own"))
    return lines.join(own, "lineId", "left").select("lineId", F.coalesce("own", F.filter(F.split("text", ""), lambda c: c != "")).alias("chars"))


def zipped(segments: Column, chars: Column) -> Column:
    """Segments and characters side by side, as many as the shorter has."""
    n = F.least(F.size(segments), F.size(chars))
    return F.arrays_zip(F.slice(segments, 1, n).alias("segment"), F.slice(chars, 1, n).alias("char"))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def to_pixels(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    return x * width, y * height


def frame_count(samples: Column, scale: float, rate: float, hop: int) -> Column:
    """Frames of a signal of so many samples at another rate."""
    return F.floor((samples * scale * rate + 0.5) / hop).cast("int")


def nonzero_mean(x: Column) -> Column:
    """Sum over the number of positive values, 0 without any."""
    return F.sum(x) / (F.count_if(x > 0) + F.lit(1e-6))


def moving_density(values: Column, alpha: float, start: float = 0.0) -> Column:
    """Exponential moving average of an array, after its last element."""
    return F.aggregate(values, F.lit(start), lambda acc, x: acc * (1 - alpha) + x * alpha)


def clean_syllables(words: Column) -> Column:
    """Lower-cased syllables without empty ones, lone Han characters and punctuation."""
    low = F.transform(words, lambda w: F.lower(F.trim(w)))
    return F.filter(low, lambda w: (w != "") & ~w.rlike(r"^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]$") & ~w.rlike(r"^[\p{P}\p{S}]+$"))


def latest_step(df: DataFrame, path: str) -> DataFrame:
    """The row with the highest number after ``step=`` or before the suffix of its path."""
    step = F.regexp_extract(path, r"(\d+)\.[A-Za-z]+$", 1).try_cast("long")
    return df.withColumn("step", step).where("step IS NOT NULL").orderBy(F.desc("step"), path).limit(1)


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def significant(x: Column, digits: int = 6) -> Column:
    """Text of a number with so many significant digits, without trailing zeros."""
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int")
    value = F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k))
    return F.regexp_replace(F.regexp_replace(F.format_string("%.12f", value), r"0+$", ""), r"\.$", "")
