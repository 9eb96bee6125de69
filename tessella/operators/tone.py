"""Annotation of characters by an external model: lookup, payloads, validation, confidence, conflicts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tone classes, those of the third tone, and its subtypes.
TONE_CLASSES = ["yin_ping", "yang_ping", "yin_shang", "yang_shang", "yin_qu", "yang_qu", "yin_ru", "yang_ru"]
SHANG_CLASSES = ["yin_shang", "yang_shang"]
SHANG_SUBTYPES = ["yin_shang", "yang_shang", "yinyang_tongyong"]


def lookup_index(entries: DataFrame) -> DataFrame:
    """(lookup, entry, pos): each entry under its character and its variants, once per key."""
    keys = F.array_distinct(F.filter(F.concat(F.array("character"), F.coalesce("variants", F.array().cast("array<string>"))), lambda k: k.isNotNull() & (k != "")))
    return entries.select(F.explode(keys).alias("lookup"), "pos", "entry")


def with_references(chars: DataFrame, index: DataFrame) -> DataFrame:
    """Adds references (entries in order) and referenceAvailable; rows without an entry keep none."""
    grouped = index.groupBy("lookup").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("references"))
    return chars.join(grouped, "lookup", "left").withColumn("referenceAvailable", F.col("references").isNotNull())


def with_context(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previousChar", F.lag(value).over(w)).withColumn("nextChar", F.lead(value).over(w))


def annotation_faults(tone: Column, subtype: Column, confidence: Column) -> Column:
    """Names of the rules that one annotation breaks."""
    shang = tone.isin(*SHANG_CLASSES)
    rules = {
        "tone_class": ~F.coalesce(tone.isin(*TONE_CLASSES), F.lit(False)),
        "subtype_missing": shang & ~F.coalesce(subtype.isin(*SHANG_SUBTYPES), F.lit(False)),
        "subtype_mismatch": shang & (((subtype == "yin_shang") & (tone != "yin_shang")) | ((tone == "yin_shang") & (subtype != "yin_shang"))),
        "subtype_unexpected": ~shang & subtype.isNotNull(),
        "confidence": ~F.coalesce(confidence.between(0.0, 1.0) & ~F.isnan(confidence), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))


def reconcile(expected: DataFrame, returned: DataFrame, batch: str) -> DataFrame:
    """(batch, unknown, duplicate, missing) counts of ids."""
    seen = returned.groupBy(batch, "id").agg(F.count("*").alias("times"))
    both = expected.select(batch, "id", F.lit(1).alias("want")).join(seen, [batch, "id"], "full_outer")
    return both.groupBy(batch).agg(F.count_if(F.col("want").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("duplicate"), F.count_if(F.col("times").isNull()).alias("missing"))


def confidence_policy(df: DataFrame, threshold: float = 0.8, cap: float = 0.79) -> DataFrame:
    """Without a reference, or by the model's own word, a result is an inference: capped and to be reviewed."""
    inferred = ~F.col("referenceAvailable") | (F.col("source") == "context_inference")
    out = df.withColumn("confidence", F.when(inferred, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))).withColumn("source", F.when(~F.col("referenceAvailable"), F.lit("context_inference")).otherwise(F.col("source")))
    return out.withColumn("needsReview", F.coalesce("needsReview", F.lit(False)) | ~F.col("referenceAvailable") | (F.col("confidence") < threshold))


def glyph_conflicts(df: DataFrame) -> DataFrame:
    """(char, options, occurrences) of characters annotated in two or more ways."""
    option = F.struct("toneClass", "subtype")
    return df.groupBy("char").agg(F.sort_array(F.collect_set(option)).alias("options"), F.count("*").alias("occurrences")).where(F.size("options") > 1)


def write_back(chars: DataFrame, results: DataFrame, omit_low: bool = False) -> DataFrame:
    """Adds the stored tone: class, and subtype for third tones only; low confidence may be omitted."""
    shown = F.struct(F.col("toneClass"), F.when(F.col("toneClass").isin(*SHANG_CLASSES), F.col("subtype")).alias("subtype"))
    tone = F.when(F.lit(omit_low) & F.col("needsReview"), F.lit(None)).otherwise(shown)
    return chars.join(results.select("id", tone.alias("tone")), "id", "left")
