"""Losses that a review found, on small tables against brute force."""

import re

import numpy as np
import pyarrow as pa

from tessella.llm import decontaminate, near_groups, textkit


def low(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def gram_set(t):
    w = low(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def alike(a, b):
    a, b = gram_set(a), gram_set(b)
    return len(a & b) / len(a | b)


def edited(rng, kind, words):
    """A copy of ``words`` that lost or gained about a sixth of them in one place, or a few single words."""
    n = len(words)
    if kind == "truncated":
        return words[: n - n * 16 // 100]
    if kind == "extended":
        return [*words, *[f"new{rng.integers(1 << 40)}" for _ in range(n * 19 // 100)]]
    if kind == "block":
        return [*words[: n * 2 // 5], *words[n * 2 // 5 + n * 14 // 100 :]]
    out = list(words)
    for i in rng.choice(n, max(1, n // 60), replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return out


def test_near_copies_of_every_edit_are_found(spark):
    rng = np.random.default_rng(5)
    texts = [t for t in textkit.read(spark, "/root/testdata/sf0.01", "documents").toPandas().text if t and 80 <= len(low(t)) <= 600]
    seen, rows, pairs = set(), [], []
    for k, t in enumerate(texts):
        if gram_set(t) & seen or len(pairs) == 240:
            continue
        seen |= gram_set(t)
        kind = ("truncated", "extended", "block", "scattered")[len(pairs) % 4]
        copy = " ".join(edited(rng, kind, low(t)))
        if 0.8 <= alike(t, copy) < 0.9:
            pairs.append((kind, 2 * k, 2 * k + 1))
            rows += [(2 * k, t), (2 * k + 1, copy)]
    assert min(sum(p[0] == kind for p in pairs) for kind in ("truncated", "extended", "block", "scattered")) >= 30
    kept = {r["doc_id"] for r in near_groups.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    missed = {kind: sum(b in kept for k, _, b in pairs if k == kind) for kind in {p[0] for p in pairs}}
    assert not any(missed.values()), missed
    assert {a for _, a, _ in pairs} <= kept


def test_rows_of_an_equal_fingerprint_keep_their_links():
    words = [f"w{i}" for i in range(104)]
    other = [*words[:100], *[f"x{i}" for i in range(4)]]  # 0.92 like the first
    third = [*[f"y{i}" for i in range(8)], *words[8:100], *[f"x{i}" for i in range(4)]]  # 92 shingles of 108 with the second, 88 of 112 with the first
    h, offsets = near_groups.shingle_sets(pa.array([" ".join(t) for t in (words, other, third)]))
    assert near_groups.decide(np.zeros(3, int), np.array([5, 5, 7], np.uint64), h, offsets, np.arange(3)).tolist() == [0, 0, 0]
    assert near_groups.decide(np.zeros(2, int), np.array([5, 7], np.uint64), np.r_[h[: offsets[1]], h[offsets[2] :]], np.r_[0, offsets[1], offsets[1] + offsets[3] - offsets[2]], np.arange(2)).tolist() == [0, 1]


def test_decontamination_judges_rows_and_items_without_ids(spark):
    item, clean = " ".join(f"w{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    docs = spark.createDataFrame([(None, item), (1, item), (1, clean), (None, clean), (2, f"{item[::-1]} x"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (None, item[::-1])], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.clean(docs, items).collect()) == [(0, clean), (1, clean), (3, "")]
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in decontaminate.find(docs, items).collect()) == [(0, 7), (1, 7), (2, 0)]
    assert decontaminate.clean(docs, items, 1).count() == 3


def test_one_task_decides_more_than_it_holds_at_once(spark):
    """700 pairs of near copies, 11 MB in one task: neighbourhoods that are carried over to the next batch keep their links."""
    rows = []
    for k in range(700):
        words = [f"d{k}w{i}" for i in range(900)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:880], *[f"d{k}n{i}" for i in range(20)]]))]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        kept = {r["doc_id"] for r in near_groups.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert kept == set(range(0, 1400, 2))
