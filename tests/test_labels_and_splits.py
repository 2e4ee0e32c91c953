from __future__ import annotations

from datetime import date, timedelta

import pytest
from barloom.operators import labels, splits
from pyspark.sql import functions as F


def series(spark, closes, vol):
    rows = [("a", date(2020, 1, 1) + timedelta(days=i), float(c), vol) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, vol20 double")


def first(frame):
    return frame.orderBy("date").first()


def test_barriers(spark):
    up = [100 + 30 * i / 19 for i in range(20)]
    assert first(labels.triple_barrier(series(spark, [100, *up], 0.01)))["label"] == 1
    assert first(labels.triple_barrier(series(spark, [100, *(200 - u for u in up)], 0.01)))["label"] == -1
    flat = labels.triple_barrier(series(spark, [100] * 30, 0.02)).orderBy("date").collect()
    assert flat[0]["label"] == 0 and flat[0]["bars_held"] == 10
    assert flat[-1]["label"] == 0 and flat[-1]["bars_held"] is None


def test_uniqueness_is_a_share(spark):
    ends = labels.label_end_times(series(spark, range(1, 51), 0.1), 5)
    got = [r["uniqueness"] for r in labels.average_uniqueness(ends).collect()]
    assert len(got) == 50 and all(0 < u <= 1 for u in got)


def test_weights_have_mean_one(spark):
    got = [r["weight"] for r in labels.sample_weights(series(spark, range(1, 201), 0.1)).collect()]
    assert abs(sum(got) / 200 - 1) < 1e-9 and min(got) > 0


def test_meta_labels(spark):
    rows = spark.createDataFrame([(1.0, 0.02), (1.0, -0.02), (-1.0, -0.02), (-1.0, 0.02)], "s double, r double")
    assert [r["m"] for r in rows.select(labels.meta_label(F.col("s"), F.col("r")).alias("m")).collect()] == [1, 0, 1, 0]


DATES = [date(2015, 1, 1) + timedelta(days=i) for i in range(1000)]


def frame(spark, dates=DATES):
    return spark.createDataFrame([(d,) for d in dates], "date date")


def by_fold(folds):
    out = {}
    for r in folds.collect():
        out.setdefault(r["fold"], {"train": [], "test": []})[r["role"]].append(r["date"])
    return out


def test_walk_forward_keeps_its_gap(spark):
    for expanding in (True, False):
        found = by_fold(splits.walk_forward(frame(spark), expanding=expanding))
        assert len(found) == 5 and sum(len(f["test"]) for f in found.values()) == 500
        for fold in found.values():
            assert max(fold["train"]) < min(fold["test"]) - timedelta(days=9)
            assert not set(fold["train"]) & set(fold["test"])
            assert expanding or len(fold["train"]) <= 500
    assert splits.walk_forward(frame(spark, DATES[:260])).count() == 0  # no span of 20 dates


def test_combinatorial_has_many_paths(spark):
    found = by_fold(splits.combinatorial(frame(spark)))
    assert len(found) > 5 and sorted(found) == list(range(len(found)))
    gap = timedelta(days=15)
    for fold in found.values():
        low, high = min(fold["test"]) - gap, max(fold["test"]) + gap
        assert all(d < low or d > high for d in fold["train"])


def pair(spark, train, test):
    return spark.createDataFrame([(0, d, "train") for d in train] + [(0, d, "test") for d in test], "fold int, date date, role string")


def test_overlap_raises(spark):
    with pytest.raises(AssertionError):
        splits.check_no_overlap(pair(spark, DATES[:600], DATES[590:700]), 5, 5)


def test_overlap_at_each_distance(spark):
    """Training that ends 1 to 20 days before the test span, or begins so long after it: refused within 15 days."""
    test, rows = DATES[500:600], []
    for k in range(1, 21):
        rows += [(k, DATES[500 - k], "train"), (-k, DATES[599 + k], "train"), *((f, d, "test") for f in (k, -k) for d in test)]
    got = {r["fold"]: r["inside"] for r in splits.overlaps(spark.createDataFrame(rows, "fold int, date date, role string"), 5, 5).collect()}
    assert got == {s * k: int(k <= 15) for k in range(1, 21) for s in (1, -1)}
    splits.check_no_overlap(pair(spark, DATES[:484], test), 5, 5)


def test_purged_folds_are_disjoint(spark):
    rows = spark.range(100).select(F.col("id").alias("row"), (F.col("id") + 5).alias("t1"))
    for purge in (False, True):
        got = splits.purged_k_fold(rows, 5, 0.02, purge).collect()
        for k in range(5):
            parts = {role: {r["row"] for r in got if r["fold"] == k and r["role"] == role} for role in ("train", "test")}
            assert len(parts["test"]) == 20 and not parts["train"] & parts["test"]
            if purge:
                assert all(r + 5 < min(parts["test"]) for r in parts["train"] if r < min(parts["test"]))
