"""Metrics on a table worked out by hand; fold and rank invariants."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ordinal_spark.operators import metrics as M
from ordinal_spark.operators.ranking import assign_folds, hash_order, rank_within
from ordinal_spark.plans.q_analysis import pseudo_predictions, pseudo_train_counts


def test_scores_by_hand(spark):
    """Training counts 4, 2, 2; four predictions. Worked out on paper:
    weights 0.6, 1.2, 1.2; proximities prox(1,1) = 2, prox(2,2) = prox(3,3) = 3,
    prox(1,2) = 1, prox(2,3) = -log2(3/8)."""
    tc = spark.createDataFrame([("m", 0, 1, 4), ("m", 0, 2, 2), ("m", 0, 3, 2)], "model string, fold int, class int, n bigint")
    pred = spark.createDataFrame([("m", 0, "test", t, p) for t, p in ((1, 1), (2, 1), (3, 3), (2, 3))],
                                 "model string, fold int, split string, y_true int, y_pred int")
    weights = {r["class"]: r["weight"] for r in M.class_weights(tc).collect()}
    assert weights == pytest.approx({1: 0.6, 2: 1.2, 3: 1.2})
    s = M.fold_scores(pred, tc).first()
    assert s["mae"] == pytest.approx(0.5) and s["accuracy"] == pytest.approx(0.5)
    assert s["weighted_mae"] == pytest.approx(0.6)
    assert s["cem"] == pytest.approx(7.4150374992788 / 11)
    assert s["f1_weighted"] == pytest.approx(1 / 3)


def test_perfect_prediction(spark):
    pred = pseudo_predictions(spark, SF_SMALL).withColumn("y_pred", F.col("y_true"))
    tc = pseudo_train_counts(pred)
    for r in M.fold_scores(pred, tc).collect():
        assert r["mae"] == 0 and r["accuracy"] == 1 and abs(r["cem"] - 1) < 1e-12
        assert abs(r["f1_weighted"] - 1) < 1e-12


def test_class_weights_sum_to_k(spark):
    tc = pseudo_train_counts(pseudo_predictions(spark, SF_SMALL))
    w = M.class_weights(tc).groupBy("model", "fold").agg(F.sum("weight").alias("s"),
                                                        F.count("*").alias("k"))
    for r in w.collect():
        assert abs(r["s"] - r["k"]) < 1e-9


def test_folds_stratified(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("key"),
                                     (F.col("id") % 7).cast("int").alias("y"))
    f = assign_folds(df, "y", "key", k=5, seed=42).collect()
    assert len(f) == 2000 and len({r["key"] for r in f}) == 2000
    per = Counter((r["y"], r["fold"]) for r in f)
    for y in range(7):
        sizes = [per[(y, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_rank_within_equals_row_number(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("key"),
                                     (F.col("id") % 3).cast("int").alias("g"))
    got = rank_within(df, ["g"], [hash_order(7, "key"), "key"], out="r")
    w = Window.partitionBy("g").orderBy(hash_order(7, "key"), "key")
    ref = df.withColumn("r", F.row_number().over(w))
    a = {(r["key"], r["r"]) for r in got.collect()}
    b = {(r["key"], r["r"]) for r in ref.collect()}
    assert a == b
