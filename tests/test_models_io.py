"""Model contracts, model quality on separable data, typed scan."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ordinal_spark.models import (BoostedOrdinal, ConditionalOrdinalNet, OrderedForest,
                                  OrdinalLogistic)
from ordinal_spark.operators import tuning
from ordinal_spark.operators.metrics import long_scores
from ordinal_spark.schema import FIXTURE_SCHEMA as S
from ordinal_spark.sources import load_reports, write_table


@pytest.fixture(scope="module")
def separable(spark):
    # y in 1..4 determined by x1 with noise feature x2
    df = spark.range(0, 1200).select(
        F.col("id").cast("string").alias("key"),
        ((F.col("id") % 4) + 1).cast("int").alias("y"),
        ((F.col("id") % 4) * 2.0 + F.rand(3) * 0.5).alias("x1"),
        F.rand(5).alias("x2"))
    return df.cache()


@pytest.mark.parametrize("cls,params", [
    (OrdinalLogistic, {"alpha": 0.1}),
    (OrderedForest, {"n_estimators": 10, "min_samples_leaf": 5, "max_features": 2}),
    (BoostedOrdinal, {"iterations": 10, "depth": 3}),
    (ConditionalOrdinalNet, {"hidden_layer_sizes": (8,), "epochs": 100}),
])
def test_model_beats_majority(separable, cls, params):
    m = cls(["x1", "x2"], label="y", classes=[1, 2, 3, 4], **params)
    with pytest.raises(ValueError):
        m.predict(separable)
    m.fit(separable)
    acc = m.predict(separable).select(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.8
    imp = m.importance()
    if imp:
        assert {f for f, _ in imp} == {"x1", "x2"}


def test_cross_validate_long_table(spark, separable):
    cands = [tuning.Candidate("ordinal_logistic", tuning.params_id({"alpha": a}),
                              lambda a=a: OrdinalLogistic(["x1", "x2"], "y", [1, 2, 3, 4], alpha=a))
             for a in (0.1, 10.0)]
    cv = tuning.cross_validate(separable, "key", "y", cands, k=3, parallelism=2)
    assert not cv.failures
    assert cv.scores.count() == 2 * 3 * 2  # candidates x folds x splits
    # test rows of one candidate cover every key exactly once
    test_keys = cv.predictions.where((F.col("split") == "test") & (F.col("params_id") == cands[0].params_id))
    assert test_keys.count() == 1200 and test_keys.select("ref").distinct().count() == 1200
    summ = tuning.tuning_summary(cv, "weighted_mae")
    best = tuning.best_params(summ, "weighted_mae").collect()
    assert len(best) == 1
    assert long_scores(cv.scores, keys=("model", "params_id", "fold")).count() == 12 * 5


def test_failed_fold_is_excluded(spark, separable):
    def broken():
        raise RuntimeError("boom")
    cands = [tuning.Candidate("ordinal_logistic", "bad", broken),
             tuning.Candidate("ordinal_logistic", "good",
                              lambda: OrdinalLogistic(["x1", "x2"], "y", [1, 2, 3, 4]))]
    cv = tuning.cross_validate(separable, "key", "y", cands, k=2, parallelism=2, with_train=False)
    assert len(cv.failures) == 2
    ids = {r["params_id"] for r in tuning.tuning_summary(cv).collect()}
    assert ids == {"good"}


def test_load_reports_csv(spark):
    d = tempfile.mkdtemp(prefix="ordinal-io-", dir="/tmp")
    p = os.path.join(d, "reports.csv")
    with open(p, "w") as f:
        f.write(",".join(S.raw_columns) + "\n")
        f.write("C1,2020,Qtr 1,b,LARGE,F,1-URGENT,1 to 9,BUILDING,Less than 24 hours\n")
        f.write("C1,2020,Qtr 1,NA,SMALL,F,1-URGENT,1 to 9,BUILDING,Less than 24 hours\n")
    df = load_reports(spark, p, S)
    rows = df.collect()
    assert len(rows) == 2 and rows[1]["data_subject_type"] is None
    assert dict(df.dtypes)["year"] == "int"
    write_table(df, os.path.join(d, "out"), partition_by=["year"])
    assert spark.read.parquet(os.path.join(d, "out")).count() == 2
    with pytest.raises(FileNotFoundError):
        load_reports(spark, os.path.join(d, "missing.csv"), S)
    empty = os.path.join(d, "empty.csv")
    with open(empty, "w") as f:
        f.write(",".join(S.raw_columns) + "\n")
    with pytest.raises(ValueError):
        load_reports(spark, empty, S)
    with pytest.raises(ValueError):
        S.struct_type({"nope": None})


def test_tuning_report_tables(spark):
    rows = []
    for n, leaf, mf in [(100, 3, 5), (100, 3, 10), (100, 10, 5), (200, 3, 5)]:
        rows.append(("ordered_forest", tuning.params_id(
            {"n_estimators": n, "min_samples_leaf": leaf, "max_features": mf}), 0.5 + leaf / 100 + mf / 1000, 0.01))
    for lr, d, l2 in [(0.01, 4, 3), (0.1, 4, 3), (0.1, 6, 6)]:
        rows.append(("boosted_ordinal", tuning.params_id(
            {"iterations": 10, "learning_rate": lr, "depth": d, "l2_leaf_reg": l2}), 0.4 + lr, 0.02))
    rows.append(("conditional_ordinal_net", tuning.params_id(
        {"hidden_layer_sizes": (64, 32), "lr": 0.001, "batch_size": 64, "epochs": 5}), 0.45, 0.0))
    for a in (0.1, 1.0):
        rows.append(("ordinal_logistic", tuning.params_id({"alpha": a}), 0.6 - a / 10, 0.05))
    summ = spark.createDataFrame(rows, "model string, params_id string, mean double, std double")
    rf = {r["min_samples_leaf"]: r for r in tuning.forest_pivot(summ, 100).collect()}
    assert set(rf) == {3, 10} and abs(rf[3]["5"] - 0.535) < 1e-12 and rf[10]["10"] is None
    cb = tuning.boosted_pivot(summ).collect()
    assert len(cb) == 2 and {c for c in cb[0].asDict()} >= {"depth", "l2_leaf_reg"}
    nn = tuning.net_by_architecture(summ).collect()
    assert len(nn) == 1 and nn[0]["combos"] == 1
    band = {r["alpha"]: r for r in tuning.logistic_band(summ).collect()}
    assert abs(band[1.0]["lo"] - 0.45) < 1e-12 and abs(band[1.0]["hi"] - 0.55) < 1e-12
    best = {r["model"]: r["params_id"] for r in tuning.best_params(summ.withColumn(
        "folds", F.lit(5)), "weighted_mae").collect()}
    assert best["ordinal_logistic"] == tuning.params_id({"alpha": 1.0})


def test_permutation_importance_finds_signal(spark, separable):
    m = ConditionalOrdinalNet(["x1", "x2"], label="y", classes=[1, 2, 3, 4],
                              hidden_layer_sizes=(8,), epochs=100).fit(separable)
    imp = {r["feature"]: r["importance"] for r in tuning.permutation_importance(
        m, separable, "key", "y", ["x1", "x2"]).collect()}
    assert imp["x1"] > 0.5 and abs(imp["x2"]) < imp["x1"] / 5


def _csv(tmp_path, header, row):
    p = tmp_path / "reports.csv"
    p.write_text(",".join(header) + "\n" + ",".join(row) + "\n")
    return str(p)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names = list(S.raw_columns)
    values = {n: f"v{i}" for i, n in enumerate(names)} | {S.year: "2020", S.period: "None"}
    header = ["extra", *reversed(names)]
    r = load_reports(spark, _csv(tmp_path, header, ["z", *(values[n] for n in reversed(names))]), S).first().asDict()
    assert r == {n: v for n, v in values.items()} | {S.year: 2020, S.period: None}


def test_csv_missing_column_raises(spark, tmp_path):
    names = [n for n in S.raw_columns if n != "sector"]
    with pytest.raises(ValueError, match="sector"):
        load_reports(spark, _csv(tmp_path, names, ["2020"] * len(names)), S)


@pytest.mark.parametrize("cls,params", [
    (OrderedForest, {"n_estimators": 10, "min_samples_leaf": 5, "max_features": 2}),
    (BoostedOrdinal, {"iterations": 10, "depth": 3}),
    (ConditionalOrdinalNet, {"hidden_layer_sizes": (8,), "epochs": 60}),
])
def test_probabilities(separable, cls, params):
    m = cls(["x1", "x2"], label="y", classes=[1, 2, 3, 4], **params).fit(separable)
    for r in m.predict(separable, probabilities=True).select("prediction", "probabilities").collect():
        p = r["probabilities"]
        assert all(-1e-12 <= x <= 1 + 1e-12 for x in p)
        if cls is ConditionalOrdinalNet:  # chained P(y > k) never rises
            assert len(p) == 3 and all(a >= b - 1e-12 for a, b in zip(p, p[1:]))
            assert r["prediction"] == 1 + sum(x > 0.5 for x in p)
        else:
            assert len(p) == 4 and abs(sum(p) - 1) < 1e-9 and p[r["prediction"] - 1] == max(p)


def test_forest_is_grown_in_parts_and_all_trees_count(separable, monkeypatch):
    import numpy as np

    from ordinal_spark.models import ordinal

    monkeypatch.setattr(OrderedForest, "TREES_PER_FIT", 4)
    monkeypatch.setattr(OrderedForest, "ROWS_PER_TASK", 600)
    tasks, compact = [], ordinal.compact
    monkeypatch.setattr(ordinal, "compact", lambda *a: tasks.append(compact(*a)) or tasks[-1])
    m = OrderedForest(["x1", "x2"], label="y", classes=[1, 2, 3, 4], n_estimators=10, min_samples_leaf=5, max_features=2)
    m.fit(separable.withColumn("y", (F.rand(7) * 4 + 1).cast("int")).repartition(5))
    assert [[p.getNumTrees for p in parts] for parts in m.models_] == [[4, 4, 2]] * 3
    assert all(t.rdd.getNumPartitions() <= 2 for t in tasks)
    for parts in m.models_:  # parts differ, as trees of one fit do
        assert len({t.toDebugString.partition("\n")[2] for p in parts for t in p.trees}) == 10
    data, probs = m._prob_cols(ordinal.assemble(separable.limit(30), m.features))
    for r in data.select(ordinal.FEAT, *probs).collect():
        for i, parts in enumerate(m.models_):
            assert abs(r[1 + i] - np.mean([t.predict(r[0]) for p in parts for t in p.trees])) < 1e-9
    assert abs(sum(v for _, v in m.importance()) - 1) < 1e-9


def test_boosting_on_points_equals_boosting_on_rows():
    import numpy as np

    from ordinal_spark.models.boosting import boost, log_odds

    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 3, (400, 3)).astype(float)
    y = (x[:, 0] + rnd.normal(0, 1, 400) > 1).astype(float)
    points, back = np.unique(x, axis=0, return_inverse=True)
    n = np.bincount(back.ravel()).astype(float)
    a = boost(x, y, np.ones(400), 30, 0.1, 3, 6.0)
    b = boost(points, np.bincount(back.ravel(), y) / n, n, 30, 0.1, 3, 6.0)
    assert np.allclose(log_odds(a, points), log_odds(b, points), atol=1e-4)
    assert np.mean((log_odds(b, x) > 0) == y) > 0.75


@pytest.mark.parametrize("depth", [0, 3])
def test_boosting_beyond_one_task_equals_boosting_in_one(spark, monkeypatch, depth):
    import numpy as np

    from ordinal_spark.models import boosting as B

    df = spark.range(0, 900).select(((F.col("id") * 7919) % 4 + 1).cast("int").alias("y"), (F.col("id") * 7919 % 4 * 2 + F.floor(F.rand(3) * 5)).alias("x1"),
                                    F.floor(F.rand(5) * 400).alias("x2"), F.lit(1).alias("x3")).repartition(3).cache()
    names = ["x1", "x2", "x3"][2 if depth == 0 else 0:]
    how = (df, names, "y", [1, 2, 3, 4], 4, 0.3, depth, 6.0)
    monkeypatch.setattr(B, "ROUNDS_HELD", 3)
    whole = B.fit_thresholds(*how)
    monkeypatch.setattr(B, "MAX_POINTS", 3 if depth else 0)
    parts = B.fit_thresholds(*how)
    x = np.array(df.select(*names).collect(), float)
    for a, b in zip(whole, parts):
        assert all(np.array_equal(c, d) for c, d in zip(a["cuts"], b["cuts"]))
        assert np.allclose(B.log_odds(a, x), B.log_odds(b, x), atol=1e-3)
        assert np.allclose(a["importance"], b["importance"], atol=1e-3)
    assert len(parts) == 3


def test_boosting_sums_by_cells_without_the_matrix_of_answers(monkeypatch):
    """A round's work follows the features, not points times questions; of
    questions with one gain (a flag and its opposite) the first wins."""
    import numpy as np

    from ordinal_spark.models import boosting as B

    rnd = np.random.default_rng(2)
    x = np.stack([rnd.integers(0, 2, 500), rnd.integers(0, 40, 500), rnd.integers(0, 40, 500), np.zeros(500)], axis=1).astype(float)
    x = np.concatenate([x, 1 - x[:, :1]], axis=1)
    y, w = (x[:, 1] + 9 * x[:, 0] + rnd.normal(0, 5, 500) > 22).astype(float), rnd.random(500) + 0.5
    ask = B.answers(x, cuts := B.borders(x)).astype(float)
    for code, own in (groups := B.grouped(x, cuts)):
        assert len(own) <= B.GROUP_CELLS
    assert np.array_equal(np.concatenate([own[code] for code, own in groups], axis=1), ask) and len(groups) < 4
    monkeypatch.setattr(B, "answers", None)
    model, score = B.boost(x, y, w, 12, 0.3, 3, 6.0), np.zeros(500)
    assert ask.shape[1] - 1 not in model["questions"] and 0 in model["questions"]
    for qs, values in zip(model["questions"], model["leaves"]):
        p = 1 / (1 + np.exp(-score))
        g, h, leaf = w * (y - p), w * p * (1 - p), np.zeros(500, int)
        for q in qs:
            gain = [sum(g[m].sum() ** 2 / (h[m].sum() + 6.0) for i in range(leaf.max() + 1) for m in ((leaf == i) & (a == 0), (leaf == i) & (a == 1))) for a in ask.T]
            assert gain[q] >= max(gain) * (1 - 1e-8)
            leaf = 2 * leaf + ask[:, q].astype(int)
        assert np.allclose(values[leaf], 0.3 * np.bincount(leaf, g, 8)[leaf] / (np.bincount(leaf, h, 8)[leaf] + 6.0))
        score = score + values[leaf]


@pytest.mark.parametrize("depth,iterations", [(0, 3), (3, 7), (4, 9), (6, 4), (10, 2)])
def test_boosted_trees_are_looked_up_together(depth, iterations):
    import numpy as np

    from ordinal_spark.models import boosting as B

    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 9, (700, 4)).astype(float)
    model = B.boost(x, (x.sum(axis=1) + rnd.normal(0, 4, 700) > 16).astype(float), rnd.random(700) + 0.5, iterations, 0.3, depth, 3.0)
    ask, want = B.answers(x, model["cuts"]), np.zeros(700)
    for qs, values in zip(model["questions"], model["leaves"]):
        leaf = np.zeros(700, int)
        for q in qs:
            leaf = 2 * leaf + ask[:, q]
        want += values[leaf]
    assert np.allclose(B.log_odds(model, x), want, rtol=0, atol=1e-12)


def test_boosted_trees_take_less_than_a_gather_for_each_question():
    import timeit

    import numpy as np

    from ordinal_spark.models import boosting as B

    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 9, (10_000, 7)).astype(float)
    cuts = B.borders(x)
    model = {"cuts": cuts, "questions": rnd.integers(0, sum(map(len, cuts)), (400, 4)), "leaves": rnd.random((400, 16))}
    ask = B.answers(x, cuts)

    def plain():
        for qs, values in zip(model["questions"], model["leaves"]):
            leaf = np.zeros(len(x), np.int64)
            for q in qs:
                leaf = 2 * leaf + ask[:, q]
            values[leaf]

    # about a quarter of the time; half is asked for, as other work may run
    assert min(timeit.repeat(lambda: B.log_odds(model, x), number=1, repeat=5)) < 0.6 * min(timeit.repeat(plain, number=1, repeat=5))


def test_class_shares_equal_the_columns(spark):
    import numpy as np

    from ordinal_spark.models import ordinal
    from ordinal_spark.models.boosting import class_shares

    rnd = np.random.default_rng(6)
    above = np.concatenate([np.sort(rnd.random((40, 4)))[:, ::-1], rnd.random((40, 4)), [[0.0] * 4, [1.0] * 4, [0.5] * 4]])
    df = spark.createDataFrame([(i, a) for i, a in enumerate(above.tolist())], "i int, a array<double>")
    df = df.withColumn("p", ordinal.class_probabilities(F.transform("a", lambda p: 1 - p))).withColumn("c", ordinal.likeliest(F.col("p"), [2, 4, 5, 7, 9]))
    got = df.orderBy("i").collect()
    mine = class_shares(above)
    assert np.allclose(mine, [r["p"] for r in got], rtol=0, atol=1e-15)
    assert np.array([2, 4, 5, 7, 9])[mine.argmax(axis=1)].tolist() == [r["c"] for r in got]
