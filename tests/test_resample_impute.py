"""Resampling, SMOTE-NC and imputation invariants (the 'I' operators)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ordinal_spark.operators import impute, quality, resample, smote
from ordinal_spark.operators.encode import dummy_decode_all
from ordinal_spark.plans import pipelines as P
from ordinal_spark.schema import FIXTURE_SCHEMA as S
from ordinal_spark.sources.fixtures import incident_reports


@pytest.fixture(scope="module")
def prepared(spark):
    return P.preprocess(incident_reports(spark, SF_SMALL), S)


def brute_knn(points, k, cats):
    """Exact k nearest rows for every point by full comparison (test only)."""
    out = {}
    for y in {p["_y"] for p in points}:
        pts = [p for p in points if p["_y"] == y]
        for a in pts:
            cand = []
            for b in pts:
                mult = b["_m"] - 1 if b["_pid"] == a["_pid"] else b["_m"]
                if mult <= 0:
                    continue
                h = sum(a[c] != b[c] for c in cats)
                cand.append(((a["_s"] - b["_s"]) ** 2 + a["_med"] ** 2 * h, b["_pid"], mult))
            cand.sort()
            slots = []
            for d2, pid, m in cand:
                slots += [pid] * m
                if len(slots) >= k:
                    break
            out[(y, a["_pid"])] = slots[:k]
    return out


def test_nearest_points_exact(spark, prepared):
    dec = dummy_decode_all(prepared.data, prepared.dummies)
    cats = [c for c in dec.columns if c not in (S.ref, S.target, S.score_col)]
    pts, slots = smote.nearest_points(dec, S.target, S.score_col, cats, 5, [1, 6])
    got = {}
    for r in slots.orderBy("slot").collect():
        got.setdefault((r["_y"], r["_pid"]), []).append(r["_nb"])
    want = brute_knn([r.asDict() for r in pts.collect()], 5, cats)
    assert got == want


def test_resample_counts_and_ranges(spark, prepared):
    d = prepared.data
    plan = {r["class"]: r for r in resample.sampling_plan(d, S.target).collect()}
    out = smote.resample_training(d, S.target, S.ref, S.score_col, prepared.dummies).cache()
    counts = {r[0]: r[1] for r in out.groupBy(S.target).count().collect()}
    for c, r in plan.items():
        assert counts[c] == r["over_target"]
    # originals kept (every non-synthetic id comes from the input)
    orig = {r[0] for r in d.select(S.ref).collect()}
    kept = {r[0] for r in out.where(~F.col(S.ref).startswith("syn|")).select(S.ref).collect()}
    assert kept <= orig
    # synthetic scores lie inside their class range
    rng = {r[0]: (r[1], r[2]) for r in d.groupBy(S.target).agg(
        F.min(S.score_col), F.max(S.score_col)).collect()}
    for r in out.where(F.col(S.ref).startswith("syn|")).select(S.target, S.score_col).collect():
        lo, hi = rng[r[0]]
        assert lo - 1e-9 <= r[1] <= hi + 1e-9
    # dummies stay 0/1 and no new levels appear (V4/V5)
    dummies = [c for sp in prepared.dummies for c in sp.columns]
    others = [c for c in d.columns if c not in dummies and c not in (S.ref, S.score_col)]
    assert quality.feature_preservation(d, out, dummies, others).count() == 0
    # deterministic
    again = smote.resample_training(d, S.target, S.ref, S.score_col, prepared.dummies)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_undersample_exact(spark, prepared):
    d = prepared.data
    plan = resample.sampling_plan(d, S.target)
    u = resample.undersample(d, S.target, S.ref, plan)
    want = {r["class"]: r["under_target"] for r in plan.collect()}
    got = {r[0]: r[1] for r in u.groupBy(S.target).count().collect()}
    assert got == want


def sklearn_like_bayesian_ridge(X, y, max_iter=300, tol=1e-3):
    """Direct re-statement on the raw matrix (SVD of centred X)."""
    Xc, yc = X - X.mean(0), y - y.mean()
    n = len(y)
    U, Sv, Vh = np.linalg.svd(Xc, full_matrices=False)
    ev = Sv ** 2
    alpha, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0
    xty = Xc.T @ yc
    old = None
    for it in range(max_iter):
        coef = Vh.T @ (Vh / (ev + lam / alpha)[:, None]) @ xty
        rmse = np.sum((yc - Xc @ coef) ** 2)
        gamma = np.sum(alpha * ev / (lam + alpha * ev))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        alpha = (n - gamma + 2e-6) / (rmse + 2e-6)
        if it and np.sum(np.abs(old - coef)) < tol:
            break
        old = coef.copy()
    coef = Vh.T @ (Vh / (ev + lam / alpha)[:, None]) @ xty
    return coef, y.mean() - X.mean(0) @ coef


def test_imputation_matches_direct_fit(spark):
    prep = P.preprocess(incident_reports(spark, SF_SMALL), S, impute_missing=False)
    d = prep.data
    feats = [c for c in d.columns if c not in (S.ref, S.target)]
    fit = impute.fit_target_model(d, feats, S.target)
    obs = d.where(F.col(S.target) != 0).select(*feats, S.target).toPandas().astype(float)
    coef, b0 = sklearn_like_bayesian_ridge(obs[feats].to_numpy(), obs[S.target].to_numpy())
    assert np.allclose(fit.coef, coef, atol=1e-6)
    assert abs(fit.intercept - b0) < 1e-6
    out, _ = impute.impute_target(d, S.target, feats)
    joined = out.alias("o").join(d.alias("i"), S.ref)
    rows = joined.select(F.col(f"o.{S.target}").alias("a"), F.col(f"i.{S.target}").alias("b")).collect()
    assert all(r["a"] >= 1 for r in rows)
    assert all(r["a"] == r["b"] for r in rows if r["b"] != 0)


def test_bround_is_half_even(spark):
    from ordinal_spark.functions import clamp_round
    got = spark.createDataFrame([(0.2,), (1.5,), (2.5,), (3.5,)], "x double").select(
        clamp_round(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == [1, 2, 2, 4]


def test_chi2_pvalue_reference_points(spark):
    from ordinal_spark.operators.missing import chi2_pvalue
    points = [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (1.0, 2, np.exp(-0.5)), (0.0, 3, 1.0), (7.814727903251179, 3, 0.05),
              (10.827566170662733, 1, 0.001), (124.3421134004094, 100, 0.05), (123.22522145336181, 99, 0.05)]
    df = spark.createDataFrame([(x, k, float(p)) for x, k, p in points], "x double, k int, p double")
    assert all(abs(r["q"] - r["p"]) < 1e-9 for r in df.withColumn("q", chi2_pvalue("x", "k")).collect())
    tiny = spark.createDataFrame([(800.0, 1), (None, 1), (1.0, 0)], "x double, k int").select(chi2_pvalue("x", "k").alias("q")).collect()
    assert 0 < tiny[0]["q"] < 1e-170 and tiny[1]["q"] is None and tiny[2]["q"] is None


def chained(M, missing, order, rounds=10, tol=1e-3, low=None):
    """Chained equations on a matrix, column by column (test only)."""
    X = M.copy()
    for j in order:
        X[missing[:, j], j] = M[~missing[:, j], j].mean()
    limit = tol * np.abs(M[~missing]).max()
    for r in range(1, rounds + 1):
        old = X.copy()
        for j in order:
            seen, rest = ~missing[:, j], [c for c in range(M.shape[1]) if c != j]
            coef, b0 = sklearn_like_bayesian_ridge(X[seen][:, rest], M[seen, j])
            pred = X[missing[:, j]][:, rest] @ coef + b0
            X[missing[:, j], j] = pred if low is None else np.maximum(pred, low)
        if np.abs(X - old).max() < limit:
            break
    return X, r


def test_chained_imputation_of_two_columns(spark):
    rnd = np.random.default_rng(8)
    n = 400
    a, b = rnd.normal(3, 1, n), rnd.normal(0, 2, n)
    M = np.stack([a, b, 2 * a - b + rnd.normal(0, 0.3, n), a + 0.5 * b + rnd.normal(0, 0.3, n)], axis=1)
    missing = np.zeros_like(M, bool)
    missing[:, 2] = rnd.random(n) < 0.3
    missing[:, 3] = rnd.random(n) < 0.15
    want, rounds = chained(M, missing, [3, 2], low=1.0)
    rows = [(i, *[None if m else float(x) for x, m in zip(M[i], missing[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, z double").repartition(3)
    out, fit = impute.impute_columns(df, ["y", "z"], ["a", "b"], min_value=1.0)
    got = np.array([r[1:] for r in sorted(map(tuple, out.collect()))])
    assert fit.rounds == rounds > 1 and fit.converged and out.columns == df.columns
    assert np.allclose(got, want, atol=1e-6)
    same, none = impute.impute_columns(df.select("id", "a", "b"), ["b"], ["a"])
    assert none.rounds == 0 and none.converged and same.count() == n
    empty, fit = impute.impute_columns(df.withColumn("y", F.lit(None).cast("double")), ["y", "z"], ["a", "b"])
    assert empty.where("y is not null or z is null").count() == 0 and set(fit.fits) == {"z"}


def test_chained_imputation_reads_its_rows_once(spark):
    """Rounds go over pinned rows: what made them runs once, however many rounds."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    rnd = np.random.default_rng(3)
    M = rnd.normal(5, 1, (200, 3)) + 1e6
    M[:, 2] += M[:, 0] - 1e6
    rows = [(float(a), float(b) if i % 4 else None, float(c) if i % 5 else None) for i, (a, b, c) in enumerate(M)]
    schema = "a double, y double, z double"
    df = spark.createDataFrame(rows, schema).repartition(3).mapInArrow(counted, schema)
    for pinned in (1, 5):  # the same rows, whatever rounds are pinned
        impute.PIN_ROUNDS, before = pinned, runs.value
        out, fit = impute.impute_columns(df, ["y", "z"], ["a"], rounds=3, tol=0.0)
        got = sorted(map(tuple, out.collect()))
        assert fit.rounds == 3 and runs.value - before == 200
        assert pinned == 1 or np.allclose(got, first, rtol=1e-12)
        first = got
    n, mean, gram = impute.gram_statistics(df.where("y is not null and z is not null").withColumn("one", F.lit(7.1)), ["a", "one", "y"], "z")
    full = np.array([r for r in rows if None not in r])
    full = np.insert(full, 1, 7.1, axis=1)
    assert n == len(full) and np.allclose(mean, full.mean(0), rtol=1e-12)
    assert np.allclose(gram, (full - full.mean(0)).T @ (full - full.mean(0)), rtol=1e-7, atol=1e-6)
    assert not gram[1].any() and not gram[:, 1].any()


def test_quantiles_by_counting_passes(spark):
    from ordinal_spark.operators.quantiles import quantiles
    rnd = np.random.default_rng(9)
    keys = {"wide": np.exp(rnd.normal(0, 40, 3000)), "ties": rnd.integers(0, 4, 3001).astype(float), "one": np.array([7.5]),
            "two": np.array([-1.0, 2.0]), "far": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324])}
    rows = [(k, float(x)) for k, v in keys.items() for x in v]
    rows += [("wide", None), ("wide", float("nan")), ("wide", float("inf")), ("none", None), ("none", float("nan"))]
    ps = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["key"]: r["values"] for r in quantiles(spark.createDataFrame(rows, "key string, value double"), ps).collect()}
    assert set(got) == set(keys)
    for k, v in keys.items():
        if k != "far":
            assert np.allclose(got[k], np.quantile(v, ps), rtol=1e-12)
    assert got["far"][0] == -1.7e308 and got["far"][2] == 0.0 and got["far"][4] == 1.7e308


def test_impute_without_encode_rejected(spark):
    with pytest.raises(ValueError):
        P.preprocess(incident_reports(spark, SF_SMALL), S, encode=False, impute_missing=True)


def test_invalid_domain_raises(spark):
    raw = incident_reports(spark, SF_SMALL).withColumn(
        "sector", F.when(F.col("sector") == "BUILDING", F.lit("Spaceport")).otherwise(F.col("sector")))
    with pytest.raises(ValueError, match="Spaceport"):
        P.load_levels(raw, S)


def test_low_share_filter_is_sequential(spark):
    from ordinal_spark.operators.encode import drop_low_share_unknowns, low_share_unknown_plan
    # a: 4 % unknown -> dropped. b: 8 % on the full table (kept if shares were
    # computed independently) but 4/96 after a's rows are gone -> dropped.
    rows = [("Unknown", "Unknown")] * 4 + [("x", "Unknown")] * 4 + [("x", "y")] * 92
    df = spark.createDataFrame(rows, "a string, b string")
    plan = low_share_unknown_plan(df, ["a", "b"])
    assert [p.dropped for p in plan] == [True, True]
    assert abs(plan[1].share - 4 / 96) < 1e-12
    assert [p.rows_after for p in plan] == [96, 92]
    out, _ = drop_low_share_unknowns(df, ["a", "b"])
    assert out.count() == 92


def test_rebalance_gate(spark, prepared):
    # ratio <= 3: the input is returned untouched
    bal = spark.range(0, 90).select(F.col("id").cast("string").alias(S.ref),
                                    ((F.col("id") % 3) + 1).cast("int").alias(S.target),
                                    F.rand(1).alias(S.score_col))
    assert smote.rebalance(bal, S.target, S.ref, S.score_col, []) is bal
    # the fixture is imbalanced (> 3): it is resampled to the plan
    d = prepared.data
    out = smote.rebalance(d, S.target, S.ref, S.score_col, prepared.dummies)
    plan = {r["class"]: r["over_target"] for r in resample.sampling_plan(d, S.target).collect()}
    got = {r[0]: r[1] for r in out.groupBy(S.target).count().collect()}
    assert got == plan


def test_neighbour_rings_broadcast_no_points(spark):
    """Points multiplied by choices of features do not pass the driver, however
    small the estimate of their size."""
    rows = spark.range(200).selectExpr("1 as y", "cast(id % 17 as double) as s", "id % 3 as a", "id % 5 as b", "id % 2 as c")
    sig = smote.Signatures(rows, ["a", "b", "c"])
    points = smote.points_of(rows, "y", "s", sig)
    open_ = points.select("_y", "_s", *sig.words, F.lit(1.0).alias("_med"), F.lit(None).cast("double").alias("_ub"))
    for ring in range(3):
        plan = smote._ring(points, open_, sig, ring, 5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_modes_and_scores_come_with_a_points_neighbours(spark):
    """One row for each point: its neighbour rows' values, of which the most
    frequent and then the smallest in text order counts, and their scores."""
    rows = spark.createDataFrame([(1, 0.0, 9, "a", 0), (1, 1.0, 10, "b", 0), (1, 2.0, 10, None, 0), (1, 3.0, 9, "b", 0), (1, 5.0, 9, "a", 0)], "y int, s double, g int, h string, n int")
    sig = smote.Signatures(rows, ["g", "h", "n"])
    held = rows.select("*", *sig.columns()).agg(F.collect_list(F.struct(*sig.words, "s")).alias("r"))
    got = held.select(*[sig.texts(i, "r").alias(f"v{i}") for i in range(3)]).select("*", *[smote.most_frequent(f"v{i}").alias(f"m{i}") for i in range(3)]).first()
    assert sorted(got["v0"]) == ["10", "10", "9", "9", "9"] and (got["m0"], got["m1"], got["m2"]) == ("9", "a", "0")
    tied = spark.sql("select array('9', '10', '10', '9', null) as v, array('b', null, null, 'b') as w")
    assert tuple(tied.select(smote.most_frequent("v"), smote.most_frequent("w")).first()) == ("10", None)
    _, near = smote.nearest_lists(rows, "y", "s", ["g", "h", "n"], 2)
    assert near.count() == 5 and {len(r["_near"]) for r in near.collect()} == {2}


def test_undersampled_rows_are_made_once(spark, prepared, monkeypatch):
    """Every pass of a resampling reads the written rows, not their sorting and
    counting anew."""
    pinned = []
    monkeypatch.setattr(smote, "pin_columns", lambda df, name, pin=smote.pin_columns: pinned.append(name) or pin(df, name))
    out = smote.resample_training(prepared.data, S.target, S.ref, S.score_col, prepared.dummies)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert pinned[0] == "undersampled" and "ring" in pinned
    assert plan.count("row_number()") == 1  # base rows inside their class only

    def spreads(rows):  # not a digit goes by how rows lie
        points = smote.nearest_lists(rows, S.target, S.score_col, ["time_to_report"])[0]
        return sorted(map(tuple, points.select("_y", "_med").distinct().collect()))

    assert spreads(prepared.data.repartition(3, F.md5(S.ref))) == spreads(prepared.data.repartition(11, S.ref))
