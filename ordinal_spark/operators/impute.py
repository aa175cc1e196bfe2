"""I1 chained-equation imputation of the ordinal target, A16 distribution.

The original runs an iterative imputer whose default estimator is a Bayesian
ridge regression. With one incomplete column (the target, code 0 = unknown)
every round refits the same regression on the same predictors, so the result
is one fit + one prediction:

1. the centred Gram matrix of (X, y) over the observed rows is summed by Spark
   from each partition's p x p products (Arrow batches, NumPy);
2. evidence maximisation (MacKay updates) runs on that p x p matrix on the
   driver - its size depends on the feature count, never on the rows;
3. the prediction is a column expression, clamped at 1 and rounded half to
   even (P9).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clamp_round, col
from ..session import pin_columns


@dataclass
class BayesianRidgeFit:
    features: list[str]
    coef: np.ndarray
    intercept: float
    alpha: float
    lambda_: float
    n_iter: int
    n: int


def _cross_products(centre: Sequence[float]):
    """Per partition the cross products of [1, row - centre], one row a cell:
    they add up over partitions, and the centre keeps their digits."""
    centre = np.asarray(centre, dtype=np.float64)

    def run(batches):
        import pyarrow as pa
        total = np.zeros((len(centre) + 1, len(centre) + 1))
        for b in batches:
            x = np.ones((b.num_rows, len(centre) + 1))
            for i in range(len(centre)):
                x[:, i + 1] = b.column(i).to_numpy(zero_copy_only=False) - centre[i]
            if np.isnan(x).any():
                raise ValueError("a value of the regression is null or NaN")
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])
    return run


def gram_statistics(df: DataFrame, features: Sequence[str], target: str, centre: Sequence[float] | None = None):
    """n, means, and centred cross-product matrix of [features..., target].
    ``centre`` holds values near the means, if known; it saves a pass."""
    cols = [*features, target]
    x = df.select([col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    if centre is None:
        centre = [m or 0.0 for m in x.agg(*[F.avg(c) for c in x.columns]).first()]
    centre = np.asarray(centre, dtype=np.float64)
    cells = x.mapInArrow(_cross_products(centre), "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    total = np.zeros((len(cols) + 1) ** 2)
    for at, value in cells:
        total[at] = value
    total = total.reshape(len(cols) + 1, -1)
    n, sums, about = int(total[0, 0]), total[0, 1:], total[1:, 1:]
    gram = about - np.outer(sums, sums) / max(n, 1)  # centred sums of cross products
    still = np.diag(gram) <= 1e-12 * np.diag(about)   # constant columns
    gram[still, :] = 0.0
    gram[:, still] = 0.0
    return n, centre + sums / max(n, 1), gram


def bayesian_ridge(n: int, gram_xx: np.ndarray, xty: np.ndarray, yty: float,
                   max_iter: int = 300, tol: float = 1e-3,
                   alpha_1: float = 1e-6, alpha_2: float = 1e-6,
                   lambda_1: float = 1e-6, lambda_2: float = 1e-6):
    """Evidence maximisation of a Bayesian ridge on centred sufficient
    statistics (the same updates as the common open-source implementation)."""
    evals, evecs = np.linalg.eigh(gram_xx)
    evals = np.clip(evals, 0.0, None)
    var_y = yty / n
    alpha = 1.0 / (var_y + np.finfo(np.float64).eps)
    lam = 1.0
    proj = evecs.T @ xty

    def coef_rmse(a, l):
        c = evecs @ (proj / (evals + l / a))
        rmse = yty - 2.0 * c @ xty + c @ gram_xx @ c
        return c, max(rmse, 0.0)

    coef_old = None
    it = 0
    for it in range(max_iter):
        coef, rmse = coef_rmse(alpha, lam)
        gamma = np.sum((alpha * evals) / (lam + alpha * evals))
        lam = (gamma + 2 * lambda_1) / (np.sum(coef ** 2) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (rmse + 2 * alpha_2)
        if it != 0 and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef.copy()
    coef, _ = coef_rmse(alpha, lam)
    return coef, alpha, lam, it + 1


def fit_target_model(df: DataFrame, features: Sequence[str], target: str,
                     missing_code: int = 0) -> BayesianRidgeFit:
    obs = df.where(col(target) != missing_code)
    n, mean, gram = gram_statistics(obs, features, target)
    p = len(features)
    coef, a, lam, it = bayesian_ridge(n, gram[:p, :p], gram[:p, p], float(gram[p, p]))
    intercept = float(mean[p] - mean[:p] @ coef)
    return BayesianRidgeFit(list(features), coef, intercept, a, lam, it, n)


def impute_target(df: DataFrame, target: str, features: Sequence[str] | None = None,
                  missing_code: int = 0, min_value: float = 1.0,
                  max_value: float | None = None) -> tuple[DataFrame, BayesianRidgeFit]:
    """Replace ``missing_code`` in ``target`` by the regression prediction
    from every other feature, clamped and rounded half to even (P9). All
    features become doubles, as in the original."""
    feats = list(features) if features is not None else [
        c for c, t in df.dtypes if c != target and t in ("double", "int", "bigint", "float")]
    fit = fit_target_model(df, feats, target, missing_code)
    pred = F.lit(fit.intercept)
    for f, c in zip(feats, fit.coef):
        pred = pred + F.lit(float(c)) * col(f).cast("double")
    t = col(target)
    imputed = F.when(t == missing_code, clamp_round(pred, min_value, max_value)).otherwise(t.cast("int"))
    out = df.withColumns({f: col(f).cast("double") for f in feats})
    return out.withColumn(target, imputed), fit


PIN_ROUNDS = 5   # of chained equations


@dataclass
class ChainedFit:
    fits: dict[str, BayesianRidgeFit]   # of the last round
    rounds: int
    change: float                       # largest change of the last round
    converged: bool


def impute_columns(df: DataFrame, columns: Sequence[str], features: Sequence[str], rounds: int = 10, tol: float = 1e-3,
                   min_value: float | None = None, max_value: float | None = None) -> tuple[DataFrame, ChainedFit]:
    """I1 with several incomplete columns: chained equations.

    Nulls of ``columns`` start as the column's mean. In each round every
    incomplete column, the one with the fewest nulls first, is regressed on all
    others as they are now (over the rows that have it), and its nulls become
    the predictions, clamped. The rounds end when no value changes by ``tol``
    times the largest observed magnitude, or after ``rounds``. ``features`` are
    complete. All become doubles. The rows are pinned once; a regression is one
    pass over their columns. A round's predictions are expressions, which are
    pinned every ``PIN_ROUNDS`` rounds, so plans stay short. A column without any
    value stays null and takes no part.
    """
    cols, feats = list(columns), list(features)
    every = [*feats, *cols]
    df = pin_columns(df, "imputation")
    stats = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.avg(col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(feats)],
                   F.greatest(F.lit(0.0), *[F.max(F.abs(col(c).cast("double"))) for c in every]).alias("top")).first()
    start = {c: stats[f"m{i}"] for i, c in enumerate(cols)}
    order = sorted((i for i, c in enumerate(cols) if stats[f"n{i}"] and start[c] is not None), key=lambda i: (stats[f"n{i}"], i))
    live = [c for c in cols if start[c] is not None]
    near = {**start, **{c: stats[f"f{i}"] for i, c in enumerate(feats)}}
    work = {c: f"_filled_{i}" for i, c in enumerate(cols)}
    state = df.withColumns({f: col(f).cast("double") for f in feats})
    state = state.withColumns({work[c]: F.coalesce(col(c).cast("double"), F.lit(start[c])) for c in live})
    fits: dict[str, BayesianRidgeFit] = {}
    done, change, limit = 0, 0.0, tol * float(stats["top"] or 0.0)
    while order and done < rounds:
        old = {c: f"_old_{i}" for i, c in enumerate(cols)}
        state = state.withColumns({old[cols[i]]: F.col(work[cols[i]]) for i in order})
        for i in order:
            c = cols[i]
            others = [*feats, *[work[o] for o in live if o != c]]
            seen = state.where(col(c).isNotNull()).select(*[col(o) for o in others], col(c).cast("double").alias("_target"))
            n, mean, gram = gram_statistics(seen, others, "_target", [near[o] for o in [*feats, *[o for o in live if o != c], c]])
            p = len(others)
            coef, a, lam, it = bayesian_ridge(n, gram[:p, :p], gram[:p, p], float(gram[p, p]))
            fit = BayesianRidgeFit(others, coef, float(mean[p] - mean[:p] @ coef), a, lam, it, n)
            pred = F.lit(fit.intercept)
            for o, w in zip(others, coef):
                pred = pred + F.lit(float(w)) * col(o)
            if min_value is not None:
                pred = F.greatest(pred, F.lit(float(min_value)))
            if max_value is not None:
                pred = F.least(pred, F.lit(float(max_value)))
            state = state.withColumn(work[c], F.when(col(c).isNull(), pred).otherwise(col(c).cast("double")))
            fits[c] = fit
        done += 1
        if done % PIN_ROUNDS == 0:
            state = pin_columns(state, "imputation")
        change = state.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(work[cols[i]]) - F.col(old[cols[i]]))) for i in order])).first()[0]
        state = state.drop(*[old[cols[i]] for i in order])
        if change < limit:
            break
    out = state.withColumns({c: F.col(work[c]) for c in live}).drop(*work.values())
    return out.select(*df.columns), ChainedFit(fits, done, float(change or 0.0), not order or change < limit)


def imputation_distribution(before: DataFrame, after: DataFrame, key: str, target: str,
                            missing_code: int = 0) -> DataFrame:
    """Per stage (before/after) and value, count and density over the
    integer bins, the total, the unknown count and the mean (the 'before'
    mean leaves the unknown code out)."""
    b = before.select(col(key), col(target).cast("int").alias("v"), F.lit("before").alias("stage"))
    a = after.select(col(key), col(target).cast("int").alias("v"), F.lit("after").alias("stage"))
    both = b.unionByName(a)
    per = both.groupBy("stage", "v").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    summ = both.groupBy("stage").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(F.col("v") == missing_code).cast("bigint").alias("unknown"),
        F.avg(F.when((F.col("stage") == "after") | (F.col("v") != missing_code), F.col("v")))
        .alias("mean"))
    return (per.join(summ, "stage").withColumn("density", F.col("n") / F.col("total"))
            .withColumnRenamed("v", "value"))
