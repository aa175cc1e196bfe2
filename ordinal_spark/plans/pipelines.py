"""Composite pipelines X1-X6: the public API a user of the original calls."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.ordinal import (BoostedOrdinal, ConditionalOrdinalNet, OrderedForest,
                              OrdinalLogistic)
from ..operators import encode as enc
from ..operators import entity, impute, missing, profile, quality, tuning
from ..operators import metrics as M
from ..operators.encode import DummySpec, UnknownDecision
from ..operators.impute import BayesianRidgeFit
from ..schema import (GRID_BOOSTED, GRID_NEURAL, GRID_ORDERED_FOREST, GRID_ORDINAL_LOGISTIC,
                      SeveritySchema)
from ..session import cut_lineage


@dataclass
class Prepared:
    data: DataFrame
    dummies: list[DummySpec] = field(default_factory=list)
    unknown_steps: list[UnknownDecision] = field(default_factory=list)
    impute_fit: BayesianRidgeFit | None = None

    def features(self, s: SeveritySchema) -> list[str]:
        return [c for c in self.data.columns if c not in (s.ref, s.target, "raw_score")]


def load_levels(raw: DataFrame, s: SeveritySchema, validate: bool = True) -> dict[str, list[str]]:
    """One job over the raw table: V1/V2 validation (raises like the original)
    and the level lists of the category columns as fixed at load."""
    inv = quality.domain_inventory(raw, s).cache()
    if validate:
        bad = quality.describe_violations(inv)
        if bad:
            raise ValueError("\n".join(bad))
    cats = [c for c in s.dummies if c in s.categories]
    valid = (inv.where(F.col("is_valid") & F.col("column").isin(*cats))
             .select("column", "value").collect())  # bounded by the declared domains
    inv.unpersist()
    out: dict[str, list[str]] = {c: [] for c in cats}
    for r in valid:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def minimal_preprocess(raw: DataFrame, s: SeveritySchema, validate: bool = True) -> DataFrame:
    """Validation + reference split (rows kept)."""
    load_levels(raw, s, validate)
    return entity.split_references(raw, s)


def check_unique(cons: DataFrame, s: SeveritySchema) -> None:
    """V3 and Q1: raise if an incident id stands for several incidents."""
    bad = quality.fd_violations(cons, s.ref, [s.year, s.period, *s.split_fields]).collect()
    twice = (cons.groupBy(s.ref).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .agg(F.count(F.lit(1)).alias("n"), F.min(s.ref).alias("first")).first())
    if bad or twice["n"]:
        columns = ", ".join(f"{r['column']} ({r['n_bad_keys']} ids)" for r in bad)
        raise ValueError(f"{twice['n']} incident ids stand for several incidents, e.g. {twice['first']!r}; varying: {columns or 'nothing else'}")


def preprocess(raw: DataFrame, s: SeveritySchema, encode: bool = True, impute_missing: bool = True,
               validate: bool = True, threshold: float = 0.05, pin: bool = True,
               handle_imbalance: bool = False, keep_raw_score: bool = False) -> Prepared:
    """V1/V2 -> W1 -> A1 (+P5) -> V3 -> F1 -> P6 -> P3/P2 -> I1 [-> R7].

    ``impute_missing`` without ``encode`` is rejected (the original silently
    did neither), and so is ``handle_imbalance``. Actions: the
    validation/level job, the id check, the F1 mask counts, the dummy level
    check and the imputation statistics - all small results.
    """
    if handle_imbalance and not encode:
        raise ValueError("rebalancing needs encoded variables (encode=True)")
    if impute_missing and not encode:
        raise ValueError("imputation needs encoded variables (encode=True)")
    if validate:
        missing_cols = [c for c in s.raw_columns if c not in raw.columns]
        if missing_cols:
            raise ValueError(f"Missing required columns: {missing_cols}")
    levels = load_levels(raw, s, validate)
    cons = entity.consolidate(raw, s, pin=pin)
    if validate:
        check_unique(cons, s)
    cleaned, steps = enc.drop_low_share_unknowns(cons, s.incident_categories, s.unknown_labels,
                                                 threshold)
    out = enc.years_since_start(cleaned, s)
    if not keep_raw_score:
        out = out.drop("raw_score")
    specs: list[DummySpec] = []
    fit = None
    if encode:
        out, specs = enc.encode(out, s, levels)
        if impute_missing:
            feats = [c for c in out.columns if c not in (s.ref, s.target)]
            out, fit = impute.impute_target(out, s.target, feats)
        if handle_imbalance:
            from ..operators.smote import rebalance
            out = rebalance(out, s.target, s.ref, s.score_col, specs)
    return Prepared(out, specs, steps, fit)


def profile_report(raw: DataFrame, s: SeveritySchema) -> dict[str, DataFrame]:
    """The exploratory profile of the split report rows. The reports and
    the split rows are evaluated once each; all tables read the pinned rows."""
    sp = cut_lineage(minimal_preprocess(cut_lineage(raw), s))
    return {
        "key_uniqueness": profile.key_uniqueness(sp, s.ref),
        "records_per_key": entity.records_per_key(sp, s.ref),
        "varying_attributes": entity.varying_attributes(sp, s.ref),
        "missing_profile": profile.missing_profile(sp),
        "categorical_profile": profile.categorical_profile(sp, list(s.categories)),
        "numeric_profile": profile.numeric_profile(sp, [s.ref, s.year, s.period]),
    }


def missing_report(raw: DataFrame, s: SeveritySchema) -> dict[str, DataFrame]:
    """Missingness of the target against time and the other categories.
    The reports are evaluated once, and so are the cleaned incidents, which the
    encoded ones are made from."""
    raw = cut_lineage(raw)
    data = cut_lineage(preprocess(raw, s, encode=False, impute_missing=False).data)
    ind = f"{s.target}_missing"
    mb = enc.unknown_indicator(data, s.target, ["Unknown"])
    cats = [c for c in s.incident_categories if c != s.target]
    cont = cut_lineage(missing.contingency(mb, cats, ind))
    encoded, _ = enc.encode(data, s, load_levels(raw, s, validate=False))
    e = encoded.withColumn("_ind", (F.col(s.target) == 0).cast("double"))
    feats = [c for c in encoded.columns if c not in (s.ref, s.target, "raw_score")]
    chi = missing.chi_square(cont)
    return {
        "null_patterns": profile.null_patterns(mb),
        "missing_by_year": missing.missing_by_group(mb, s.years_col, s.target),
        "year_correlation": missing.correlation(mb, s.years_col, ind),
        "year_by_missingness": missing.five_numbers(mb, s.years_col, ind),
        "contingency": cont,
        "chi_square": chi.withColumn("p_value", missing.chi2_pvalue("chi2", "dof")),
        "missing_by_category": profile.in_order(missing.missing_by_category(cont), ["column"], [F.desc("missing_pct"), F.asc("category")]),
        "point_biserial": missing.point_biserial(e, feats, "_ind"),
    }


# Tuned configuration of the original comparison run (fixed values).
REFERENCE_CONFIG = {
    "ordinal_logistic": {"alpha": 1.0},
    "ordered_forest": {"n_estimators": 100, "min_samples_leaf": 10, "max_features": 10},
    "boosted_ordinal": {"iterations": 2000, "learning_rate": 0.1, "depth": 4, "l2_leaf_reg": 6},
    "conditional_ordinal_net": {"hidden_layer_sizes": (64, 32), "epochs": 100},
}
MODEL_CLASSES = {"ordinal_logistic": OrdinalLogistic, "ordered_forest": OrderedForest,
                 "boosted_ordinal": BoostedOrdinal,
                 "conditional_ordinal_net": ConditionalOrdinalNet}
DEFAULT_GRIDS = {"ordinal_logistic": GRID_ORDINAL_LOGISTIC, "ordered_forest": GRID_ORDERED_FOREST,
                 "boosted_ordinal": GRID_BOOSTED,
                 # l-bfgs has no step or batch size (see M3)
                 "conditional_ordinal_net": {k: v for k, v in GRID_NEURAL.items() if k not in ("lr", "batch_size")}}


def candidates(features: Sequence[str], label: str, configs: Mapping[str, Sequence[Mapping]],
               classes: Sequence[int]) -> list[tuning.Candidate]:
    out = []
    for name, plist in configs.items():
        cls = MODEL_CLASSES[name]
        for p in plist:
            def factory(cls=cls, p=dict(p)):
                return cls(features, label=label, classes=classes, **p)
            out.append(tuning.Candidate(name, tuning.params_id(p), factory, cls.resample))
    return out


def fold_resampler(prep: Prepared, s: SeveritySchema, **kw) -> Callable[[DataFrame], DataFrame]:
    """R6 for training folds, with the dummy metadata of this preparation."""
    from ..operators.smote import resample_training

    def run(train: DataFrame) -> DataFrame:
        return resample_training(train, s.target, s.ref, s.score_col, prep.dummies, **kw)
    return run


def class_levels(df: DataFrame, label: str) -> list[int]:
    return sorted(r[0] for r in df.select(label).distinct().collect())  # K values


def run_comparison(raw: DataFrame, s: SeveritySchema,
                   configs: Mapping[str, Mapping] | None = None, k: int = 5, seed: int = 42,
                   resampler: Callable[[DataFrame], DataFrame] | None = None,
                   parallelism: int = 4, resample: bool = True, ledger: str | None = None) -> dict[str, DataFrame]:
    """Preprocess, cross-validate the four models, report E9-E13."""
    prep = preprocess(raw, s)
    if resampler is None and resample:
        resampler = fold_resampler(prep, s)
    data = cut_lineage(prep.data)
    feats = prep.features(s)
    classes = class_levels(data, s.target)
    cfg = {n: [p] for n, p in (configs or REFERENCE_CONFIG).items()}
    cv = tuning.cross_validate(data, s.ref, s.target, candidates(feats, s.target, cfg, classes),
                               k=k, seed=seed, resampler=resampler, parallelism=parallelism,
                               permutation=True, ledger=ledger)
    long = M.long_scores(cv.scores, keys=("model", "params_id", "fold"))
    summ = M.cv_summary(long)
    out = {"scores": cv.scores, "summary": summ, "best_model": M.best_model(summ),
           "error_distribution": M.error_distribution(cv.predictions),
           "mean_confusion": M.mean_confusion(M.confusion(cv.predictions,
                                                          keys=("model", "params_id", "fold"))),
           "failures": tuning.failure_table(cv, raw.sparkSession)}
    if cv.importances is not None:
        out["importance"] = tuning.importance_table(cv.importances)
    return out


def tune_all(raw: DataFrame, s: SeveritySchema, grids: Mapping[str, Mapping] | None = None,
             metric: str = "weighted_mae", k: int = 5, seed: int = 42,
             resampler: Callable[[DataFrame], DataFrame] | None = None,
             parallelism: int = 4, resample: bool = True, ledger: str | None = None) -> dict[str, DataFrame]:
    """Grid search of every model; best parameters by ``metric``. With a
    ``ledger`` folder a run that was lost goes on where it ended."""
    prep = preprocess(raw, s)
    if resampler is None and resample:
        resampler = fold_resampler(prep, s)
    data = cut_lineage(prep.data)
    feats = prep.features(s)
    classes = class_levels(data, s.target)
    cfg = {n: tuning.grid(g) for n, g in (grids or DEFAULT_GRIDS).items()}
    cv = tuning.cross_validate(data, s.ref, s.target, candidates(feats, s.target, cfg, classes),
                               k=k, seed=seed, resampler=resampler, parallelism=parallelism,
                               with_train=False, ledger=ledger)
    summ = tuning.tuning_summary(cv, metric)
    conf = M.confusion(cv.predictions, keys=("model", "params_id", "fold"))
    return {"summary": summ, "best_params": tuning.best_params(summ, metric),
            "logistic_band": tuning.logistic_band(summ),
            "boosted_pivot": tuning.boosted_pivot(summ),
            "net_by_architecture": tuning.net_by_architecture(summ),
            "forest_pivot": tuning.forest_pivot(summ),
            "confusion": conf, "mean_confusion": M.mean_confusion(conf), "failures": tuning.failure_table(cv, raw.sparkSession)}
