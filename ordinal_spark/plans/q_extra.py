"""Operators that other queries only use inside: source and sink round trip,
label places, rounding, chained probabilities, the imbalance gate, feature
checks and the tuning report tables, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clamp_round
from ..models.ordinal import ConditionalOrdinalNet
from ..operators import encode as enc
from ..operators import profile, quality, smote, tuning
from ..operators import metrics as M
from ..session import shared_folder
from ..sources.io import load_reports, write_table
from . import common as C
from . import oracle_sql as O
from . import pipelines as P
from . import q_analysis as A
from .registry import register

S = C.S
CLASSES = [1, 2, 3, 4, 5, 6]
HEX = "0123456789abcdef"


@register("csv_round_trip", O.with_(O.INCIDENTS) + "\nSELECT " + ", ".join(S.raw_columns) + " FROM incidents")
def q_csv_round_trip(spark, sf):
    """S2 then S1: the reports written as CSV and read with declared types."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_table(C.reports(spark, sf).select(*S.raw_columns), path, fmt="csv")
    return load_reports(spark, path, S).select(*S.raw_columns)


@register("parquet_round_trip", O.with_(O.INCIDENTS) + "\nSELECT " + ", ".join(S.raw_columns) + " FROM incidents")
def q_parquet_round_trip(spark, sf):
    """S2 as Parquet by year, then S1."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_table(C.reports(spark, sf).select(*S.raw_columns), path, [S.year])
    return load_reports(spark, path, S, fmt="parquet").select(*S.raw_columns)


@register("minimal_rows", O.with_(O.INCIDENTS, O.RANKED, O.SPLIT) + """
SELECT ref, year, quarter, data_subject_type, data_type, decision_taken, incident_type, no_affected, sector, time_to_report FROM split""")
def q_minimal(spark, sf):
    """Validated report rows with split references."""
    names = [S.ref, S.year, S.period, "data_subject_type", "data_type", *S.split_fields]
    return P.minimal_preprocess(C.reports(spark, sf), S).select(*names)


@register("label_places", O.with_(A.P_BASE) + """
SELECT ref, y_true, y_true - 1 AS place, y_true AS label, CASE WHEN y_pred IN (2, 4, 6) THEN CAST(y_pred / 2 - 1 AS INT) END AS even_place
FROM pseudo WHERE model = 'm2'""")
def q_label_places(spark, sf):
    """P10: labels to places and back; labels outside the list have none."""
    pred = A.pseudo_predictions(spark, sf).where("model = 'm2'")
    place = enc.class_index(F.col("y_true"), CLASSES)
    return pred.select(S.ref, "y_true", place.alias("place"), enc.class_label(place, CLASSES).alias("label"),
                       enc.class_index(F.col("y_pred"), [2, 4, 6]).alias("even_place"))


@register("rounded_scores", O.with_(O.BASE) + """
SELECT ref, CAST(round_even(least(greatest(raw_score / 2.0, 1.0), 9.0), 0) AS INT) AS rounded FROM consolidated""")
def q_rounded(spark, sf):
    """Half scores clamped to 1..9 and rounded half to even."""
    return C.consolidated(spark, sf).select(S.ref, clamp_round(F.col("raw_score") / 2, 1.0, 9.0).alias("rounded"))


_DIGITS = ", ".join(f"(strpos('{HEX}', substr(md5(ref), {i}, 1)) - 1) / 15.0 AS p{i}" for i in range(1, 6))


@register("chained_probabilities", O.with_(O.BASE, f"d AS (SELECT ref, {_DIGITS} FROM consolidated)",
                                           "c AS (SELECT ref, p1 AS c1, p1*p2 AS c2, p1*p2*p3 AS c3, p1*p2*p3*p4 AS c4, p1*p2*p3*p4*p5 AS c5 FROM d)") + """
SELECT ref, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c4, 6) AS c4, round(c5, 6) AS c5,
       CAST(1 + (c1 > 0.5)::INT + (c2 > 0.5)::INT + (c3 > 0.5)::INT + (c4 > 0.5)::INT + (c5 > 0.5)::INT AS INT) AS prediction
FROM c""")
def q_chained(spark, sf):
    """Chained P(y > k) and the class they give, from conditional
    probabilities read off an id's hash."""
    digit = lambda i: (F.instr(F.lit(HEX), F.substring(F.md5(S.ref), i, 1)) - 1) / F.lit(15.0)
    net = ConditionalOrdinalNet([], label="y", classes=CLASSES)
    chain, prediction = net._combine(F.col("conditional"))
    probs = (C.consolidated(spark, sf).select(S.ref, F.array(*[digit(i) for i in range(1, 6)]).alias("conditional"))
             .withColumn("probabilities", chain).withColumn("prediction", prediction))
    return C.round_doubles(probs.select(S.ref, *[F.col("probabilities")[i].alias(f"c{i + 1}") for i in range(5)], "prediction"))


@register("feature_preservation", O.with_(O.ENC_BASE) + """
SELECT DISTINCT 'sector_BUILDING' AS "column", CAST(0.5 AS DOUBLE) AS value, 'non_binary' AS problem FROM encoded WHERE starts_with(md5(ref), '00')
UNION ALL
SELECT DISTINCT 'time_to_report', CAST(time_to_report + 10 AS DOUBLE), 'new_value' FROM encoded WHERE starts_with(md5(ref), 'ff')""")
def q_feature_preservation(spark, sf):
    """V5: a copy of the encoded incidents with two kinds of damage (chosen by
    id hash), against the undamaged ones."""
    data = C.encoded(spark, sf).data
    h = F.md5(S.ref)
    bad = data.withColumns({
        "sector_BUILDING": F.when(h.startswith("00"), F.lit(0.5)).otherwise(F.col("sector_BUILDING").cast("double")),
        "time_to_report": F.when(h.startswith("ff"), F.col("time_to_report") + 10).otherwise(F.col("time_to_report"))})
    dummies = [f"{c}_{v}" for c, lv in O.DUMMY_LEVELS.items() for v in lv]
    return quality.feature_preservation(data, bad, dummies, ["time_to_report", "years_since_start", S.target])


@register("imbalance_gate", O.with_(A.R_BASE, "n AS (SELECT y, count(*) AS n FROM ytab GROUP BY y)") + """
SELECT CAST(y AS INT) AS y, CAST(n AS BIGINT) AS n, round(CAST(max(n) OVER () AS DOUBLE) / min(n) OVER (), 6) AS ratio FROM n""")
def q_imbalance_gate(spark, sf):
    """R7 below its threshold: the rows stay as they are."""
    d = A.labelled(spark, sf)
    kept = smote.rebalance(d, "y", S.ref, S.score_col, [], threshold=1e9)
    out = profile.class_counts(kept, "y")
    return C.round_doubles(out.select(F.col("class").alias("y"), "n", F.col("imbalance_ratio").alias("ratio")))


# trials by (pseudo model, fold): name, parameters, which parameters vary
_TRIALS = {
    "ordered_forest": lambda m, f: {"n_estimators": 100, "min_samples_leaf": 3 if m == "m1" else 10, "max_features": 5 if f % 2 else 10},
    "boosted_ordinal": lambda m, f: {"iterations": 10, "depth": 4 if m == "m1" else 6, "l2_leaf_reg": 3, "learning_rate": 0.1 if f % 2 else 0.05},
    "conditional_ordinal_net": lambda m, f: {"epochs": 100 if f % 2 else 50, "hidden_layer_sizes": (64, 32) if m == "m1" else (128, 64)},
    "ordinal_logistic": lambda m, f: {"alpha": 0.5 if m == "m1" else 2.0},
}


def pseudo_summary(spark, sf) -> DataFrame:
    """T2 summary of made-up trials: the folds of the pseudo models' scores
    stand for parameter sets."""
    cells = [(m, f, name, tuning.params_id(p(m, f))) for name, p in _TRIALS.items() for m in ("m1", "m2") for f in range(5)]
    names = spark.createDataFrame(cells, "model string, fold int, trial string, params_id string")
    long = M.long_scores(A.pseudo_scores(spark, sf), keys=("model", "fold")).where("metric = 'weighted_mae' and split = 'test'")
    scored = long.join(F.broadcast(names), ["model", "fold"]).select(F.col("trial").alias("model"), "params_id", "fold", "value")
    return scored.groupBy("model", "params_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds"))


def _pivoted(report: str, table: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in table.columns if c not in keys]
    item = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys])
    return table.select(F.lit(report).alias("report"), item.alias("item"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("metric"), F.round(F.col(f"`{v}`").cast("double"), 6).alias("value")) for v in values]))).where("value is not null")


_LONG = "SELECT model, fold, value FROM lscores WHERE metric = 'weighted_mae' AND split = 'test'"


def _group(keys: str, where: str = "") -> str:
    return f"SELECT {keys}, avg(value) AS mean, stddev_pop(value) AS std FROM l {where} GROUP BY ALL"


@register("tuning_report", O.with_(A.P_BASE, f"l AS ({_LONG})",
                                   f"rf AS ({_group('model, fold % 2 AS odd')})", f"by_model AS ({_group('model')})") + """
SELECT 'forest' AS report, CASE model WHEN 'm1' THEN '3' ELSE '10' END AS item, CASE odd WHEN 1 THEN '5' ELSE '10' END AS metric, round(mean, 6) AS value FROM rf
UNION ALL SELECT 'boosted', CASE model WHEN 'm1' THEN '4|3.0' ELSE '6|3.0' END, CASE odd WHEN 1 THEN '0.1' ELSE '0.05' END, round(mean, 6) FROM rf
UNION ALL SELECT 'net', CASE model WHEN 'm1' THEN '[64,32]' ELSE '[128,64]' END, 'best_mean', round(min(mean), 6) FROM rf GROUP BY model
UNION ALL SELECT 'net', CASE model WHEN 'm1' THEN '[64,32]' ELSE '[128,64]' END, 'combos', 2.0 FROM rf GROUP BY model
UNION ALL SELECT 'logistic', CASE model WHEN 'm1' THEN '0.5' ELSE '2.0' END, 'lo', round(mean - std, 6) FROM by_model
UNION ALL SELECT 'logistic', CASE model WHEN 'm1' THEN '0.5' ELSE '2.0' END, 'mid', round(mean, 6) FROM by_model
UNION ALL SELECT 'logistic', CASE model WHEN 'm1' THEN '0.5' ELSE '2.0' END, 'hi', round(mean + std, 6) FROM by_model
UNION ALL SELECT 'best', 'ordinal_logistic', 'mean', round(min(mean), 6) FROM by_model
UNION ALL SELECT 'best', name, 'mean', round(min(mean), 6) FROM rf CROSS JOIN (VALUES ('ordered_forest'), ('boosted_ordinal'), ('conditional_ordinal_net')) AS t(name) GROUP BY name""")
def q_tuning_report(spark, sf):
    """O6-O9 and T3 in one long table."""
    summ = pseudo_summary(spark, sf)
    best = tuning.best_params(summ, "weighted_mae").select("model", "mean")
    return reduce(DataFrame.unionByName, [
        _pivoted("forest", tuning.forest_pivot(summ, 100), ["min_samples_leaf"]),
        _pivoted("boosted", tuning.boosted_pivot(summ), ["depth", "l2_leaf_reg"]),
        _pivoted("net", tuning.net_by_architecture(summ), ["architecture"]),
        _pivoted("logistic", tuning.logistic_band(summ), ["alpha"]),
        _pivoted("best", best, ["model"])])
