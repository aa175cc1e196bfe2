"""Fixture queries: missing-data report (X3), metrics (E*), folds, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import col
from ..operators import encode as enc
from ..operators import metrics as M
from ..operators import missing as MS
from ..operators import profile, quality, resample
from ..operators.ranking import assign_folds
from . import common as C
from . import oracle_sql as O
from .registry import register

S = C.S
CATS = [c for c in S.incident_categories if c != S.target]
IND = f"{S.target}_missing"

# ---------------------------------------------------------------- missing report

MBASE = f"""mbase AS (
  SELECT ref, raw_score, data_type_score, subject_type_count, quarter, decision_taken,
         incident_type, CASE WHEN no_affected = 'Unknown' THEN NULL ELSE no_affected END AS no_affected,
         sector, time_to_report, CAST(year - min(year) OVER () AS INT) AS years_since_start,
         CAST(CASE WHEN no_affected = 'Unknown' THEN 1 ELSE 0 END AS INT) AS {IND}
  FROM clean)"""
M_BASE = ",\n".join([O.CLEAN_BASE, MBASE])


def missing_base(spark, sf) -> DataFrame:
    """X3 input: X1 without encoding/imputation, then P8 on the target."""
    return enc.unknown_indicator(C.clean(spark, sf).data, S.target, ["Unknown"])


def _cont_sql() -> str:
    st = " UNION ALL ".join(f"SELECT '{c}' AS cname, {c} AS category, {IND} AS ind FROM mbase"
                            for c in CATS)
    return f"st AS ({st}),\nct AS (SELECT cname, category, " \
           "CAST(count(*) FILTER (WHERE ind = 0) AS BIGINT) AS n_present, " \
           "CAST(count(*) FILTER (WHERE ind = 1) AS BIGINT) AS n_missing " \
           "FROM st WHERE category IS NOT NULL GROUP BY cname, category)"


CONT = _cont_sql()


def contingency_table(spark, sf) -> DataFrame:
    return MS.contingency(missing_base(spark, sf), CATS, IND)


@register("missing_profile", O.with_(M_BASE) + """
SELECT 'no_affected' AS "column", CAST(count(*) FILTER (WHERE no_affected IS NULL) AS BIGINT) AS missing_count,
       round(count(*) FILTER (WHERE no_affected IS NULL) * 100.0 / count(*), 2) AS missing_percentage
FROM mbase HAVING count(*) FILTER (WHERE no_affected IS NULL) > 0""")
def q_missing_profile(spark, sf):
    """A4 + F3 after P8 (sentinel 'Unknown' -> null)."""
    return profile.missing_profile(missing_base(spark, sf))


@register("contingency", O.with_(M_BASE, CONT) + """
SELECT cname AS "column", category, n_present, n_missing FROM ct""")
def q_contingency(spark, sf):
    """Category x target-missing indicator counts."""
    return contingency_table(spark, sf)


CHI_SQL = O.with_(M_BASE, CONT, """t AS (
  SELECT *, n_present + n_missing AS r,
         sum(n_present) OVER (PARTITION BY cname) AS c0, sum(n_missing) OVER (PARTITION BY cname) AS c1,
         sum(n_present + n_missing) OVER (PARTITION BY cname) AS nn,
         count(*) OVER (PARTITION BY cname) AS nr FROM ct),
t2 AS (SELECT *, (CASE WHEN c0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1 ELSE 0 END) AS nc FROM t),
t3 AS (SELECT *, (nr - 1) * (nc - 1) AS dof,
              CAST(r AS DOUBLE) * c0 / nn AS e0, CAST(r AS DOUBLE) * c1 / nn AS e1 FROM t2),
t4 AS (SELECT *,
  n_present + CASE WHEN dof = 1 THEN sign(e0 - n_present) * least(0.5, abs(e0 - n_present)) ELSE 0 END AS o0,
  n_missing + CASE WHEN dof = 1 THEN sign(e1 - n_missing) * least(0.5, abs(e1 - n_missing)) ELSE 0 END AS o1
  FROM t3),
g AS (SELECT cname,
  sum(CASE WHEN c0 > 0 THEN (o0 - e0) * (o0 - e0) / e0 ELSE 0 END
      + CASE WHEN c1 > 0 THEN (o1 - e1) * (o1 - e1) / e1 ELSE 0 END) AS chi2,
  CAST(min(dof) AS INT) AS dof, CAST(min(nn) AS BIGINT) AS n, least(min(nr), min(nc)) - 1 AS md
  FROM t4 GROUP BY cname)""") + """
SELECT cname AS "column", round(chi2, 6) AS chi2, dof, n, round(sqrt(chi2 / (n * md)), 6) AS cramers_v,
       CASE WHEN sqrt(chi2 / (n * md)) < 0.1 THEN 'weak'
            WHEN sqrt(chi2 / (n * md)) < 0.3 THEN 'moderate' ELSE 'strong' END AS strength
FROM g"""


@register("chi_square", CHI_SQL)
def q_chi_square(spark, sf):
    """Chi-square, dof, Cramer's V and strength per category column."""
    return C.round_doubles(MS.chi_square(contingency_table(spark, sf)))


# the lower tail by its series, in logarithms
P_SQL = f"""WITH chi AS ({CHI_SQL})
SELECT "column", chi2, dof, round(CASE WHEN chi2 <= 0 THEN 1.0 ELSE 1.0 - list_sum([
         exp(-chi2 / 2 + (dof / 2.0 + i) * ln(chi2 / 2) - lgamma(dof / 2.0 + i + 1)) for i in range(0, 2000)]) END, 6) AS p_value
FROM chi"""


@register("chi_square_pvalues", P_SQL)
def q_chi_square_p(spark, sf):
    """A9 p-values (upper chi-square tail)."""
    chi = MS.chi_square(contingency_table(spark, sf))
    return C.round_doubles(chi.select("column", "chi2", "dof", MS.chi2_pvalue("chi2", "dof").alias("p_value")))


@register("missing_by_category", O.with_(M_BASE, CONT) + """
, p AS (SELECT cname, category, n_missing * 100.0 / (n_present + n_missing) AS pct FROM ct)
SELECT cname AS "column", category, round(pct, 6) AS missing_pct,
       pct > avg(pct) OVER (PARTITION BY cname) AS above_average
FROM p""")
def q_missing_by_category(spark, sf):
    """A10 + F4 (+O1 order in the report): missing % per category."""
    return C.round_doubles(MS.missing_by_category(contingency_table(spark, sf)))


@register("missing_by_year", O.with_(M_BASE) + """
SELECT years_since_start, round(avg(CASE WHEN no_affected IS NULL THEN 1.0 ELSE 0.0 END) * 100.0, 6)
       AS missing_pct
FROM mbase GROUP BY years_since_start""")
def q_missing_by_year(spark, sf):
    """Target missing % per year since start."""
    return C.round_doubles(MS.missing_by_group(missing_base(spark, sf), S.years_col, S.target))


@register("year_missing_correlation", O.with_(M_BASE) + f"""
SELECT round(corr(CAST(years_since_start AS DOUBLE), CAST({IND} AS DOUBLE)), 6) AS r FROM mbase""")
def q_year_corr(spark, sf):
    """Pearson r of years since start and the missing indicator."""
    return C.round_doubles(MS.correlation(missing_base(spark, sf), S.years_col, IND))


@register("year_by_missingness", O.with_(M_BASE) + f"""
SELECT {IND}, CAST(min(years_since_start) AS DOUBLE) AS min,
       round(quantile_cont(years_since_start, 0.25), 6) AS q25,
       round(quantile_cont(years_since_start, 0.5), 6) AS median,
       round(quantile_cont(years_since_start, 0.75), 6) AS q75,
       CAST(max(years_since_start) AS DOUBLE) AS max
FROM mbase GROUP BY {IND}""")
def q_year_by_missingness(spark, sf):
    """Five-number summary of years since start by missingness."""
    return C.round_doubles(MS.five_numbers(missing_base(spark, sf), S.years_col, IND))


NULL_COLS = ["data_type_score", "quarter", "decision_taken", "incident_type", "no_affected",
             "sector", "time_to_report", "years_since_start"]


@register("null_patterns", O.with_(M_BASE) + "\nSELECT " + ", ".join(
    f"({c} IS NULL) AS {c}_null" for c in NULL_COLS) + ", CAST(count(*) AS BIGINT) AS n FROM mbase "
    "GROUP BY ALL")
def q_null_patterns(spark, sf):
    """Distinct null masks with counts (heat-map data)."""
    return profile.null_patterns(missing_base(spark, sf), NULL_COLS)


def _pb_features() -> list[str]:
    return ["data_type_score", "subject_type_count", "time_to_report", "years_since_start",
            *[f"{c}_{v}" for c, lv in O.DUMMY_LEVELS.items() for v in lv]]


def _pb_sql() -> str:
    feats = _pb_features()
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr(CAST(\"{f}\" AS DOUBLE), ind) AS r FROM e" for f in feats)
    return O.with_(O.ENC_BASE, "e AS (SELECT *, CASE WHEN no_affected = 0 THEN 1.0 ELSE 0.0 END "
                   "AS ind FROM encoded)", f"pb AS ({rows})") + """
SELECT feature, round(r, 6) AS r, abs(r) > 0.1 AS strong,
       CASE WHEN abs(r) > 0.1 THEN round(r, 3) END AS r_rounded FROM pb"""


@register("point_biserial", _pb_sql())
def q_point_biserial(spark, sf):
    """A13 + F5: r of every encoded feature with target missingness."""
    prep = C.encoded(spark, sf)
    e = prep.data.withColumn("_ind", (F.col(S.target) == 0).cast("double"))
    return C.round_doubles(MS.point_biserial(e, [f for f in prep.features(S) if f != S.target], "_ind"))


# ---------------------------------------------------------------- folds + metrics

PSEUDO = f"""pbase AS (
  SELECT ref, CAST(CASE no_affected WHEN '1 to 9' THEN 1 WHEN '10 to 99' THEN 2 WHEN '100 to 1k' THEN 3
                   WHEN '1k to 10k' THEN 4 WHEN '10k to 100k' THEN 5 ELSE 6 END AS INT) AS y_true
  FROM cons0 WHERE no_affected <> 'Unknown'),
folded AS (
  SELECT ref, y_true,
         CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5(concat('42|', ref)), ref) - 1) % 5 AS INT) AS fold,
         CAST(ascii(substr(md5(concat('p|', ref)), 1, 1)) AS INT) AS h
  FROM pbase),
pseudo AS (
  SELECT 'm1' AS model, fold, 'test' AS split, ref, y_true,
         CAST(greatest(1, least(6, y_true + h % 3 - 1)) AS INT) AS y_pred FROM folded
  UNION ALL
  SELECT 'm2' AS model, fold, 'test' AS split, ref, y_true,
         CAST(greatest(1, least(6, y_true + h % 5 - 2)) AS INT) AS y_pred FROM folded),
cc AS (SELECT model, fold, y_true AS k, count(*) AS n FROM pseudo GROUP BY model, fold, y_true),
tot AS (SELECT model, k, sum(n) AS n FROM cc GROUP BY model, k),
tc AS (SELECT cc.model, cc.fold, cc.k, tot.n - cc.n AS n FROM cc JOIN tot ON cc.model = tot.model AND cc.k = tot.k),
cum AS (
  SELECT model, fold, k, n,
         sum(n) OVER (PARTITION BY model, fold ORDER BY k) AS cn,
         sum(n) OVER (PARTITION BY model, fold) AS nn,
         count(*) OVER (PARTITION BY model, fold) AS kk
  FROM tc),
rawinv AS (SELECT *, CAST(nn AS DOUBLE) / (kk * n) AS w0 FROM cum),
w AS (SELECT *, w0 * kk / sum(w0) OVER (PARTITION BY model, fold) AS wt FROM rawinv),
prox AS (
  SELECT a.model, a.fold, a.k AS t, b.k AS q, a.wt,
         -log2((CASE WHEN a.k <= b.k THEN a.n / 2.0 + b.cn - a.cn
                     ELSE b.n / 2.0 + a.cn - b.cn END) / CAST(a.nn AS DOUBLE)) AS px,
         -log2(a.n / 2.0 / CAST(a.nn AS DOUBLE)) AS self
  FROM w a JOIN w b ON a.model = b.model AND a.fold = b.fold),
cf AS (SELECT model, fold, split, y_true, y_pred, count(*) AS n FROM pseudo GROUP BY ALL),
sup AS (SELECT model, fold, split, y_true AS c, sum(n) AS support FROM cf GROUP BY ALL),
prd AS (SELECT model, fold, split, y_pred AS c, sum(n) AS predicted FROM cf GROUP BY ALL),
tpc AS (SELECT model, fold, split, y_true AS c, n AS tp FROM cf WHERE y_true = y_pred),
per AS (
  SELECT coalesce(s.model, p.model) AS model, coalesce(s.fold, p.fold) AS fold,
         coalesce(s.split, p.split) AS split, coalesce(s.c, p.c) AS c,
         coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted
  FROM sup s FULL JOIN prd p ON s.model = p.model AND s.fold = p.fold AND s.split = p.split AND s.c = p.c),
f1 AS (
  SELECT per.model, per.fold, per.split,
         sum(coalesce(CAST(2 AS DOUBLE) * coalesce(tpc.tp, 0) / nullif(per.support + per.predicted, 0), 0)
             * per.support) / sum(per.support) AS f1_weighted
  FROM per LEFT JOIN tpc ON per.model = tpc.model AND per.fold = tpc.fold AND per.split = tpc.split
                         AND per.c = tpc.c
  GROUP BY per.model, per.fold, per.split),
scores AS (
  SELECT p.model, p.fold, p.split, CAST(count(*) AS BIGINT) AS n,
         avg(CAST(abs(p.y_true - p.y_pred) AS DOUBLE)) AS mae,
         avg(CASE WHEN p.y_true = p.y_pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy,
         avg(abs(p.y_true - p.y_pred) * x.wt) AS weighted_mae,
         sum(x.px) / sum(x.self) AS cem
  FROM pseudo p
  JOIN prox x ON p.model = x.model AND p.fold = x.fold AND p.y_true = x.t AND p.y_pred = x.q
  GROUP BY p.model, p.fold, p.split),
fscores AS (SELECT s.*, f1.f1_weighted FROM scores s JOIN f1 USING (model, fold, split)),
lscores AS (
  SELECT model, fold, split, 'mae' AS metric, mae AS value FROM fscores
  UNION ALL SELECT model, fold, split, 'accuracy', accuracy FROM fscores
  UNION ALL SELECT model, fold, split, 'f1_weighted', f1_weighted FROM fscores
  UNION ALL SELECT model, fold, split, 'weighted_mae', weighted_mae FROM fscores
  UNION ALL SELECT model, fold, split, 'cem', cem FROM fscores)"""
P_BASE = ",\n".join([O.BASE, PSEUDO])


def pseudo_predictions(spark, sf) -> DataFrame:
    """FIXTURES section 4: folds by W3, predictions = truth moved by an md5
    digit (two fake models), so metrics are testable without a model."""
    cons = C.consolidated(spark, sf)
    codes = {lvl: i for i, lvl in enumerate(S.target_spec.levels)}
    y = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in codes.items() if v > 0
                                                     for x in (F.lit(k), F.lit(v))]),
                                    col(S.target)), F.lit(6)).cast("int")
    base = cons.where(col(S.target) != "Unknown").select(S.ref, y.alias("y_true"))
    folded = assign_folds(base, "y_true", S.ref, k=5, seed=42)
    h = F.ascii(F.substring(F.md5(F.concat(F.lit("p|"), F.col(S.ref))), 1, 1))
    m1 = folded.select(F.lit("m1").alias("model"), "fold", F.lit("test").alias("split"), S.ref,
                       "y_true", F.greatest(F.lit(1), F.least(F.lit(6), F.col("y_true") + h % 3 - 1))
                       .cast("int").alias("y_pred"))
    m2 = folded.select(F.lit("m2").alias("model"), "fold", F.lit("test").alias("split"), S.ref,
                       "y_true", F.greatest(F.lit(1), F.least(F.lit(6), F.col("y_true") + h % 5 - 2))
                       .cast("int").alias("y_pred"))
    return m1.unionByName(m2)


def pseudo_train_counts(pred: DataFrame) -> DataFrame:
    return M.train_counts_from_folds(pred, "y_true", "fold", keys=["model"])


def pseudo_scores(spark, sf) -> DataFrame:
    pred = pseudo_predictions(spark, sf)
    return M.fold_scores(pred, pseudo_train_counts(pred))


@register("stratified_folds", O.with_(P_BASE) + "\nSELECT ref, y_true, fold FROM folded")
def q_folds(spark, sf):
    """Stratified 5-fold assignment (md5 shuffle, seed 42)."""
    return pseudo_predictions(spark, sf).where(F.col("model") == "m1").select(S.ref, "y_true", "fold")


@register("class_weights", O.with_(P_BASE) + """
SELECT model, fold, CAST(k AS INT) AS class, CAST(n AS BIGINT) AS n, round(wt, 6) AS weight FROM w""")
def q_class_weights(spark, sf):
    """Balanced class weights of each training fold."""
    tc = pseudo_train_counts(pseudo_predictions(spark, sf))
    return C.round_doubles(M.class_weights(tc))


@register("cem_proximity", O.with_(P_BASE) + """
SELECT model, fold, CAST(t AS INT) AS t, CAST(q AS INT) AS p, round(px, 6) AS prox,
       round(self, 6) AS self_prox FROM prox""")
def q_cem_proximity(spark, sf):
    """W5 + J5: CEM proximity matrix of each training fold."""
    tc = pseudo_train_counts(pseudo_predictions(spark, sf))
    return C.round_doubles(M.proximity(tc))


@register("fold_scores", O.with_(P_BASE) + """
SELECT model, fold, split, n, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy,
       round(weighted_mae, 6) AS weighted_mae, round(cem, 6) AS cem,
       round(f1_weighted, 6) AS f1_weighted FROM fscores""")
def q_fold_scores(spark, sf):
    """E1, E2, E3, E5, E6 per model and fold."""
    return C.round_doubles(pseudo_scores(spark, sf))


@register("score_table", O.with_(P_BASE) + """
SELECT model, fold, split, metric, round(value, 6) AS value FROM lscores""")
def q_score_table(spark, sf):
    """Long (model, fold, split, metric, value) table."""
    return C.round_doubles(M.long_scores(pseudo_scores(spark, sf)))


@register("cv_summary", O.with_(P_BASE) + """
SELECT model, split, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       CAST(count(*) AS BIGINT) AS folds
FROM lscores GROUP BY model, split, metric""")
def q_cv_summary(spark, sf):
    """Mean and population std of every metric over folds."""
    return C.round_doubles(M.cv_summary(M.long_scores(pseudo_scores(spark, sf))))


@register("best_model", O.with_(P_BASE, """summ AS (
  SELECT model, split, metric, avg(value) AS mean FROM lscores GROUP BY model, split, metric),
bm AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY
      CASE WHEN metric IN ('accuracy', 'f1_weighted', 'cem') THEN -mean ELSE mean END, model) AS rn
  FROM summ WHERE split = 'test')""") + """
SELECT metric, model, round(mean, 6) AS mean FROM bm WHERE rn = 1""")
def q_best_model(spark, sf):
    """Best model per metric with the right direction."""
    summ = M.cv_summary(M.long_scores(pseudo_scores(spark, sf)))
    return C.round_doubles(M.best_model(summ))


@register("confusion_matrix", O.with_(P_BASE, """lab AS (
  SELECT y_true AS c FROM pseudo UNION SELECT y_pred FROM pseudo),
cells AS (SELECT g.model, g.fold, g.split, a.c AS y_true, b.c AS y_pred
          FROM (SELECT DISTINCT model, fold, split FROM pseudo) g, lab a, lab b)""") + """
SELECT c.model, c.fold, c.split, c.y_true, c.y_pred, CAST(coalesce(cf.n, 0) AS BIGINT) AS n
FROM cells c LEFT JOIN cf USING (model, fold, split, y_true, y_pred)""")
def q_confusion(spark, sf):
    """Dense confusion counts per model and fold."""
    return M.confusion(pseudo_predictions(spark, sf))


@register("mean_confusion", O.with_(P_BASE, """lab AS (
  SELECT y_true AS c FROM pseudo UNION SELECT y_pred FROM pseudo),
cells AS (SELECT g.model, g.fold, g.split, a.c AS y_true, b.c AS y_pred
          FROM (SELECT DISTINCT model, fold, split FROM pseudo) g, lab a, lab b),
dense AS (SELECT c.model, c.fold, c.split, c.y_true, c.y_pred, coalesce(cf.n, 0) AS n
          FROM cells c LEFT JOIN cf USING (model, fold, split, y_true, y_pred)),
m AS (SELECT model, split, y_true, y_pred, avg(n) AS mean_n FROM dense GROUP BY ALL),
sh AS (SELECT *, mean_n / sum(mean_n) OVER (PARTITION BY model, split, y_true) AS share FROM m)""") + """
SELECT model, split, y_true, y_pred, round(mean_n, 6) AS mean_n, round(share, 6) AS share,
       round(sum(share * abs(y_true - y_pred)) OVER (PARTITION BY model, split, y_true), 6) AS ordinal_error,
       round(max(CASE WHEN y_true = y_pred THEN share END) OVER (PARTITION BY model, split, y_true), 6)
         AS class_accuracy
FROM sh""")
def q_mean_confusion(spark, sf):
    """Mean and row-normalised confusion, ordinal error per class."""
    return C.round_doubles(M.mean_confusion(M.confusion(pseudo_predictions(spark, sf))))


@register("error_distribution", O.with_(P_BASE, """e AS (
  SELECT model, split, CAST(abs(y_true - y_pred) AS INT) AS abs_error FROM pseudo),
d AS (SELECT model, split, abs_error, count(*) AS c FROM e GROUP BY ALL),
s AS (SELECT model, split, avg(abs_error) AS mae, quantile_cont(abs_error, 0.5) AS median_error,
             avg(CASE WHEN abs_error = 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_exact,
             avg(CASE WHEN abs_error <= 1 THEN 1.0 ELSE 0.0 END) * 100 AS pct_within_1
      FROM e GROUP BY ALL)""") + """
SELECT d.model, d.split, d.abs_error, round(d.c * 100.0 / sum(d.c) OVER (PARTITION BY d.model, d.split), 6) AS pct,
       round(s.mae, 6) AS mae, round(s.median_error, 6) AS median_error,
       round(s.pct_exact, 6) AS pct_exact, round(s.pct_within_1, 6) AS pct_within_1
FROM d JOIN s USING (model, split)""")
def q_error_distribution(spark, sf):
    """Distribution of absolute errors with summary numbers."""
    return C.round_doubles(M.error_distribution(pseudo_predictions(spark, sf)))


# ---------------------------------------------------------------- resampling plans

RS_BASE = f"""ytab AS (
  SELECT ref, CAST({O.AFFECTED_CODE} AS INT) AS y FROM clean WHERE no_affected <> 'Unknown'),
cls AS (SELECT y AS class, count(*) AS n FROM ytab GROUP BY y),
rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, class) AS r FROM cls),
pl AS (SELECT class, n,
         greatest(n, CAST(floor(sqrt(CAST(max(n) OVER () AS DOUBLE) * min(n) OVER ())) AS BIGINT)) AS balanced_target,
         CASE WHEN r = 1 AND max(CASE WHEN r = 2 THEN n END) OVER () IS NOT NULL
              THEN least(n, CAST(floor(max(CASE WHEN r = 2 THEN n END) OVER () / 0.75) AS BIGINT))
              ELSE n END AS under_target
       FROM rk),
plan AS (SELECT *, CASE class WHEN 1 THEN greatest(under_target, CAST(floor(0.6 * max(under_target) OVER ()) AS BIGINT))
                              WHEN 5 THEN greatest(under_target, CAST(floor(0.5 * max(under_target) OVER ()) AS BIGINT))
                              WHEN 6 THEN greatest(under_target, CAST(floor(0.7 * max(under_target) OVER ()) AS BIGINT))
                              ELSE under_target END AS over_target FROM pl),
urank AS (SELECT t.*, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42|', ref)), ref) AS rn FROM ytab t),
under AS (SELECT u.ref, u.y FROM urank u JOIN plan p ON u.y = p.class WHERE u.rn <= p.under_target)"""
R_BASE = ",\n".join([O.CLEAN_BASE, RS_BASE])


def labelled(spark, sf) -> DataFrame:
    e = enc.ordinal_encode(C.clean(spark, sf).data, S)
    return e.where(F.col(S.target) > 0).select(S.ref, F.col(S.target).alias("y"))


@register("sampling_plan", O.with_(R_BASE) + """
SELECT CAST(class AS INT) AS class, CAST(n AS BIGINT) AS n, CAST(balanced_target AS BIGINT) AS balanced_target,
       CAST(under_target AS BIGINT) AS under_target, CAST(over_target AS BIGINT) AS over_target FROM plan""")
def q_sampling_plan(spark, sf):
    """R1 + R2 + R3: balanced, undersampling and oversampling targets."""
    return resample.sampling_plan(labelled(spark, sf), "y")


@register("undersample", O.with_(R_BASE) + "\nSELECT ref, y FROM under")
def q_undersample(spark, sf):
    """Exact-n undersampling of the majority class (md5 order)."""
    d = labelled(spark, sf)
    return resample.undersample(d, "y", S.ref, resample.sampling_plan(d, "y"))


@register("undersample_distribution", O.with_(R_BASE) + """
SELECT CAST(c.class AS INT) AS class, CAST(c.n AS BIGINT) AS n_before,
       CAST(coalesce(u.n, 0) AS BIGINT) AS n_after
FROM cls c FULL JOIN (SELECT y, count(*) AS n FROM under GROUP BY y) u ON c.class = u.y""")
def q_undersample_distribution(spark, sf):
    """Class counts before and after undersampling (full outer join)."""
    d = labelled(spark, sf)
    u = resample.undersample(d, "y", S.ref, resample.sampling_plan(d, "y"))
    return resample.compare_distributions(d, u, "y")


@register("undersample_new_levels", O.with_(R_BASE) + """
SELECT DISTINCT 'all' AS against, 'y' AS "column", CAST(y AS VARCHAR) AS value FROM under
WHERE y NOT IN (SELECT y FROM ytab)
UNION ALL SELECT DISTINCT 'y below 5', 'y', CAST(y AS VARCHAR) FROM under
WHERE y NOT IN (SELECT y FROM ytab WHERE y < 5)""")
def q_undersample_new_levels(spark, sf):
    """Levels after resampling that were not there before: none against
    all rows, the upper classes against the rows of the lower ones."""
    d = labelled(spark, sf)
    u = resample.undersample(d, "y", S.ref, resample.sampling_plan(d, "y"))
    found = quality.new_levels(u, d, ["y"]).withColumn("against", F.lit("all"))
    return found.unionByName(quality.new_levels(u, d.where("y < 5"), ["y"]).withColumn("against", F.lit("y below 5")))
