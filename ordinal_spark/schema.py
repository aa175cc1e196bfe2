"""Schema objects: which column plays which role, and the closed level lists.

Operators never hard-code column names; they receive a ``SeveritySchema``.
Two instances ship with the package:

* ``REFERENCE_SCHEMA`` - the column names, domains and scores of the
  original incident-report CSV (spaces in names, as in the published data).
* ``FIXTURE_SCHEMA`` - the snake_case report table derived from the
  TPC-H-like test tables (see ``ordinal_spark.sources.fixtures``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import types as T


@dataclass(frozen=True)
class OrdinalSpec:
    """Ordered levels of an ordinal column. ``levels[i]`` is coded ``i``.

    ``excluded`` levels (e.g. an "Unknown" coded 0) are treated as missing
    after imputation.
    """

    levels: tuple[str, ...]
    excluded: tuple[str, ...] = ()

    @property
    def mapping(self) -> dict[str, int]:
        return {lvl: i for i, lvl in enumerate(self.levels)}


@dataclass(frozen=True)
class SeveritySchema:
    key: str
    year: str
    period: str
    subject_type: str
    data_type: str
    # the five fields whose differences split one reference into incidents
    split_fields: tuple[str, ...]
    target: str
    ordinals: Mapping[str, OrdinalSpec]
    dummies: tuple[str, ...]
    # columns read as dictionary-encoded categories (the period is plain text)
    categories: tuple[str, ...]
    domains: Mapping[str, tuple[str, ...]]
    scores: Mapping[str, int]
    unknown_labels: tuple[str, ...] = ("Unknown", "Unassigned")
    # derived column names
    ref: str = "ref"
    score_col: str = "data_type_score"
    subject_count_col: str = "subject_type_count"
    years_col: str = "years_since_start"
    raw_types: Mapping[str, T.DataType] = field(default_factory=dict)

    @property
    def raw_columns(self) -> list[str]:
        return [self.key, self.year, self.period, self.subject_type, self.data_type,
                *self.split_fields]

    @property
    def attributes(self) -> list[str]:
        """Columns that must be single-valued per incident (V3)."""
        return [self.year, self.period, *self.split_fields]

    @property
    def incident_categories(self) -> list[str]:
        """Category columns left after consolidation, in column order (F1)."""
        return [c for c in self.split_fields if c in self.categories]

    def struct_type(self, overrides: Mapping[str, T.DataType] | None = None) -> T.StructType:
        types = {c: T.StringType() for c in self.raw_columns}
        types[self.year] = T.IntegerType()
        types.update(self.raw_types)
        if overrides:
            unknown = set(overrides) - set(types)
            if unknown:
                raise ValueError(f"Invalid column(s) in type override: {sorted(unknown)}")
            for c, t in overrides.items():
                if not isinstance(t, (T.StringType, T.IntegerType, T.LongType)):
                    raise ValueError(f"Invalid data type for {c}: {t}")
            types.update(overrides)
        return T.StructType([T.StructField(c, types[c], True) for c in self.raw_columns])

    def ordinal(self, col: str) -> OrdinalSpec:
        return self.ordinals[col]

    @property
    def target_spec(self) -> OrdinalSpec:
        return self.ordinals[self.target]


# ---------------------------------------------------------------------------
# Fixed values that must equal the original analysis (level lists, ordinal
# order and severity scores of the published incident data set).
# ---------------------------------------------------------------------------
REFERENCE_AFFECTED_LEVELS = (
    "Unknown", "1 to 9", "10 to 99", "100 to 1k", "1k to 10k", "10k to 100k",
    "100k and above",
)
REFERENCE_TIME_LEVELS = (
    "Less than 24 hours", "24 hours to 72 hours", "72 hours to 1 week",
    "More than 1 week",
)
REFERENCE_DOMAINS = {
    "Quarter": ("Qtr 1", "Qtr 2", "Qtr 3", "Qtr 4"),
    "Decision Taken": ("Investigation Pursued", "No Further Action",
                       "Informal Action Taken", "Not Yet Assigned"),
    "Incident Type": ("Unauthorised access", "Ransomware", "Phishing", "Malware",
                      "Brute Force", "Other cyber incident", "Denial of service"),
    "Sector": ("Finance insurance and credit", "General business", "Health",
               "Membership association", "Charitable and voluntary",
               "Education and childcare", "Retail and manufacture",
               "Land or property services", "Religious",
               "Online Technology and Telecoms", "Transport and leisure",
               "Local government", "Legal", "Social care", "Regulators",
               "Central Government", "Utilities", "Media", "Justice",
               "Marketing", "Political", "Unassigned", "Unknown"),
}
REFERENCE_SCORES = {
    "Economic and financial data": 10,
    "Identification data": 9,
    "Genetic or biometric data": 9,
    "Health data": 8,
    "Criminal convictions or offences": 8,
    "Official documents": 7,
    "Basic personal identifiers": 7,
    "Sex life data": 6,
    "Location data": 5,
    "Data revealing racial or ethnic origin": 4,
    "Gender Reassignment Data": 4,
    "Religious or philosophical beliefs": 3,
    "Sexual orientation data": 3,
    "Trade union membership": 2,
    "Political opinions": 2,
}
# ---------------------------------------------------------------------------

REFERENCE_SCHEMA = SeveritySchema(
    key="BI Reference",
    year="Year",
    period="Quarter",
    subject_type="Data Subject Type",
    data_type="Data Type",
    split_fields=("Decision Taken", "Incident Type", "No. Data Subjects Affected",
                  "Sector", "Time Taken to Report"),
    target="No. Data Subjects Affected",
    ordinals={
        "No. Data Subjects Affected": OrdinalSpec(REFERENCE_AFFECTED_LEVELS, ("Unknown",)),
        "Time Taken to Report": OrdinalSpec(REFERENCE_TIME_LEVELS),
    },
    dummies=("Quarter", "Decision Taken", "Incident Type", "Sector"),
    categories=("Data Subject Type", "Data Type", "Decision Taken", "Incident Type",
                "No. Data Subjects Affected", "Sector", "Time Taken to Report"),
    domains=REFERENCE_DOMAINS,
    scores=REFERENCE_SCORES,
)

# Fixture built from the TPC-H-like tables (FIXTURES.md): order status plays
# the decision, order priority the incident type, market segment the sector.
FIXTURE_SCORES = {"LARGE": 10, "PROMO": 9, "MEDIUM": 7, "STANDARD": 5, "SMALL": 3}

FIXTURE_SCHEMA = SeveritySchema(
    key="bi_reference",
    year="year",
    period="quarter",
    subject_type="data_subject_type",
    data_type="data_type",
    split_fields=("decision_taken", "incident_type", "no_affected", "sector",
                  "time_to_report"),
    target="no_affected",
    ordinals={
        "no_affected": OrdinalSpec(REFERENCE_AFFECTED_LEVELS, ("Unknown",)),
        "time_to_report": OrdinalSpec(REFERENCE_TIME_LEVELS),
    },
    dummies=("quarter", "decision_taken", "incident_type", "sector"),
    categories=("data_subject_type", "data_type", "decision_taken", "incident_type",
                "no_affected", "sector", "time_to_report"),
    domains={
        "quarter": ("Qtr 1", "Qtr 2", "Qtr 3", "Qtr 4"),
        "decision_taken": ("F", "O", "P"),
        "incident_type": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
        "sector": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY",
                   "Unassigned", "Unknown"),
    },
    scores=FIXTURE_SCORES,
)


# Hyper-parameter grids of the original tuning run (fixed values).
GRID_ORDINAL_LOGISTIC = {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]}
GRID_ORDERED_FOREST = {"n_estimators": [100, 200, 500], "min_samples_leaf": [3, 5, 10],
                       "max_features": [5, 10, 15]}
GRID_BOOSTED = {"iterations": [1000, 2000], "learning_rate": [0.01, 0.1], "depth": [4, 6],
                "l2_leaf_reg": [3, 6]}
GRID_NEURAL = {"hidden_layer_sizes": [(64, 32)], "lr": [0.001], "batch_size": [64],
               "epochs": [100]}
