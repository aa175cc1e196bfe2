"""Shared building blocks of the fixture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.entity import consolidate, split_references
from ..schema import FIXTURE_SCHEMA
from ..sources.fixtures import incident_reports
from . import pipelines as P

S = FIXTURE_SCHEMA


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both engines sum in different orders)."""
    return df.select([
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_reports(spark, sf_dir)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_references(reports(spark, sf_dir), S)


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(reports(spark, sf_dir), S)


def reports_with_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in which some references are named like the second unit of
    another: C<n>, n = 1 mod 10, becomes C<n - 1>A1."""
    n = F.substring(F.col(S.key), 2, 20).cast("long")
    named = F.when(n % 10 == 1, F.concat(F.lit("C"), (n - 1).cast("string"), F.lit("A1"))).otherwise(F.col(S.key))
    return reports(spark, sf_dir).withColumn(S.key, named)


def clean(spark: SparkSession, sf_dir: str) -> P.Prepared:
    """X1 without encoding, with the unstandardised score."""
    return P.preprocess(reports(spark, sf_dir), S, encode=False, impute_missing=False, keep_raw_score=True)


def encoded(spark: SparkSession, sf_dir: str) -> P.Prepared:
    return P.preprocess(reports(spark, sf_dir), S, impute_missing=False)
