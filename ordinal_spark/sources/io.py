"""S1 typed scan with a declared schema, S2 report-table sink."""

from __future__ import annotations

from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SeveritySchema

# The texts that pandas reads as missing by default.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def load_reports(spark: SparkSession, path: str, schema: SeveritySchema,
                 fmt: str = "csv",
                 overrides: Mapping[str, T.DataType] | None = None,
                 check_empty: bool = True) -> DataFrame:
    """Read the raw report table with declared (never inferred) types.

    Columns are found by name, whatever their order or company; a missing one
    raises ValueError. CSV: header row, FAILFAST on malformed rows; every
    column is read as text, missing-value texts become null, and the rest is
    cast, which raises on values that do not fit. A missing path raises
    FileNotFoundError, an empty table ValueError (``check_empty`` runs one
    tiny ``isEmpty`` job).
    """
    st = schema.struct_type(overrides)
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    try:
        if fmt == "csv":
            header = spark.read.option("header", True).csv(path).columns  # reads the first line
            text = T.StructType([T.StructField(c, T.StringType()) for c in header])
            df = (spark.read.schema(text).option("header", True).option("mode", "FAILFAST")
                  .option("nullValue", "").option("emptyValue", "").csv(path))
        else:
            df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"Data file not found: {path}") from e
        raise
    missing = [f.name for f in st.fields if f.name not in df.columns]
    if missing and (fmt == "parquet" or df.columns):
        raise ValueError(f"Missing required columns: {missing}")
    if missing:
        raise ValueError(f"Empty data file: {path}")
    known = [F.col(f"`{f.name}`") if fmt == "parquet" else F.when(~F.col(f"`{f.name}`").isin(*NULL_TOKENS), F.col(f"`{f.name}`")) for f in st.fields]
    df = df.select([c.cast(f.dataType).alias(f.name) for c, f in zip(known, st.fields)])
    if check_empty and df.isEmpty():
        raise ValueError(f"Empty data file: {path}")
    return df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Persist a report table (the original only drew plots of these)."""
    w = df.write.mode(mode).format(fmt).option("header", True)  # of CSV
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
