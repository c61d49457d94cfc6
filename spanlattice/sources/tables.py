"""CSV files under a given schema: no pass over the data to guess types, and columns pruned by the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FORM = {"header": "true", "escape": '"', "multiLine": "false"}


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Rows of CSV files with a header. A field that does not fit its type is an error; an empty field is null."""
    return spark.read.options(**{**_FORM, "mode": "FAILFAST", "enforceSchema": "false", **options}).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, **options: str) -> None:
    df.write.options(**{**_FORM, **options}).csv(path)
