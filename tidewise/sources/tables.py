"""Sources and sinks: files through Spark's readers, and saved panels."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options: Any) -> DataFrame:
    """A table of any format Spark reads; CSV has a header unless told otherwise."""
    reader = spark.read.options(**({"header": "true"} | options if kind == "csv" else options))
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.format(kind).load(path)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null: the only missing value that operators know."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small document, through Spark, so that any store will do."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
