"""Sinks and readers for marts, forecast facts and metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_money(df: DataFrame, digits: int = 2) -> DataFrame:
    """Cast every double column to DECIMAL(38, digits), exact in the file.  A
    double is rounded half-up from its shortest decimal form, so 1.005 becomes
    1.01 where ``%.2f`` prints 1.00; money is cents-exact and has no such ties."""
    return df.select(*[
        F.col(f.name).cast(f"decimal(38,{digits})").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def write_mart(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
               money_digits: int | None = None, mode: str = "overwrite") -> None:
    """Write a mart or forecast fact table.

    ``fmt`` is ``parquet`` (default) or ``csv`` (with header); ``compression``
    e.g. ``gzip`` for the compressed CSV marts; ``money_digits`` rounds
    doubles to fixed decimals first.  Each task writes its own part file.
    """
    out = round_money(df, money_digits) if money_digits is not None else df
    w = out.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str,
                   date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Read a published CSV with a fixed schema (dates parsed, no inference)."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("dateFormat", date_format).csv(path))


def write_metrics_json(df: DataFrame, path: str) -> None:
    """A one-row metrics frame as a JSON document; more rows are refused."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("A metrics document has exactly one row")
    df.sparkSession.createDataFrame(row, df.schema).repartition(1).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)
