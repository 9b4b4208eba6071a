"""The 13-column raw extract contract and its CSV reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed column contract of the raw extract (names in the SQL form).
RAW_SCHEMA = T.StructType([
    T.StructField("invoice_no", T.LongType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(14, 2)),
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("invoice_date_text", T.StringType()),
    T.StructField("original_year", T.IntegerType()),
    T.StructField("original_month", T.IntegerType()),
    T.StructField("original_week", T.IntegerType()),
    T.StructField("original_day", T.IntegerType()),
    T.StructField("original_weekday", T.IntegerType()),
])

# CSV header -> contract column, for the eight required headers.
CSV_HEADERS = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
    "InvoiceDate": "invoice_date_text",
}
REQUIRED_COLUMNS = [f.name for f in RAW_SCHEMA.fields[:8]]


def read_csv_extract(spark: SparkSession, path: str) -> DataFrame:
    """Read the CSV extract by its header names.

    The header names the columns, in whatever order; every file must have the
    same header.  Missing required columns raise, and so does a value that its
    column's type cannot hold.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST")
    names = reader.csv(path).columns
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return from_named_columns(reader.schema(texts).option("enforceSchema", False).csv(path))


def from_named_columns(df: DataFrame) -> DataFrame:
    """Map a frame with the CSV header names onto the contract names.

    Missing optional ``original_*`` columns become NULL; missing required
    columns raise (see ``quality.required_columns``), as does, in the job, a
    value that cannot be cast to its column's type.
    """
    present = set(df.columns)
    missing = sorted(h for h in CSV_HEADERS if h not in present and CSV_HEADERS[h] not in present)
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    out = []
    for field in RAW_SCHEMA.fields:
        src = next((h for h, c in CSV_HEADERS.items() if c == field.name and h in present), None)
        if src is None and field.name in present:
            src = field.name
        out.append(_strict(src, field.dataType).alias(field.name) if src else F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)


def _strict(name: str, kind: T.DataType) -> Column:
    """The column cast to ``kind``; a value that it cannot hold raises whatever
    the session's ANSI setting."""
    c = F.col(name)
    tried = c.try_cast(kind)
    return F.when(c.isNotNull() & tried.isNull(), F.raise_error(F.concat(
        F.lit(f"Not a {kind.simpleString()} in {name}: "), c.cast("string"))).cast(kind)).otherwise(tried)
