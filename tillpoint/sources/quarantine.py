"""Split a delivery into rows that meet the extract's contract and rows that
do not, in one pass.

The strict readers fail a load at its first bad value.  Here every row is
read as texts, judged, and written once: accepted rows with their typed
columns, refused ones with all their reasons, the file they came from and
the record as it stood.  Both halves of a write come from the same job, so
their counts add up to the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.functions.columns import TS_FORMAT
from tillpoint.sources.extract import CSV_HEADERS, RAW_SCHEMA

BROKEN = "_broken_record"
FILE = "_file"
# Must hold a value; must be above zero.
NEEDED = ("invoice_no", "customer_id", "invoice_date_text")
POSITIVE = ("quantity", "unit_price")


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of the CSV files in ``path``; contract columns must be there."""
    names = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    if missing := sorted(set(CSV_HEADERS) - set(names)):
        raise ValueError(f"Missing columns: {missing}")
    return names


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """All records of the CSV files, as texts by header name, with their file."""
    schema = text_schema(header_of(spark, path))
    rows = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
            .option("columnPruning", False).csv(path))  # else surplus fields of columns not asked for go unseen
    return rows.select("*", F.col("_metadata.file_path").alias(FILE))


def _source(df: DataFrame, name: str) -> str | None:
    header = next((h for h, c in CSV_HEADERS.items() if c == name and h in df.columns), None)
    return header or (name if name in df.columns else None)


def judged(texts: DataFrame) -> DataFrame:
    """The contract columns (NULL where a text does not fit its type), the
    ``reasons`` against each row (none: accepted), its ``file``, and for a
    refused row the ``record``, its texts as JSON.

    ``texts`` holds texts by header or contract name; a record with too few or
    too many fields comes in the column ``BROKEN``, its file in ``FILE``."""
    if missing := sorted(c for c in CSV_HEADERS.values() if _source(texts, c) is None):
        raise ValueError(f"Missing columns: {missing}")
    kept = {f.name: _source(texts, f.name) for f in RAW_SCHEMA.fields}
    typed = {f.name: F.col(f"`{kept[f.name]}`").try_cast(f.dataType) if kept[f.name] else F.lit(None).cast(f.dataType)
             for f in RAW_SCHEMA.fields}
    reasons: list[Column] = []
    if BROKEN in texts.columns:
        reasons.append(F.when(F.col(BROKEN).isNotNull(), "broken record"))
    for f in RAW_SCHEMA.fields:
        if kept[f.name] and f.dataType != T.StringType():
            reasons.append(F.when(F.col(f"`{kept[f.name]}`").isNotNull() & typed[f.name].isNull(),
                                  F.lit(f"{f.name}: not a {f.dataType.simpleString()}")))
    reasons += [F.when(F.col(f"`{kept[c]}`").isNull(), F.lit(f"{c}: missing")) for c in NEEDED]
    date = F.col(f"`{kept['invoice_date_text']}`")
    reasons.append(F.when(date.isNotNull() & F.try_to_timestamp(date, F.lit(TS_FORMAT)).isNull(),
                          F.lit("invoice_date_text: not a timestamp")))
    reasons += [F.when(typed[c] <= 0, F.lit(f"{c}: not positive")) for c in POSITIVE]
    rows = texts.select(*[e.alias(c) for c, e in typed.items()], F.array_compact(F.array(*reasons)).alias("reasons"),
                        (F.col(FILE) if FILE in texts.columns else F.lit(None).cast("string")).alias("file"),
                        F.to_json(F.struct(*[c for c in texts.columns if c != FILE])).alias("record"))
    return rows.withColumn("record", F.when(F.size("reasons") > 0, F.col("record")))


def _halves(rows: DataFrame) -> DataFrame:
    return rows.withColumn("accepted", F.size("reasons") == 0)


def write_split(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``judged`` rows, accepted and refused each in a folder of its own."""
    _halves(rows).write.mode(mode).partitionBy("accepted").parquet(path)


def write_split_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """The same for a stream: one query and one commit log for both halves."""
    w = (_halves(rows).writeStream.format("parquet").option("path", path).partitionBy("accepted")
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def _schema() -> T.StructType:
    return T.StructType([*RAW_SCHEMA.fields, T.StructField("reasons", T.ArrayType(T.StringType())),
                         T.StructField("file", T.StringType()), T.StructField("record", T.StringType()),
                         T.StructField("accepted", T.BooleanType())])


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The accepted rows (contract columns) and the refused ones of a written split."""
    rows = spark.read.schema(_schema()).parquet(path)
    return (rows.where("accepted").select(*RAW_SCHEMA.fieldNames()), rows.where("NOT accepted").drop("accepted"))


def counts(rows: DataFrame) -> DataFrame:
    """One row: the rows, those accepted, those refused, and the reasons given."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") == 0).alias("accepted"),
                    F.count_if(F.size("reasons") > 0).alias("refused"),
                    F.coalesce(F.sum(F.size("reasons")), F.lit(0)).cast("bigint").alias("reasons"))
