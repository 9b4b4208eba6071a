"""Per-query plan context: lazily composed shared grains for one input."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.operators import grains, quality, repair, rollups
from tillpoint.session import apply_sql_conf
from tillpoint.sources.adapter import read_extract
from tillpoint.sources.extract import RAW_SCHEMA
from tillpoint.sources.staging import staged, staging_enabled


class Ctx:
    """Shared sub-plans of one query.  The first use of a staged table in an
    application writes it, unless an earlier application has; everything else
    is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        apply_sql_conf(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def extract(self) -> DataFrame:
        """Raw extract plus its repaired line columns, staged once per input and
        clustered by month, so that a date window reads its months alone."""
        return staged(self.spark, self.sf_dir,
                      lambda: repair.repaired_extract(read_extract(self.spark, self.sf_dir, many_to_one=True,
                                                                   by_month=staging_enabled())),
                      clustered_by="invoice_month", rebalanced=True)

    @cached_property
    def raw(self) -> DataFrame:
        return self.extract.select(*RAW_SCHEMA.fieldNames())

    @cached_property
    def lines(self) -> DataFrame:
        return self.extract.select(*repair.LINE_COLUMNS)

    @cached_property
    def series_lines(self) -> DataFrame:
        """The lines under the codes that are forecast: product lines."""
        return self.extract.select(*[F.col("product_line").alias(c) if c == "stock_code" else F.col(c)
                                     for c in repair.LINE_COLUMNS])

    @cached_property
    def invoice_facts(self) -> DataFrame:
        """Invoice grain plus per-invoice checks, staged once per input:
        most marts read it, and it is far smaller than the lines.  An extract
        that breaks its contract is refused here, before any mart reads it."""
        return staged(self.spark, self.sf_dir, lambda: grains.invoice_full(self.lines), name="invoices",
                      check=lambda invoices: quality.validate(self.raw, invoices))

    @cached_property
    def activity(self) -> DataFrame:
        """Customer bitmaps and sums by month and country, staged once per
        input: every roll-up of months or countries reads it alone."""
        return staged(self.spark, self.sf_dir, lambda: rollups.activity(self.invoices), name="activity")

    @cached_property
    def invoices(self) -> DataFrame:
        return self.invoice_facts.select(*grains.INVOICE_COLUMNS)

    @cached_property
    def status(self) -> DataFrame:
        return grains.invoice_status(self.invoices)

    @cached_property
    def customers(self) -> DataFrame:
        # The as-of date is the latest repaired timestamp: the max of each
        # invoice's latest, so the lines are not scanned again.
        latest = self.invoice_facts.select(F.col("last_ts").alias("invoice_date"))
        return grains.customers(self.invoices, latest)
