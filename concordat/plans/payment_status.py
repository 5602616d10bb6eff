"""The payment-status job: open and paid invoices with vendor terms and tax taken off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(6, 4)

# The job's inputs under their output names, by the table they come from.
INVOICE_COLUMNS = {
    "belnr": "invoice_id",
    "sap_vendor_id": "vendor_id",
    "payment_status_raw": "payment_status",
    "waers": "currency",
    "wrbtr": "gross_amount",
    "mwskz": "tax_code",
    "bldat": "posting_date",
    "zfbdt": "payment_date",
    "zlsch": "payment_method",
}
REPORTED_STATUSES = ["PAID", "PENDING"]
OUTPUT_COLUMNS = [
    "invoice_id",
    "vendor_id",
    "vendor_name",
    "country_code",
    "payment_terms",
    "payment_status",
    "currency",
    "gross_amount",
    "tax_code",
    "tax_rate",
    "net_amount",
    "posting_date",
    "payment_date",
    "payment_method",
]


def net_amount(gross, rate):
    """Decimal money: binary doubles round half-cents either way."""
    return F.round(gross.cast(MONEY) * (F.lit(1).cast(RATE) - rate.cast(RATE)), 2).cast(MONEY)


def payment_status(
    invoices: DataFrame,
    vendors: DataFrame,
    tax_rates: DataFrame,
    statuses: list[str] | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Unmatched vendors and tax codes leave nulls. ``limit`` takes the first invoices by id.

    The reference tables carry no broadcast hint: Spark broadcasts a side whose measured
    size is under its threshold and sort-merges one that is not.
    """
    wanted = invoices.where(F.col("payment_status_raw").isin(statuses or REPORTED_STATUSES))
    joined = wanted.join(vendors, "sap_vendor_id", "left").join(
        tax_rates.withColumnRenamed("tax_code", "mwskz"), "mwskz", "left"
    )
    out = joined.withColumn("net_amount", net_amount(F.col("wrbtr"), F.col("tax_rate")))
    out = out.withColumnsRenamed(INVOICE_COLUMNS).select(*OUTPUT_COLUMNS)
    return out.orderBy("invoice_id").limit(limit) if limit is not None else out
