"""Leakage audit, column removal and date parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import col

# fixed values: columns known only after delivery, personal data, identifiers, and a redundant total
LEAKING = ("delivery_status", "days_real")
PERSONAL = (
    "customer_email", "customer_password", "customer_fname", "customer_lname", "customer_street", "customer_zipcode",
)
EMPTY_OR_IDS = (
    "product_description", "product_image", "order_zipcode", "order_item_cardprod_id", "product_card_id", "order_id",
    "line_id", "order_customer_id", "customer_id", "item_total",
)
# fixed values: columns with too many levels, or that repeat a modelled category
HIGH_CARDINALITY = (
    "customer_city", "customer_state", "order_city", "order_state", "order_country", "product_name",
    "product_status", "category_id", "department_id", "product_category_id",
)


def leakage_audit(
    df: DataFrame, real: str = "days_real", scheduled: str = "days_scheduled", label: str = "late_risk"
) -> DataFrame:
    """Share of rows where "took longer than promised" equals the label. A missing day count counts as not longer."""
    longer = F.coalesce(F.col(real) - F.col(scheduled) > 0, F.lit(False)).cast("int")
    agrees = F.coalesce(longer == F.col(label), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.avg(agrees.cast("double")).alias("agreement"))


def with_date_parts(df: DataFrame, ts: str = "order_ts") -> DataFrame:
    """Month, weekday (Monday is 0), year, hour, day of month and quarter of a timestamp."""
    t = col(ts)
    return df.withColumns(
        {
            "order_month": F.month(t),
            "order_weekday": F.weekday(t),
            "order_year": F.year(t),
            "order_hour": F.hour(t),
            "order_day": F.dayofmonth(t),
            "order_quarter": F.quarter(t),
        }
    )


def clean(df: DataFrame, ts: str = "order_ts") -> DataFrame:
    """Drop what leaks the label, personal data and identifiers, and turn the order time into date parts."""
    df = df.drop(*LEAKING, *PERSONAL, *EMPTY_OR_IDS)
    if ts in df.columns:
        df = with_date_parts(df, ts).drop("order_day", "order_quarter")
    return df.drop(ts, "shipping_ts")


def model_columns(df: DataFrame) -> DataFrame:
    """The columns kept for modelling: a cleaned table without its high-cardinality columns."""
    return df.drop(*HIGH_CARDINALITY)


def with_delay(df: DataFrame, real: str = "days_real", scheduled: str = "days_scheduled") -> DataFrame:
    return df.withColumn("delay", F.col(real) - F.col(scheduled))
