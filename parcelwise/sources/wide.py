"""The 53-column order-line table: schema, readers, and its renaming to the working column names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the columns of the source table in file order, with their types
WIDE_COLUMNS = {
    "Type": "string",
    "Days for shipping (real)": "int",
    "Days for shipment (scheduled)": "int",
    "Benefit per order": "double",
    "Sales per customer": "double",
    "Delivery Status": "string",
    "Late_delivery_risk": "int",
    "Category Id": "long",
    "Category Name": "string",
    "Customer City": "string",
    "Customer Country": "string",
    "Customer Email": "string",
    "Customer Fname": "string",
    "Customer Id": "long",
    "Customer Lname": "string",
    "Customer Password": "string",
    "Customer Segment": "string",
    "Customer State": "string",
    "Customer Street": "string",
    "Customer Zipcode": "string",
    "Department Id": "long",
    "Department Name": "string",
    "Latitude": "double",
    "Longitude": "double",
    "Market": "string",
    "Order City": "string",
    "Order Country": "string",
    "Order Customer Id": "long",
    "order date (DateOrders)": "timestamp",
    "Order Id": "long",
    "Order Item Cardprod Id": "long",
    "Order Item Discount": "double",
    "Order Item Discount Rate": "double",
    "Order Item Id": "long",
    "Order Item Product Price": "double",
    "Order Item Profit Ratio": "double",
    "Order Item Quantity": "int",
    "Sales": "double",
    "Order Item Total": "double",
    "Order Profit Per Order": "double",
    "Order Region": "string",
    "Order State": "string",
    "Order Status": "string",
    "Order Zipcode": "string",
    "Product Card Id": "long",
    "Product Category Id": "long",
    "Product Description": "string",
    "Product Image": "string",
    "Product Name": "string",
    "Product Price": "double",
    "Product Status": "int",
    "shipping date (DateOrders)": "timestamp",
    "Shipping Mode": "string",
}

# fixed values: working names of the columns the operators use; every other column gets its snake-case name
WORKING_NAMES = {
    "Order Item Id": "line_id",
    "Late_delivery_risk": "late_risk",
    "Days for shipping (real)": "days_real",
    "Days for shipment (scheduled)": "days_scheduled",
    "order date (DateOrders)": "order_ts",
    "shipping date (DateOrders)": "shipping_ts",
    "Type": "payment_type",
    "Order Item Quantity": "quantity",
    "Order Item Discount Rate": "discount_rate",
    "Order Item Product Price": "item_price",
    "Order Item Profit Ratio": "profit_ratio",
    "Order Item Total": "item_total",
    "Benefit per order": "benefit",
    "Order Customer Id": "order_customer_id",
}


def wide_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.DataType.fromDDL(t)) for c, t in WIDE_COLUMNS.items()])


def working_name(name: str) -> str:
    name = name.strip()
    known = {k.lower(): v for k, v in WORKING_NAMES.items()}
    return known.get(name.lower()) or re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def with_working_names(df: DataFrame) -> DataFrame:
    """Rename every column; values are left alone, spaces included. ``market`` doubles as the origin market."""
    df = df.select(*[F.col(f"`{c}`").alias(working_name(c)) for c in df.columns])
    if "market" in df.columns and "source_market" not in df.columns:
        df = df.withColumn("source_market", F.col("market"))
    if "line_id" in df.columns:
        df = df.withColumn("line_id", F.col("line_id").cast("string"))
    return df


def parse_time(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """Text to timestamp; text that does not fit the format becomes null."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(fmt)))


def read_wide_csv(
    spark: SparkSession, path: str, time_format: str = "M/d/yyyy H:mm", encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Read the wide table from delimited text.

    The header of one file gives the order of the columns and their padding, which may differ from the declared ones;
    every file is checked against it as it is read, and one with another header is an error. The types are declared, so
    there is no inference pass over the data. Time columns are read as text and parsed with ``time_format``.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False)
    kinds = {c.lower(): "string" if t == "timestamp" else t for c, t in WIDE_COLUMNS.items()}
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.DataType.fromDDL(kinds.get(c.strip().lower(), "string"))) for c in header])
    df = with_working_names(reader.schema(schema).csv(path))
    for c in ("order_ts", "shipping_ts"):
        if c in df.columns:
            df = parse_time(df, c, time_format)
    return df


def read_wide_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_working_names(spark.read.parquet(path))


def unparsed_numbers(text: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column of texts, how many are present and how many of these don't fit its declared type."""
    kinds = {working_name(c): t for c, t in WIDE_COLUMNS.items()}
    counts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("n_text"),
            F.count(F.when(F.col(c).isNotNull() & F.trim(c).try_cast(kinds[c]).isNull(), 1)).alias("n_failed"),
        )
        for c in columns
    ]
    return text.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def unparsed_times(text: DataFrame, column: str, fmt: str) -> DataFrame:
    """How many present time texts do not fit the format."""
    parsed = F.try_to_timestamp(F.col(column), F.lit(fmt))
    return text.agg(
        F.count(column).alias("n_text"), F.count(F.when(F.col(column).isNotNull() & parsed.isNull(), 1)).alias("n_failed")
    )
