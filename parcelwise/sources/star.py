"""The order-line view over a star schema of trade tables.

One row per line item. All joins are left joins to a unique key, so they never change the number of rows; a table that
feeds none of the requested columns is therefore left out of the plan. Asking for ``sales`` alone scans one table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: shipping mode and promised days by order priority
MODES = {"1-URGENT": ("Same Day", 0), "2-HIGH": ("First Class", 1), "3-MEDIUM": ("Second Class", 2)}
OTHER_MODE = ("Standard Class", 4)

CANCELED = ("SUSPECTED_FRAUD", "CANCELED")


def _by_priority(position: int) -> Column:
    priority = F.col("o_orderpriority")
    branches = iter(MODES.items())
    first, values = next(branches)
    expr = F.when(priority == first, F.lit(values[position]))
    for name, values in branches:
        expr = expr.when(priority == name, F.lit(values[position]))
    return expr.when(priority.isNotNull(), F.lit(OTHER_MODE[position]))


def _order_status() -> Column:
    order, line = F.col("o_orderstatus"), F.col("l_returnflag")
    return (
        F.when((order == "P") & (line == "R"), "SUSPECTED_FRAUD")
        .when((order == "P") & (line == "A"), "CANCELED")
        .when(order == "P", "PENDING")
        .when((order == "O") & (line == "N"), "PROCESSING")
        .when(order == "O", "ON_HOLD")
        .when((order == "F") & (line == "N"), "CLOSED")
        .when(order == "F", "COMPLETE")
    )


def _payment_type() -> Column:
    # fixed values: payment type by order number
    kinds = F.array(*[F.lit(k) for k in ("CASH", "DEBIT", "PAYMENT", "TRANSFER")])
    return kinds[(F.col("o_orderkey") % 4).cast("int")]


def _definitions() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Column name -> (expression, tables it needs beyond lineitem)."""
    line_id = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.col("l_shipdate").cast("date").cast("string"),
    )
    scheduled = _by_priority(1)
    real = F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(7))
    status = _order_status()
    canceled = status.isin(*CANCELED)
    total = F.col("l_extendedprice") * (F.lit(1).cast("double") - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    delivery = (
        F.when(canceled, "Shipping canceled")
        .when(real > scheduled, "Late delivery")
        .when(real == scheduled, "Shipping on time")
        .when(real < scheduled, "Advance shipping")
    )
    orders, customer, part, supplier = ("orders",), ("orders", "customer"), ("part",), ("supplier",)
    return {
        "line_id": (line_id, ()),
        "order_id": (F.col("o_orderkey"), orders),
        "customer_id": (F.col("o_custkey"), orders),
        "order_ts": (F.col("o_orderdate"), orders),
        "order_region": (F.col("n_name"), (*customer, "nation")),
        "market": (F.col("r_name"), (*customer, "nation", "region")),
        "source_market": (F.col("sr_name"), (*supplier, "s_nation", "s_region")),
        "order_country": (F.col("sn_name"), (*supplier, "s_nation")),
        "order_city": (F.col("s_name"), supplier),
        "customer_segment": (F.col("c_mktsegment"), customer),
        "category_name": (F.col("p_brand"), part),
        "department_name": (F.col("p_type"), part),
        "shipping_mode": (_by_priority(0), orders),
        "days_scheduled": (scheduled, orders),
        "days_real": (real, orders),
        "order_status": (status, orders),
        "payment_type": (_payment_type(), orders),
        "sales": (F.col("l_extendedprice"), ()),
        "quantity": (F.col("l_quantity"), ()),
        "discount_rate": (F.col("l_discount"), ()),
        "product_price": (F.col("p_retailprice"), part),
        "item_total": (total, ()),
        "benefit": (total - cost, part),
        "profit_ratio": ((total - cost) / F.nullif(F.greatest(total, cost), F.lit(0).cast("double")), part),
        "delivery_status": (delivery, orders),
        "late_risk": (F.when((real > scheduled) & ~canceled, 1).when(real.isNotNull(), 0), orders),
    }


def order_line_columns() -> list[str]:
    """Names of all columns the view offers, without needing a session at import time."""
    return list(_definitions())


def dealt_out(scan: DataFrame, key: str) -> DataFrame:
    """A scan that comes in fewer pieces than there are cores, such as one small file, spread over them.

    Large tables have more pieces than that and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def order_lines(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The order lines below ``path`` with the requested columns (all by default)."""
    wanted = _definitions()
    if columns is not None:
        wanted = {c: wanted[c] for c in dict.fromkeys(columns)}
    needed = {t for _, tables in wanted.values() for t in tables}

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    df = dealt_out(table("lineitem"), "l_orderkey")
    # before the orders: lines go through a shuffle with each large table, so the widest one comes last
    if "part" in needed:
        df = df.join(table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "orders" in needed:
        # an order's customer is found once, not for each of its lines
        orders = table("orders")
        if "customer" in needed:
            orders = orders.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        if "nation" in needed:
            orders = orders.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if "region" in needed:
            orders = orders.join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "supplier" in needed:
        df = df.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if "s_nation" in needed:
        origin = table("nation").select(
            F.col("n_nationkey").alias("sn_nationkey"),
            F.col("n_name").alias("sn_name"),
            F.col("n_regionkey").alias("sn_regionkey"),
        )
        df = df.join(origin, F.col("s_nationkey") == F.col("sn_nationkey"), "left")
    if "s_region" in needed:
        origin = table("region").select(F.col("r_regionkey").alias("sr_regionkey"), F.col("r_name").alias("sr_name"))
        df = df.join(origin, F.col("sn_regionkey") == F.col("sr_regionkey"), "left")
    return df.select(*[expr.alias(name) for name, (expr, _) in wanted.items()])


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events as timed rows with a 0/1 label, for the measures that need a time of day."""
    return spark.read.parquet(f"{path}/events.parquet").select(
        F.col("ts").alias("order_ts"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("late_risk")
    )
