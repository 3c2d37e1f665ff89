"""Entropy, survival and centrality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present
from parcelwise.functions.small import checkpointed
from parcelwise.operators.crosstab import row_shares

# two-sided 95% point of the normal distribution
Z95 = 1.959963984540054


def entropy_by(df: DataFrame, dim: str = "order_region", state: str = "delivery_status") -> DataFrame:
    """Shannon entropy, in bits, of the states within each key. States without rows contribute nothing."""
    shares = row_shares(df, dim, state).where(F.col("share") > 0)
    bits = -F.sum(F.col("share") * F.ln("share")) / math.log(2)
    return shares.groupBy(dim).agg(bits.alias("entropy_bits")).orderBy(F.desc("entropy_bits"), dim)


def mean_entropy(df: DataFrame, dim: str = "order_region", state: str = "delivery_status") -> DataFrame:
    return entropy_by(df, dim, state).agg(F.avg("entropy_bits").alias("mean_entropy_bits"))


def risk_edges(
    df: DataFrame, src: str = "source_market", dst: str = "order_region", measure: str = "late_risk"
) -> DataFrame:
    """Directed edges between two dimensions, weighted by the mean of a measure."""
    return (
        df.where(all_present(src, dst))
        .groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"))
        .agg(F.avg(measure).alias("weight"))
        .orderBy("src", "dst")
    )


def eigenvector_centrality(
    edges: DataFrame, top: int = 15, tolerance: float = 1e-10, max_rounds: int = 500, rounds_per_cut: int = 10
) -> DataFrame:
    """Principal eigenvector of the undirected weighted graph, unit length: ``(node, centrality)``.

    Edges from one set of nodes to another have no eigenvector of their own, so each edge counts both ways. Every node
    also has an edge of weight 1 to itself, which shifts all eigenvalues by one and stops the iteration from swinging
    between the two sides. One round is one join and one aggregation over the edges; the values are scaled, compared
    and checkpointed every ``rounds_per_cut`` rounds. A graph that has not settled after ``max_rounds`` is an error.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    loops = both.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1).cast("double"))
    links = checkpointed(both.union(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    value = checkpointed(links.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1).cast("double")))
    for _ in range(0, max_rounds, rounds_per_cut):
        raw = value
        for _ in range(rounds_per_cut):
            sent = links.join(raw.withColumnRenamed("node", "src"), "src")
            raw = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        raw = checkpointed(raw)
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if not norm:
            break  # no nodes
        scaled = raw.select("node", (F.col("x") / F.lit(norm)).alias("x"))
        moved = scaled.join(value.withColumnRenamed("x", "old"), "node")
        change = moved.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        value = scaled
        if change < tolerance:
            break
    else:
        raise RuntimeError(f"centrality still moves by {change:.1e} after {max_rounds} rounds")
    ranked = value.select("node", F.col("x").alias("centrality"))
    return ranked.orderBy(F.desc(F.round("centrality", 9)), "node").limit(top)


def kaplan_meier(
    df: DataFrame,
    dim: str = "shipping_mode",
    duration: str = "days_real",
    observed: str | None = None,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Survival curve per key with a 95% log-log band: ``(dim, t, at_risk, events, survival, ci_low, ci_high)``.

    Without ``observed`` every row ends in an event; otherwise rows with a 0 there are censored. The curve runs over
    distinct durations, one row each.
    """
    rows = df.where(all_present(dim, duration))
    if values is not None:
        rows = rows.where(F.col(dim).isin(*values))
    event = F.lit(1) if observed is None else F.coalesce(F.col(observed).cast("int"), F.lit(0))
    steps = rows.groupBy(dim, F.col(duration).alias("t")).agg(
        F.count("*").alias("leaving"), F.sum(event).cast("long").alias("events")
    )
    onwards = W.partitionBy(dim).orderBy("t").rowsBetween(0, W.unboundedFollowing)
    sofar = W.partitionBy(dim).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("at_risk", F.sum("leaving").over(onwards))
    stay = (F.col("at_risk") - F.col("events")) / F.col("at_risk")
    # a product as a sum of logs; once everyone at risk has had the event, survival is 0 from there on
    emptied = F.max(F.when(stay == 0, 1).otherwise(0)).over(sofar) == 1
    log_stay = F.when(stay > 0, F.ln(stay)).otherwise(F.lit(0).cast("double"))
    survival = F.when(emptied, F.lit(0).cast("double")).otherwise(F.exp(F.sum(log_stay).over(sofar)))
    term = F.try_divide(
        F.col("events").cast("double"), (F.col("at_risk") * (F.col("at_risk") - F.col("events"))).cast("double")
    )
    steps = steps.withColumns({"survival": survival, "_var": F.sum(term).over(sofar), "_emptied": emptied})
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    log_s = F.ln(F.when(inner, F.col("survival")))
    reach = F.sqrt("_var") * Z95 / -log_s
    return steps.select(
        dim,
        "t",
        "at_risk",
        "events",
        "survival",
        F.exp(log_s * F.exp(reach)).alias("ci_low"),
        F.exp(log_s * F.exp(-reach)).alias("ci_high"),
    ).orderBy(dim, "t")


def median_survival(curve: DataFrame, dim: str = "shipping_mode", level: float = 0.5) -> DataFrame:
    """First duration at which survival is at or below the level; null if it never is."""
    reached = F.min(F.when(F.round("survival", 12) <= level, F.col("t")))
    return curve.groupBy(dim).agg(reached.alias("median_days")).orderBy(dim)
