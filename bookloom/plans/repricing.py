"""How often orders are improved, overall and per stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import events as E
from bookloom.functions.numbers import round_to, share
from bookloom.operators.lifecycle import IMPROVEMENTS, order_states
from bookloom.operators.runs import PIECE_ROWS
from bookloom.operators.samples import sample_orders
from bookloom.plans.lives import version_counts


def max_versions(
    events: DataFrame, fraction: float = 1.0, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Last version number of each regular order (the number of its improvements)."""
    return order_states(sample_orders(events, fraction), piece_rows, fills=False).select(
        "order_id", "stock", F.col(IMPROVEMENTS).alias("max_version")
    )


def version_distribution(versions: DataFrame, rows: int | None = None) -> DataFrame:
    """Orders per number of improvements; the first rows of the table if so asked."""
    counts = version_counts(versions, "max_version", "times_improved")
    return counts if rows is None else counts.limit(rows)


def distribution_meaning(distribution: DataFrame) -> DataFrame:
    return distribution.withColumn("meaning", E.versions_meaning("times_improved"))


def repricing_by_stock(versions: DataFrame, min_orders: int = 10, k: int = 20) -> DataFrame:
    """Stocks with most improved orders, among those with enough orders."""
    improved = F.col("max_version") > 0
    return (
        versions.groupBy("stock")
        .agg(
            F.count("*").alias("total_orders"),
            F.sum(F.when(improved, 1).otherwise(0)).alias("orders_with_improvements"),
            round_to(F.avg(F.when(improved, F.col("max_version"))), 2).alias(
                "avg_versions_when_improved"
            ),
        )
        .where(F.col("total_orders") >= min_orders)
        .withColumn(
            "pct_improved",
            round_to(share(F.col("orders_with_improvements"), F.col("total_orders")), 2),
        )
        .orderBy(F.col("orders_with_improvements").desc(), F.col("stock").asc_nulls_last())
        .limit(k)
        .select(
            "stock",
            "total_orders",
            "orders_with_improvements",
            "pct_improved",
            "avg_versions_when_improved",
        )
    )
