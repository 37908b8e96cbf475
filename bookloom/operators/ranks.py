"""Exact medians and running totals without sorting everything in one task.

Values are grouped into slots of nearly equal relative width. The slot number
never falls when the value rises, so slots are in value order, and their number
is bounded by the range of a double, not by the rows. Sums over slots are
small; only rows of the same slot are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slots per doubling of the value: one slot spans about 0.017 % of its value.
SLOTS_PER_DOUBLING = 4096
# Values this small are told apart by the slots: a microsecond, a millionth.
UNITS = 1e6
# Beyond every slot of a finite double.
LAST_SLOT = 10_000_000


def value_slot(x: Column) -> Column:
    """Slot number of a double; monotone, negative for negative values.

    A value of n units shares its slot with fewer than n / 5000 + 2 other whole
    units, whatever the number of rows. Infinite values share one slot at either
    end; NaN comes last, as in a sort.
    """
    size = F.log2(F.abs(x) * F.lit(UNITS) + F.lit(1.0)) * F.lit(float(SLOTS_PER_DOUBLING))
    bounded = F.least(F.floor(size), F.lit(LAST_SLOT - 1))
    return F.when(F.isnan(x), LAST_SLOT).otherwise((F.signum(x) * bounded).cast("bigint"))


SLOT = "_slot"
IN_SLOT = "_in_slot"


def slotted(frame: DataFrame, value: str, by: Sequence[str], *more: Column) -> DataFrame:
    """Per group and slot of the non-NULL values their number, and further aggregates.

    Rows are combined before the shuffle, so what is shuffled is a few thousand rows
    per group and task, however many values there are.
    """
    return (
        frame.groupBy(*by, value_slot(F.col(value)).alias(SLOT))
        .agg(F.count(value).alias(IN_SLOT), *more)
    )


def _middle(slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """The one or two slots of each group that hold its middle, and the ranks wanted."""
    up = Window.partitionBy(*by).orderBy(SLOT)
    return (
        slots.where(F.col(SLOT).isNotNull())
        .select(
            *by,
            SLOT,
            (F.sum(IN_SLOT).over(up) - F.col(IN_SLOT)).alias("_below"),
            IN_SLOT,
            F.sum(IN_SLOT).over(Window.partitionBy(*by)).alias("_all"),
        )
        .withColumn("_low", F.floor((F.col("_all") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_all") / 2))
        .where(f"_below <= _high and _below + {IN_SLOT} > _low")
        .select(*by, SLOT, "_below", "_low", "_high")
    )


def exact_median(
    frame: DataFrame, value: str, by: Sequence[str] = (), slots: DataFrame | None = None
) -> DataFrame:
    """Columns ``by`` plus ``median`` of the non-NULL values of each group.

    With an even number, the mean of the two in the middle. Radix selection: the
    numbers of values per slot (``slots``, if they were counted already) tell which slot
    holds the middle; a second look at the frame shuffles only that slot's values.
    ``by`` must have a bounded number of groups, as the wanted slots are broadcast.
    """
    by = list(by)
    middle = _middle(slotted(frame, value, by) if slots is None else slots, by)
    values = frame.select(
        *by, F.col(value).alias("_v"), value_slot(F.col(value)).alias(SLOT)
    ).alias("f")
    keys = [*by, SLOT]
    narrowed = values.join(
        F.broadcast(middle).alias("m"),
        [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys],
    )
    wanted = ["_below", "_low", "_high"]
    counted = narrowed.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], "_v", *wanted).agg(
        F.count("*").alias("_n")
    )
    inside = Window.partitionBy(*keys).orderBy("_v")
    ranked = counted.withColumn("_upto", F.col("_below") + F.sum("_n").over(inside))

    def at(rank: str) -> Column:
        holds = (F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_n") <= F.col(rank))
        return F.max(F.when(holds, F.col("_v")))

    return ranked.groupBy(*by).agg(((at("_low") + at("_high")) / 2).alias("median"))


# One over the largest error in rank, as a share of the rows, of an approximate median.
ACCURACY = 10_000


def approximate_median(value: str, accuracy: int = ACCURACY) -> Column:
    """A value within 1 / ``accuracy`` of the middle rank, from mergeable sketches: one pass."""
    return F.percentile_approx(value, 0.5, accuracy)


def total_before(frame: DataFrame, value: str, tie: str) -> DataFrame:
    """Add ``total_before``: the sum of all larger values (ties in order of ``tie``).

    Also adds ``total_all``. Rows with a NULL value come last and add nothing.
    """
    slotted = frame.withColumn("_slot", value_slot(F.col(value)))
    down = (
        Window.partitionBy()
        .orderBy(F.col("_slot").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slots = (
        slotted.groupBy("_slot")
        .agg(F.sum(value).alias("_in_slot"))
        .select(
            F.col("_slot").alias("_of"),
            F.sum("_in_slot").over(down).alias("_before"),
            F.sum("_in_slot").over(Window.partitionBy()).alias("total_all"),
        )
    )
    inside = (
        Window.partitionBy("_slot")
        .orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = slotted.withColumn("_inside", F.sum(value).over(inside))
    zero = F.lit(0.0)
    return (
        within.join(slots, F.col("_slot").eqNullSafe(F.col("_of")))
        .withColumn(
            "total_before",
            F.coalesce(F.col("_before"), zero) + F.coalesce(F.col("_inside"), zero),
        )
        .drop("_slot", "_of", "_before", "_inside")
    )


def largest(frame: DataFrame, measure: str, label: str, k: int = 1) -> DataFrame:
    """The k rows with the largest measure; equal measures in order of the label."""
    return frame.orderBy(
        F.col(measure).desc_nulls_last(), F.col(label).asc_nulls_last()
    ).limit(k)

