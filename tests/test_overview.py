"""Market questions on hand-written orders, and on facts and cube alike."""

from __future__ import annotations

from datetime import timedelta

import pytest
from book import DAY, Book, at
from pyspark.sql import functions as F

from bookloom.operators.ranks import exact_median, total_before, value_slot
from bookloom.plans import overview
from bookloom.sources.activity import load_order_events


def test_trades_are_summed(spark):
    book = Book().event("X", 6).event("X", 3, 1.0, left=60.0).event("X", 3, 2.0, left=0.0)
    row = overview.cancel_to_trade(overview.facts(book.frame(spark))).first()
    assert (row.traded_lots, row.cancelled_lots, row.cancel_to_trade_ratio) == (140.0, 0.0, 0.0)


def test_concentration(spark):
    book = Book().event("X", 6, qty=60.0).event("Y", 6, qty=40.0, stock="BBB.E")
    book.event("Z", 6, qty=900.0, stock="CCC.V")
    row = overview.concentration(overview.facts(book.frame(spark))).first()
    assert tuple(row) == (2, 2, 3, 1, 2)


def test_other_categories_do_not_count(spark):
    book = Book().event("X", 6).event("Q", 6, cat=4).event("T", 6, cat=32)
    assert overview.new_order_totals(overview.facts(book.frame(spark))).first()[0] == 1


def test_icebergs(spark):
    book = Book().event("A", 6).event("B", 6, visible=100.0).event("C", 6, visible=10.0, kind=2)
    row = overview.order_types(overview.facts(book.frame(spark))).first()
    assert (row.iceberg_count, row.iceberg_lots, row.limit_count) == (1, 100.0, 2)
    assert row.iceberg_pct_count == pytest.approx(100 / 3)


def test_rolling_reaches_back_thirty_minutes(spark):
    book = Book().event("a", 6, born=at("10:00"))
    book.event("b", 6, born=at("10:30")).event("c", 6, born=at("10:31"))
    rows = overview.rolling_intensity(book.frame(spark)).collect()
    assert [r.rolling_order_count for r in rows] == [1, 2, 2]


def test_rolling_crosses_midnight_and_long_windows(spark):
    book = Book()
    for hours in (0, 10, 23.9, 24.1, 24.2, 47, 60, 100):
        book.event(f"o{hours}", 6, born=DAY + timedelta(hours=hours))
    frame = book.frame(spark)
    near = [r.rolling_order_count for r in overview.rolling_intensity(frame).collect()]
    assert near == [1, 1, 1, 2, 3, 1, 1, 1]
    far = [r.rolling_order_count for r in overview.rolling_intensity(frame, 3000).collect()]
    assert far == [1, 2, 3, 4, 5, 6, 6, 2]


def test_peak_needs_trades(spark):
    book = Book().event("X", 6)
    assert overview.peak_windows(overview.facts(book.frame(spark))).isEmpty()
    book.event("X", 3, 3600.0, left=0.0)
    row = overview.peak_windows(overview.facts(book.frame(spark))).first()
    assert (row.peak_order_window, row.peak_trade_window, row.same_window) == (
        "10:00-10:30",
        "11:00-11:30",
        False,
    )


def test_closing_callout(spark):
    frame = Book().event("X", 6).event("Y", 6, born=at("18:05"), qty=70.0).frame(spark)
    assert tuple(overview.largest_orders_closing(frame).first()) == (1, 70.0)
    assert tuple(overview.largest_orders_closing(frame.where("order_id = 'X'")).first()) == (0, 0.0)


def test_empty_input(spark):
    empty = Book().event("X", 6).frame(spark).where("false")
    fact = overview.facts(empty)
    assert tuple(overview.new_order_totals(fact).first()) == (0, None, None)
    assert overview.buy_sell(fact).isEmpty()
    assert overview.busiest_to_calmest(fact).isEmpty()
    assert overview.average_lots_peak(fact).isEmpty()
    assert overview.order_types(fact).first().limit_pct_count is None
    rate = overview.cancel_rate(fact).first()
    assert (rate.pct_lots, rate.pct_tl) == (0.0, 0.0)


def test_unknown_time_has_no_window(spark):
    frame = Book().event("X", 6, born=None).event("Y", 6).frame(spark)
    rows = overview.window_volumes(overview.facts(frame)).collect()
    assert [r.time_window for r in rows] == ["10:00-10:30", None]


ON_FACTS = [
    overview.new_order_totals,
    overview.buy_sell,
    overview.top_stocks,
    overview.top_stocks_share,
    overview.window_volumes,
    overview.window_peaks,
    overview.window_counts,
    overview.busiest_to_calmest,
    overview.order_types,
    overview.cancel_totals,
    overview.expiry_breakdown,
    overview.cancel_windows,
    overview.cancel_peak,
    overview.cancel_to_trade,
    overview.cancel_rate,
    overview.volume_overlap,
    overview.peak_windows,
    overview.concentration,
    overview.average_lots,
]


@pytest.fixture(scope="module")
def cube(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "cube")
    overview.fact_cube(load_order_events(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("question", ON_FACTS)
def test_cube_answers_like_facts(question, spark, sf_dir, cube):
    one = question(overview.facts(load_order_events(spark, sf_dir))).toPandas()
    other = question(cube).toPandas()
    assert list(one.columns) == list(other.columns)
    keys = [c for c in one.columns if one[c].dtype == object]
    if keys:
        one, other = one.sort_values(keys), other.sort_values(keys)
    for c in one.columns:
        if one[c].dtype.kind == "f":
            assert one[c].tolist() == pytest.approx(other[c].tolist(), nan_ok=True)
        else:
            assert one[c].tolist() == other[c].tolist()


@pytest.mark.parametrize(
    "values",
    [[1.0], [1.0, 2.0], [5.0, -3.0, 5.0, 0.0], [-1.5, -2.5, -2.5], [1e-6, 2e-6, 4e-6], [0.0] * 7,
     [1e9, 1e9 + 1, 1e9 + 2, None], [float("inf"), 1.0, 2.0], [float("nan"), 3.0, 1.0, -1e300, 7.0],
     [float("-inf"), 1e308, 4.0]],
)
def test_median(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    expected = frame.agg(F.median("x")).first()[0]
    assert exact_median(frame, "x").first()[0] == pytest.approx(expected)


def test_median_by_group(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
        ((F.col("id") * 7919) % 1009 / 7.0 - 50).alias("x"),
    )
    expected = {r.g: r.m for r in frame.groupBy("g").agg(F.median("x").alias("m")).collect()}
    got = {r.g: r.median for r in exact_median(frame, "x", ["g"]).collect()}
    assert got.keys() == expected.keys() and None in got
    assert all(got[g] == pytest.approx(expected[g]) for g in got)
    assert exact_median(frame.where("x IS NULL"), "x").first()[0] is None


def test_slots_follow_the_values(spark):
    values = spark.range(-3000, 3000).select((F.col("id") * F.abs("id") * 0.37).alias("x"))
    slots = [r.s for r in values.orderBy("x").select(value_slot(F.col("x")).alias("s")).collect()]
    assert slots == sorted(slots)


def test_total_before(spark):
    rows = [("a", 5.0), ("b", 9.0), ("c", 5.0), ("d", None), ("e", 1.0)]
    frame = spark.createDataFrame(rows, "name string, x double")
    got = {r.name: (r.total_before, r.total_all) for r in total_before(frame, "x", "name").collect()}
    assert got == {"b": (0, 20), "a": (9, 20), "c": (14, 20), "e": (19, 20), "d": (20, 20)}
