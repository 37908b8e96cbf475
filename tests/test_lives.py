"""Order lives and the questions on them, on hand-written orders."""

from __future__ import annotations

import pytest
from book import Book, at
from pyspark.sql import functions as F

from bookloom.functions import lives as L
from bookloom.operators.lifecycle import lifecycle_table
from bookloom.plans import lives


def life(spark, book, order_id="X"):
    row = lifecycle_table(book.frame(spark)).where(F.col("order_id") == order_id)
    return row.withColumns(
        {
            "bucket": L.lifetime_bucket(),
            "state": L.terminal_state(),
            "class": L.behavior_class(),
            "liquidity": L.liquidity_class(),
        }
    ).first()


@pytest.mark.parametrize(
    ("delay", "klass", "liquidity"),
    [
        (0.05, "aggressive", "aggressive_took_liquidity"),
        (0.1, "mixed", "passive_provided_liquidity"),
        (0.101, "mixed", "passive_provided_liquidity"),
        (61.0, "likely_passive", "passive_provided_liquidity"),
        (60.0, "mixed", "passive_provided_liquidity"),
    ],
)
def test_first_fill(spark, delay, klass, liquidity):
    row = life(spark, Book().event("X", 6).event("X", 3, delay, left=0.0))
    assert (row["class"], row.liquidity) == (klass, liquidity)
    assert row.time_to_first_fill_seconds == pytest.approx(delay)


@pytest.mark.parametrize(("delay", "klass"), [(0.999, "likely_hft"), (1.0, "mixed")])
def test_fleeting_cancel(spark, delay, klass):
    row = life(spark, Book().event("X", 6).event("X", 1, delay))
    assert (row["class"], row.state) == (klass, "3_cancelled_no_fill")


@pytest.mark.parametrize(
    ("delay", "bucket"),
    [
        (0.0999, "1_sub_0.1s"),
        (0.1, "2_0.1-1s"),
        (1.0, "3_1-5s"),
        (5.0, "4_5-30s"),
        (30.0, "5_30s-5min"),
        (300.0, "6_5-30min"),
        (1800.0, "7_gt30min"),
        (-1.0, "0_unknown"),
    ],
)
def test_bucket_bounds(spark, delay, bucket):
    book = Book().event("X", 6, after=min(delay, 0.0)).event("X", 1, delay)
    assert life(spark, book).bucket == bucket


def test_unknown_lifetime(spark):
    assert life(spark, Book().event("X", 6, after=None)).bucket == "0_unknown"


def test_expired(spark):
    book = Book().event("X", 6).event("X", 19, 5.0)
    book.event("Y", 6).event("Y", 3, 2.0, left=40.0).event("Y", 19, 5.0)
    x, y = life(spark, book), life(spark, book, "Y")
    assert (x.bucket, x.state, x["class"]) == ("8_eod", "4_expired_no_fill", "likely_passive")
    assert (y.bucket, y.state) == ("8_eod", "2_partially_filled")
    assert (x.ever_cancelled, x.ever_expired) == (1, 1)


@pytest.mark.parametrize(
    ("left", "state"), [(1.1, "2_partially_filled"), (1.0, "1_fully_filled")]
)
def test_nearly_filled(spark, left, state):
    book = Book().event("X", 6).event("X", 3, 2.0, left=left).event("X", 1, 3.0)
    assert life(spark, book).state == state


def test_traded_lots_are_cumulative(spark):
    book = Book().event("X", 6).event("X", 3, 1.0, left=60.0).event("X", 3, 2.0, left=0.0)
    row = life(spark, book)
    assert row.traded_lots == 100.0
    assert (row.event_count, row.n_modifications, row.ever_traded) == (3, 0, 1)


def test_open_partial_fill(spark):
    book = Book().event("X", 6).event("X", 3, 1.0, left=60.0)
    assert life(spark, book).state == "5_other_open"


def test_orders_left_out(spark):
    book = Book().event("X", 6).event("noNEW", 5).event("quote", 6, cat=4).event("report", 6, cat=32)
    book.event("noTime", 6, born=None)
    assert [r.order_id for r in lifecycle_table(book.frame(spark)).collect()] == ["X"]


def test_checks(spark):
    book = Book().event("late", 6, after=-5.0)
    book.event("early", 6).event("early", 3, -1.0, left=0.0)
    book.event("over", 6).event("over", 3, 1.0, qty=200.0, left=0.0)
    book.event("fine", 6).event("fine", 3, 1.0, left=0.0).event("fine", 1, 3.0)
    row = lives.lifecycle_summary(lifecycle_table(book.frame(spark))).first()
    assert (row.total_orders, row.n_ever_traded, row.n_ever_cancelled) == (4, 3, 1)
    assert (row.sanity_neg_lifetime, row.sanity_neg_fill_lag, row.sanity_overfilled) == (1, 1, 1)
    assert row.n_no_terminal_event == 1
    assert row.median_lifetime_s == 0.5


def test_both_forms_agree(spark, sf_dir):
    from bookloom.sources.activity import load_order_events

    events = load_order_events(spark, sf_dir)
    full = lifecycle_table(events).drop("n_qualifying_improvements")
    plain = lifecycle_table(events, improvements=False)
    assert full.exceptAll(plain).isEmpty() and plain.exceptAll(full).isEmpty()


def test_shares_add_up(spark, sf_dir):
    from bookloom.sources.activity import load_order_events

    table = lifecycle_table(load_order_events(spark, sf_dir), improvements=False)
    n = table.count()
    for frame in (
        lives.lifetime_buckets(table),
        lives.behavior_classes(table),
        lives.conversion_funnel(table),
        lives.liquidity(table),
    ):
        total = frame.agg(F.sum("n_orders"), F.sum("pct_orders")).first()
        assert total[0] == n
        assert total[1] == pytest.approx(100.0, abs=0.05)


def test_passive_share_is_empty_without_passive_fills(spark):
    table = lifecycle_table(Book().event("X", 6).event("X", 3, 0.01, left=0.0).frame(spark))
    assert lives.passive_share(lives.traded_lots_source(table)).isEmpty()


def test_windows_use_the_clock_only(spark):
    book = Book().event("X", 6, born=at("17:10"), session="PAY_KAPANIS")
    row = lives.fleeting_by_window(lifecycle_table(book.frame(spark))).first()
    assert row.time_window == "17:00-17:30"
