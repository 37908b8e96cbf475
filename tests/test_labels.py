"""Labels of single events."""

from __future__ import annotations

import pytest
from book import Book, at
from pyspark.sql import functions as F

from bookloom.functions import events as E
from bookloom.functions.numbers import micros_between, minute_number, minute_start, round_to
from bookloom.functions.sessions import broad_session, session_window


@pytest.mark.parametrize(
    ("clock", "session", "window", "broad"),
    [
        ("09:00", "PAY_SUREKLI", "A_OPENING", "1_Opening"),
        ("09:59:59.999", "PAY_SUREKLI", "A_OPENING", "1_Opening"),
        ("10:00", "PAY_SUREKLI", "10:00-10:30", "2_Midday"),
        ("10:29:59", "PAY_SUREKLI", "10:00-10:30", "2_Midday"),
        ("10:30", "PAY_SUREKLI", "10:30-11:00", "2_Midday"),
        ("17:59", "PAY_SUREKLI", "17:30-18:00", "2_Midday"),
        ("18:00", "PAY_SUREKLI", "Z_CLOSING", "3_Closing"),
        ("11:00", "PAY_ACS_EMR", "A_OPENING", "1_Opening"),
        ("11:00", "PAY_ACSXEMR", "A_OPENING", "1_Opening"),
        ("11:00", "PAY_ACILIS", "A_OPENING", "1_Opening"),
        ("17:00", "PAY_KAPANIS", "Z_CLOSING", "3_Closing"),
        ("17:00", "PAY_ESLESTIRMETEKFIYAT", "Z_CLOSING", "3_Closing"),
        ("09:00", "PAY_KAPANIS", "A_OPENING", "1_Opening"),
        ("12:15", None, "12:00-12:30", "2_Midday"),
        ("09:15", None, "A_OPENING", "1_Opening"),
        (None, "PAY_SUREKLI", None, "2_Midday"),
        (None, "PAY_KAPANIS", "Z_CLOSING", "3_Closing"),
        (None, None, None, "2_Midday"),
    ],
)
def test_windows(spark, clock, session, window, broad):
    born = at(clock) if clock else None
    row = (
        Book().event("X", 6, born=born, session=session).frame(spark)
        .select(session_window("entry_ts", "session"), broad_session("entry_ts", "session"))
        .first()
    )
    assert tuple(row) == (window, broad)


def test_window_without_session_name_ignores_it(spark):
    frame = Book().event("X", 6, born=at("11:10"), session="PAY_ACILIS").frame(spark)
    assert frame.select(session_window("entry_ts")).first()[0] == "11:00-11:30"


@pytest.mark.parametrize(
    ("side", "price", "prev_price", "qty", "prev_qty", "reason", "expected", "text"),
    [
        ("A", 10.5, 10.0, 100.0, 100.0, 5, 1, "IMPROVED: price +0.5000 (better)"),
        ("A", 9.5, 10.0, 100.0, 100.0, 5, 0, "no improvement — price -0.5000 (worse)"),
        ("S", 9.5, 10.0, 100.0, 100.0, 5, 1, "IMPROVED: price -0.5000 (better)"),
        ("S", 10.5, 10.0, 100.0, 100.0, 5, 0, "no improvement — price +0.5000 (worse)"),
        ("A", 10.0, 10.0, 150.0, 100.0, 5, 1, "IMPROVED: qty +50"),
        ("A", 10.0, 10.0, 50.0, 100.0, 5, 0, "no improvement — qty -50 (reduced)"),
        ("A", 10.5, 10.0, 50.0, 100.0, 5, 1,
         "IMPROVED: price +0.5000 (better)  |  also: qty -50 (reduced)"),
        ("S", 10.5, 10.0, 150.0, 100.0, 5, 1,
         "IMPROVED: qty +50  |  also: price +0.5000 (worse)"),
        ("A", 10.0, 10.0, 100.0, 100.0, 5, 0, "no change"),
        ("A", 10.0, None, 150.0, 100.0, 5, 0, "first row — nothing to compare"),
        ("A", None, 10.0, 150.0, 100.0, 5, 1, "IMPROVED: qty +50"),
        ("A", 10.5, 10.0, 150.0, 100.0, 3, 0, "-"),
    ],
)
def test_improvement(spark, side, price, prev_price, qty, prev_qty, reason, expected, text):
    row = spark.createDataFrame(
        [(reason, side, price, prev_price, qty, prev_qty)],
        "change_reason int, side string, price double, prev_price double, qty double, "
        "prev_qty double",
    ).select(E.improves_queue_entry(), E.change_text())
    assert tuple(row.first()) == (expected, text)


def test_reason_names(spark):
    codes = spark.createDataFrame([(6,), (43,), (99,), (None,)], "code int")
    names = [r[0] for r in codes.select(E.reason_name("code")).collect()]
    assert names == ["NEW", "CROSSING_DEL", "reason_99", "nan"]


def test_meaning(spark):
    frame = spark.range(4).select(E.versions_meaning("id").alias("m"))
    texts = [r.m for r in frame.collect()]
    assert texts[0].startswith("Order was never improved")
    assert texts[3] == "3 improvements — highly active order management"


def test_iceberg(spark):
    book = Book().event("A", 6, visible=None).event("B", 6, visible=100.0).event("C", 6, visible=10.0)
    flags = [r[0] for r in book.frame(spark).orderBy("event_id").select(E.is_iceberg()).collect()]
    assert flags == [False, False, True]


def test_rounding_scales_first(spark):
    values = spark.createDataFrame([(32.535,), (2.5,), (-2.5,), (0.125,)], "x double")
    two = [r[0] for r in values.select(round_to("x", 2)).collect()]
    same = [r[0] for r in values.select(round_to(F.col("x"), 2)).collect()]
    assert two == same == [32.53, 2.5, -2.5, 0.13]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_time_arithmetic_has_no_zone(spark, zone):
    """Across the hour that some zones skip in spring."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql(
            "SELECT timestamp_ntz'2024-03-10 01:30:00.000001' a, "
            "timestamp_ntz'2024-03-31 03:30:59.5' b"
        ).select(
            micros_between("a", "b"),
            micros_between("b", "a"),
            minute_number("b"),
        )
        forward, back, minute = row.first()
        assert forward == 1_821_659_499_999
        assert back == -forward
        start = spark.sql(f"SELECT {minute}L m").select(minute_start("m").cast("string"))
        assert start.first()[0] == "2024-03-31 03:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
