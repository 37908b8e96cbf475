"""Order versions, also for orders too large for one task."""

from __future__ import annotations

from datetime import timedelta

import pytest
from book import Book, at
from pyspark.sql import functions as F

from bookloom.operators import samples
from bookloom.operators.lifecycle import lifecycle_table, lives, merge_states, order_states
from bookloom.operators.runs import large_orders, order_runs, piece_borders
from bookloom.operators.versions import (
    enrich_events,
    order_detail,
    order_detail_header,
    version_summary,
    version_summary_display,
    versioned_events,
    with_fills,
)
from bookloom.plans import repricing, reports
from bookloom.sources.activity import load_order_events, order_events


def digest(frame):
    """Number of rows and a sum of their hashes, with the places of NULLs."""
    columns = [F.col(c) for c in sorted(frame.columns)]
    row = F.xxhash64(*[c.isNull() for c in columns], *columns).cast("decimal(20,0)")
    return tuple(frame.agg(F.count("*"), F.sum(row)).first())


def same(one, other):
    return sorted(one.columns) == sorted(other.columns) and digest(one) == digest(other)


def repriced() -> Book:
    book = Book().event("X", 6)
    book.event("X", 5, 1.0, price=10.5)  # version 1
    book.event("X", 5, 2.5, price=10.2)  # worse
    book.event("X", 3, 3.0, price=10.2, left=50.0)
    book.event("X", 5, 4.0, price=10.2, qty=150.0)  # version 2
    book.event("X", 19, 9.0, price=10.2, qty=150.0)
    return book


def test_numbering(spark):
    rows = versioned_events(repriced().frame(spark)).orderBy("change_ts").collect()
    assert [r.sub_order_number for r in rows] == [0, 1, 1, 1, 2, 2]
    assert [r.qualifies for r in rows] == [0, 1, 0, 0, 1, 0]
    assert rows[-1].composite_id == "X_2"


def test_summary(spark):
    frame = repriced().frame(spark)
    rows = version_summary(frame).orderBy("composite_id").collect()
    assert [(r.composite_id, r.version_price, r.version_qty, r.version_duration_s) for r in rows] == [
        ("X_0", 10.0, 100.0, 1.0),
        ("X_1", 10.5, 100.0, 3.0),
        ("X_2", 10.2, 150.0, None),
    ]
    shown = version_summary_display(version_summary(frame)).orderBy("composite_id").collect()
    assert [r.version_duration_s for r in shown] == ["1.00s", "3.00s", "(ongoing)"]
    assert shown[0].version_end_ts == "2026-05-06 10:00:01.000000"
    assert shown[2].version_end_ts == "(last version — see order events)"


def test_no_new_event_no_version_zero(spark):
    book = Book().event("X", 5, 1.0, price=10.0).event("X", 5, 2.0, price=11.0)
    frame = book.frame(spark)
    assert [r.composite_id for r in version_summary(frame).collect()] == ["X_1"]
    assert enrich_events(frame).count() == 2


def test_null_previous_price_blocks(spark):
    book = Book().event("X", 6, price=None).event("X", 5, 1.0, qty=200.0, price=9.0)
    book.event("Y", 6).event("Y", 5, 1.0, qty=200.0, price=None)
    rows = {r.order_id: r for r in versioned_events(book.frame(spark)).where("change_reason=5").collect()}
    assert (rows["X"].qualifies, rows["Y"].qualifies) == (0, 1)


def test_equal_times_use_the_tie_break(spark):
    book = Book().event("X", 6).event("X", 5, 1.0, price=11.0).event("X", 5, 1.0, price=10.5)
    rows = versioned_events(book.frame(spark)).orderBy("event_id").collect()
    assert [r.qualifies for r in rows] == [0, 1, 0]
    # Without an event id: NEW first, then the larger remaining size.
    plain = Book().event("X", 5, price=11.0, left=100.0).event("X", 6).event("X", 3, price=11.0, left=40.0)
    rows = versioned_events(plain.frame(spark).drop("event_id")).collect()
    order = [r.change_reason for r in sorted(rows, key=lambda r: (r.sub_order_number, r.change_reason))]
    assert sorted(order) == [3, 5, 6]
    assert {r.change_reason: r.sub_order_number for r in rows} == {6: 0, 5: 1, 3: 1}


def test_only_regular_orders(spark):
    book = Book().event("X", 6).event("quote", 6, cat=4).event("report", 6, cat=32)
    assert [r.order_id for r in enrich_events(book.frame(spark)).collect()] == ["X"]


def test_detail_and_header(spark):
    detail = order_detail(repriced().frame(spark))
    rows = detail.orderBy("change_ts").collect()
    assert [r.event for r in rows] == ["NEW", "REPLACED", "REPLACED", "TRADE", "REPLACED", "EXPIRED"]
    assert rows[4].improvement == "IMPROVED: qty +50"
    assert (rows[1].qualified, rows[2].qualified, rows[0].side_full) == ("YES", "", "BUY (alis)")
    head = order_detail_header(detail).first()
    assert (head.n_versions, head.n_improvements) == (3, 2)


def test_lookup(spark):
    frame = repriced().event("Z", 6).frame(spark)
    found = reports.lookup(frame, "X")
    assert [r.event for r in found["order_detail"].collect()][0] == "NEW"
    assert found["order_detail"].count() == 6 and found["version_summary"].count() == 3
    assert all(f.isEmpty() for f in reports.lookup(frame, "none").values())


def test_lookup_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    load_order_events(spark, sf_dir).write.parquet(path)
    frame = order_detail(samples.lookup_order(spark.read.parquet(path), "O6-2024-01-04"))
    assert "EqualTo(order_id,O6-2024-01-04)" in frame._jdf.queryExecution().toString()


def test_modified_orders(spark):
    book = Book()
    for name, n in (("A", 2), ("B", 3), ("C", 4), ("D", 1)):
        book.event(name, 6)
        for i in range(n):
            book.event(name, 5, i + 1.0)
    frame = book.frame(spark)

    def ids(f, **kw):
        return sorted(r.order_id for r in samples.modified_orders(f, **kw).collect())

    assert ids(frame) == ["B", "C"]
    assert ids(frame, n=1) == ["B"]
    assert ids(frame.where("order_id IN ('A', 'D')")) == ["A"]
    assert ids(frame.where("order_id = 'D'")) == []


def test_sample_keeps_whole_orders(spark, sf_dir):
    events = load_order_events(spark, sf_dir)
    picked = samples.sample_orders(events, 0.1)
    ids = picked.select("order_id").distinct()
    assert 0 < ids.count() < events.select("order_id").distinct().count()
    assert same(picked, samples.events_of(events, ids))
    assert samples.sample_orders(events, 1.0) is events


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """A third of all rows in one order, some in the order without id, equal times."""
    events = load_order_events(spark, sf_dir)
    order_id = F.when(F.col("event_id") % 3 == 0, "HOT").when(
        F.col("event_id") % 10 != 1, F.col("order_id")
    )
    return events.withColumns(
        {
            "order_id": order_id,
            "side": F.lit("A"),
            "change_ts": F.expr(
                "CASE WHEN event_id % 7 = 0 THEN timestamp_ntz'2024-01-10 00:00:00' "
                "WHEN event_id % 11 = 0 THEN NULL ELSE change_ts END"
            ),
        }
    )


LIMIT = 40


WHOLE = 10**9


def test_large_orders_are_found(skewed):
    """The sketch names every order above the limit, the order without id too."""
    counts = {r.order_id: r["count"] for r in skewed.groupBy("order_id").count().collect()}
    named = {None if n is None else f"={n}": c for n, c in counts.items() if c > LIMIT}
    named = {k or "": c for k, c in named.items()}
    assert "=HOT" in named and "" in named
    assert {r["_hot"]: r["_rows"] for r in large_orders(skewed, LIMIT).collect()} == named
    assert large_orders(skewed, WHOLE).isEmpty() and piece_borders(skewed, WHOLE).isEmpty()


def test_large_orders_are_cut_evenly(skewed):
    rows = order_runs(skewed, LIMIT).rows
    assert rows.where("_cut").select("order_id").distinct().count() == 2
    assert rows.where("NOT _cut AND _piece <> 0").isEmpty()
    pieces = rows.where("_cut").groupBy("order_id", "_piece").count().collect()
    assert len(pieces) > 5 and max(r["count"] for r in pieces) < 3 * LIMIT
    # Pieces follow one another in time, the rows without one last.
    hot = {}
    for r in rows.where("order_id = 'HOT'").collect():
        late = (r.change_ts is None, r.change_ts, r.entry_ts, r.event_id)
        hot.setdefault(r["_piece"], []).append(tuple("" if x is None else str(x) for x in late))
    ends = [edge for p in sorted(hot) for edge in (min(hot[p]), max(hot[p]))]
    assert ends == sorted(ends)


@pytest.mark.parametrize("operator", [versioned_events, enrich_events, version_summary, order_detail])
@pytest.mark.parametrize("piece_rows", [1, LIMIT])
def test_cut_orders_give_the_same_rows(skewed, operator, piece_rows):
    plain, cut = operator(skewed, piece_rows=WHOLE), operator(skewed, piece_rows=piece_rows)
    assert cut.columns == plain.columns
    assert not plain.isEmpty() and same(plain, cut)


def test_nine_rows_in_ten_in_one_order(spark, sf_dir):
    events = load_order_events(spark, sf_dir).withColumn(
        "order_id", F.when(F.col("event_id") % 10 != 0, "HOT").otherwise(F.col("order_id"))
    )
    for operator in (enrich_events, lifecycle_table, version_summary):
        assert same(operator(events, piece_rows=WHOLE), operator(events, piece_rows=50))
    sizes = order_runs(events, 50).rows.groupBy("order_id", "_piece").count()
    assert sizes.agg(F.max("count")).first()[0] < 200


def test_ties_without_event_ids_are_cut_too(skewed):
    events = skewed.drop("event_id")
    assert same(lifecycle_table(events, piece_rows=WHOLE), lifecycle_table(events, piece_rows=LIMIT))
    plain, cut = version_summary(events, piece_rows=WHOLE), version_summary(events, piece_rows=LIMIT)
    assert same(plain, cut)


def test_cut_lifecycle(skewed):
    plain = lifecycle_table(skewed, piece_rows=WHOLE)
    for by_fill in (False, True):
        whole = lifecycle_table(skewed, piece_rows=WHOLE, by_fill=by_fill)
        assert same(whole, lifecycle_table(skewed, piece_rows=LIMIT, by_fill=by_fill))
    assert plain.where("order_id IS NULL").count() == 1


def test_cut_repricing(skewed):
    plain = repricing.max_versions(skewed, piece_rows=WHOLE)
    assert same(plain, repricing.max_versions(skewed, piece_rows=LIMIT))


def test_cut_fills(skewed):
    plain = with_fills(skewed, WHOLE)
    assert same(plain, with_fills(skewed, LIMIT))
    assert plain.where("fill_lots < 0").isEmpty() and not plain.where("fill_lots > 0").isEmpty()


def test_fills_by_hand(spark):
    book = Book().event("X", 6)
    for after, left in ((1.0, 70.0), (2.0, 40.0), (3.0, 55.0), (4.0, 0.0)):
        book.event("X", 3, after, left=left)
    book.event("X", 3, 5.0, qty=None, left=1.0)
    frame = book.frame(spark)
    lots = [r.fill_lots for r in with_fills(frame).where("change_reason = 3").orderBy("event_id").collect()]
    assert lots == [30.0, 30.0, 0.0, 55.0, None]
    assert lifecycle_table(frame, by_fill=True).first().traded_lots == 115.0
    assert lifecycle_table(frame).first().traded_lots == 100.0


@pytest.mark.parametrize("parts", [2, 5, 50])
def test_states_of_stretches_merge(skewed, parts):
    """Any cut of the events in time order, also one inside every order."""
    events = skewed.where("change_ts IS NOT NULL")
    edges = events.select(F.percentile_approx("change_ts", [k / parts for k in range(1, parts)])).first()[0]
    stretch = sum([(F.col("change_ts") > F.lit(e)).cast("int") for e in edges], F.lit(0))
    cut = events.withColumn("stretch", stretch)
    states = order_states(cut, keys=("order_id", "stretch")).drop("stretch")
    for by_fill in (False, True):
        assert same(lives(merge_states(states), by_fill=by_fill), lifecycle_table(events, by_fill=by_fill))
    # Merging is associative: first the early ones, then the rest.
    early = order_states(cut.where("stretch = 0"))
    late = order_states(cut.where("stretch > 0"))
    both = merge_states(early.unionByName(late))
    assert same(lives(both), lifecycle_table(events))


def test_ids_used_again(spark):
    book = Book()
    for day in (0, 1):
        born = at("10:00") + timedelta(days=day)
        book.event("X", 6, born=born, price=10.0 + 5 * day)
        book.event("X", 5, 1.0, born=born, price=20.0)
    frame = book.frame(spark).withColumn("entry_day", F.to_date("entry_ts"))
    by_id = enrich_events(frame).orderBy("event_id").collect()
    assert [r.sub_order_number for r in by_id] == [0, 1, 1, 2]
    by_day = enrich_events(frame, keys=("order_id", "entry_day")).orderBy("event_id").collect()
    assert [r.composite_id for r in by_day] == [f"X_2026-05-0{d}_{n}" for d in (6, 7) for n in (0, 1)]
    assert lifecycle_table(frame, keys=("order_id", "entry_day")).count() == 2


def test_hot_activity_gives_the_same_events(spark, sf_dir):
    activity = spark.read.parquet(f"{sf_dir}/events.parquet")
    one_user = F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id"))
    one_day = F.expr(
        "CASE WHEN event_id % 3 = 0 THEN timestamp_ntz'2024-01-05 10:00:00' "
        "+ make_dt_interval(0, 0, event_id % 50) ELSE ts END"
    )
    crowded = activity.withColumns({"user_id": one_user, "ts": one_day})
    plain = order_events(crowded)
    split = order_events(crowded, hot_order_rows=200)
    assert "Union" in split._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plain._jdf.queryExecution().analyzed().toString()
    assert same(plain, split)


def test_nothing_runs_while_plans_are_built(spark, sf_dir):
    from bookloom import catalog

    context = spark.sparkContext
    for name, query in catalog.queries().items():
        if name.startswith("sink_"):  # they write first
            continue
        context.setJobGroup(f"build {name}", name)
        query(spark, sf_dir)
        assert context.statusTracker().getJobIdsForGroup(f"build {name}") == [], name
    context.setLocalProperty("spark.jobGroup.id", None)


def test_one_shuffle_for_versions_and_lives(spark, tmp_path, sf_dir):
    """Without large orders nothing is left of what would deal with them."""
    path = str(tmp_path / "events")
    load_order_events(spark, sf_dir).write.parquet(path)
    for operator in (lifecycle_table, enrich_events, version_summary):
        frame = operator(spark.read.parquet(path))
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        final = plan[: plan.index("== Initial Plan ==")]
        assert final.count("Exchange hashpartitioning") == 1
        assert "Join" not in final and "SinglePartition" not in final
        assert "Python" not in plan and "Arrow" not in plan
