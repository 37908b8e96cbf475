"""Raw files, the event table, result tables and whole reports."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bookloom import schema as S
from bookloom.operators.lifecycle import lifecycle_table
from bookloom.operators.versions import enrich_events, version_summary
from bookloom.operators import samples
from bookloom.plans import daily, overview, reports
from bookloom.sources import sinks
from bookloom.sources.activity import load_order_events, raw_text
from bookloom.sources.order_files import (
    by_table,
    ingest_events,
    parse_lines,
    raw_columns,
    read_audited_events,
    read_event_table,
    read_events,
    read_raw_events,
    read_rejected,
    save_event_table,
    scan_losses,
    typed_events,
    write_event_table,
)

HEADER = ";".join([*S.RAW_COLUMNS, "EK ALAN"])
GOOD = "A1;XXXXX.E;A;PAY_SUREKLI;2026-05-06 10:00:00.000;2026-05-06 10:00:00.050;100;30;10;12.34;6;1;0;1;note"
BAD_NUMBER = "A2;XXXXX.E;A;PAY_SUREKLI;2026-05-06 10:00:00;when;100;30;;n/a;6.7;x;0;1;note"


@pytest.fixture
def raw_file(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("\n".join([HEADER, GOOD, BAD_NUMBER, "A3;short", GOOD + ";long"]) + "\n")
    return str(path)


def test_bad_rows_are_left_out(spark, raw_file):
    raw = read_raw_events(spark, raw_file)
    assert raw.count() == 2
    assert raw.select("FIYAT").count() == 2
    assert {t for _, t in raw.dtypes} == {"string"}


def test_typed_columns(spark, raw_file):
    events = read_events(spark, raw_file)
    good, bad = events.orderBy("order_id").collect()
    assert good.order_tl == 1234.0 and good.change_ts == datetime(2026, 5, 6, 10, 0, 0, 50000)
    assert (good.change_reason, good.visible_qty, good["EK ALAN"]) == (6, 10.0, "note")
    assert (bad.change_ts, bad.price, bad.order_tl, bad.visible_qty, bad.order_type) == (None,) * 5
    assert bad.change_reason == 7
    assert dict(events.dtypes)["entry_ts"] == "timestamp_ntz"


def test_losses_of_raw_lines(spark):
    lines = spark.createDataFrame([(x,) for x in (GOOD, BAD_NUMBER, "A3;short", GOOD + ";long", "")], "value string")
    parsed = parse_lines(lines, [*S.RAW_COLUMNS, "EK ALAN"])
    lost = {r["column"]: r["lost"] for r in scan_losses(parsed).collect()}
    assert lost["_rejected"] >= 2
    assert (lost["change_ts"], lost["price"], lost["order_type"], lost["entry_ts"]) == (1, 1, 1, 0)


def test_other_time_formats(spark):
    row = GOOD.replace("2026-05-06 10:00:00.000", "06.05.2026 10:00:00").replace("2026-05-06 10:00:00.050", "06.05.2026 10:00:01")
    lines = spark.createDataFrame([(row,)], "value string")
    parsed = parse_lines(lines, [*S.RAW_COLUMNS, "EK ALAN"])
    assert {r["column"]: r["lost"] for r in scan_losses(parsed).collect()}["entry_ts"] == 1
    assert {r["lost"] for r in scan_losses(parsed, "dd.MM.yyyy HH:mm:ss").collect()} == {0}
    event = typed_events(parsed, "dd.MM.yyyy HH:mm:ss").first()
    assert event.change_ts == datetime(2026, 5, 6, 10, 0, 1)


def final_plan(frame) -> str:
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_bucketed_table_needs_no_shuffle_by_order(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir)
    save_event_table(events, "bucketed_events", 4, str(tmp_path / "bucketed"))
    try:
        table = spark.table("bucketed_events").select(*events.columns)
        for plan in (lifecycle_table, enrich_events, version_summary):
            assert "Exchange hashpartitioning(order_id" not in final_plan(plan(table))
        assert spark.table("bucketed_events_large").isEmpty()
        found = by_table(spark, "bucketed_events", lambda t: enrich_events(t.select(*events.columns)))
        assert found.exceptAll(enrich_events(events)).isEmpty()
        assert found.count() == enrich_events(events).count()
    finally:
        spark.sql("DROP TABLE bucketed_events")
        spark.sql("DROP TABLE bucketed_events_large")


def test_large_orders_get_a_table_beside_the_buckets(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir).withColumn(
        "order_id", F.when(F.col("event_id") % 3 == 0, "HOT").otherwise(F.col("order_id"))
    )
    save_event_table(events, "mixed_events", 4, str(tmp_path / "mixed"), piece_rows=50)
    try:
        assert spark.table("mixed_events").where("order_id = 'HOT'").isEmpty()
        large = spark.table("mixed_events_large")
        assert [r.order_id for r in large.select("order_id").distinct().collect()] == ["HOT"]
        for question in (lifecycle_table, version_summary):
            found = by_table(spark, "mixed_events", lambda t: question(t, piece_rows=50))
            assert found.exceptAll(question(events)).isEmpty() and found.count() == question(events).count()
    finally:
        spark.sql("DROP TABLE mixed_events")
        spark.sql("DROP TABLE mixed_events_large")


@pytest.fixture(scope="module")
def stored_table(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "table")
    write_event_table(load_order_events(spark, sf_dir), path)
    return path


def files_read(frame) -> int:
    """Files whose rows reach the query."""
    return frame.select(F.input_file_name()).distinct().count()


def test_a_sample_reads_its_folders(spark, sf_dir, stored_table):
    events = load_order_events(spark, sf_dir)
    table = read_event_table(spark, stored_table)
    for fraction in (0.01, 0.05, 0.1, 0.004):
        picked, plain = (samples.sample_orders(t, fraction) for t in (table, events))
        assert picked.select(*events.columns).exceptAll(plain).isEmpty()
        assert picked.count() == plain.count()
    scan = [x for x in final_plan(samples.sample_orders(table, 0.01)).split("\n") if "PartitionFilters" in x]
    assert "key_slot" in scan[0].split("PartitionFilters")[1].split("PushedFilters")[0]
    folders = table.select("key_slot").distinct().count()
    read = spark.read.parquet(stored_table).where("key_slot % 100 = 0").select("key_slot").distinct().count()
    assert folders > 50 and read <= 1


def test_a_lookup_reads_one_folder(spark, stored_table):
    table = read_event_table(spark, stored_table)
    wanted = table.select("order_id").first()[0]
    found = samples.lookup_order(table, wanted)
    assert found.select("order_id").distinct().count() == 1
    assert found.select("key_slot").distinct().count() == 1
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_id" in shown
    assert "key_slot" in shown.split("PartitionFilters")[1].split("PushedFilters")[0]
    # Every file has a bloom filter on the id: an id that no file holds reads no row group.
    from pathlib import Path

    import pyarrow.parquet as pq

    footer = pq.ParquetFile(next(Path(stored_table).rglob("*.parquet")))
    assert "order_id" in footer.schema.names
    assert samples.lookup_order(table, "no 'such' \\ order").isEmpty()


def test_chosen_orders_prune_folders(spark, sf_dir, stored_table):
    """The slots of the chosen orders prune the scan of their events while the query runs."""
    events = load_order_events(spark, sf_dir)
    table = read_event_table(spark, stored_table)
    chosen = samples.modified_orders(table)
    found = samples.events_of(table, chosen)
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in shown.lower()
    plain = samples.events_of(events, samples.modified_orders(events))
    assert found.select(*events.columns).exceptAll(plain).isEmpty() and found.count() == plain.count()


def test_ingest_counts_and_keeps_what_it_rejects(spark, raw_file, tmp_path):
    table = str(tmp_path / "table")
    lost = ingest_events(spark, raw_file, table)
    assert (lost["lines"], lost["_rejected"]) == (4, 2)
    assert (lost["change_ts"], lost["price"], lost["order_type"], lost["qty"]) == (1, 1, 1, 0)
    events = read_event_table(spark, table)
    assert sorted(r.order_id for r in events.collect()) == ["A1", "A2"]
    assert {r["_rejected"] for r in read_rejected(spark, table).collect()} == {"A3;short", GOOD + ";long"}
    typed = read_events(spark, raw_file)
    assert events.select(*typed.columns).exceptAll(typed).isEmpty()
    assert enrich_events(events, keep=raw_columns(typed)).count() == 2


def test_ingest_reads_the_files_once(spark, raw_file):
    plan = read_audited_events(spark, raw_file)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1


def test_a_table_without_rejected_lines_has_none(spark, stored_table):
    assert read_rejected(spark, stored_table).isEmpty()


def test_enrichment_of_raw_files(spark, raw_file, tmp_path):
    events = read_events(spark, raw_file)
    out = str(tmp_path / "enriched")
    reports.write_enriched(events, out, keep=raw_columns(events), fmt="csv")
    back = spark.read.option("sep", ";").option("header", True).csv(out)
    assert back.columns == [*S.RAW_COLUMNS, "EK ALAN", "sub_order_number", "composite_id"]
    assert sorted(r.composite_id for r in back.collect()) == ["A1_0", "A2_0"]


def test_event_table_round_trip(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir)
    path = str(tmp_path / "table")
    write_event_table(events, path)
    back = read_event_table(spark, path).select(*events.columns)
    assert back.exceptAll(events).isEmpty() and back.count() == events.count()
    one_day = read_event_table(spark, path).where("trade_date = '2024-01-05'")
    shown = one_day._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "trade_date" in shown.split("PushedFilters")[0]


def test_raw_text_files_round_trip(spark, sf_dir, tmp_path):
    """From text files to lives: the same as straight from the table."""
    events = load_order_events(spark, sf_dir)
    readable = raw_text(events.withColumn("event_id", F.lit(1)))  # spoils no value
    path = str(tmp_path / "csv")
    readable.write.option("sep", ";").option("header", True).csv(path)
    typed = read_events(spark, path).select(*S.ENGINE_COLUMNS)
    assert typed.exceptAll(events.select(*S.ENGINE_COLUMNS)).isEmpty()
    assert typed.count() == events.count()


def test_run_folder():
    now = datetime(2026, 6, 26, 14, 30, 59)
    first, second = sinks.run_folder("/out/", now), sinks.run_folder("/out/", now)
    assert first.startswith("/out/run=20260626_143059_") and first != second


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_are_never_overwritten(spark, tmp_path, fmt):
    frame = spark.createDataFrame([("both", ["A.E", "B.E"])], "category string, stocks array<string>")
    folder = sinks.write_results({"overlap": frame}, str(tmp_path / "run"), fmt)
    back = (
        spark.read.parquet(f"{folder}/overlap")
        if fmt == "parquet"
        else spark.read.option("sep", ";").option("header", True).csv(f"{folder}/overlap")
    )
    assert back.first().stocks == (["A.E", "B.E"] if fmt == "parquet" else "A.E,B.E")
    with pytest.raises(AnalysisException, match="already exists"):
        sinks.write_results({"overlap": frame}, str(tmp_path / "run"), fmt)


ODD = "id long, name string, lots double, at timestamp_ntz, day date, ok boolean, listed array<string>"


def odd_frame(spark):
    when = datetime(2026, 5, 6, 10, 0, 0, 123456)
    rows = [
        (1, 'semi;colon "quoted"', 0.1, when, when.date(), True, ["A.E", "B.E"]),
        (2, "", None, None, None, None, []),
        (3, None, 1e300, when, None, False, None),
        (3, None, 1e300, when, None, False, None),
    ]
    return spark.createDataFrame(rows, ODD).repartition(2)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_run_is_read_back_and_checked(spark, tmp_path, fmt):
    folder, frame = str(tmp_path / "run"), odd_frame(spark)
    results = {"odd": frame, "none": frame.where("id < 0")}
    sinks.write_results(results, folder, fmt)
    with pytest.raises(sinks.DamagedRun, match="not a finished run"):
        sinks.read_run(spark, folder)
    sinks.finish_run(spark, folder, {"fmt": fmt})
    back = sinks.read_run(spark, folder, verify=True)
    assert set(back) == {"odd", "none"} and back["none"].isEmpty()
    expected = frame if fmt == "parquet" else frame.withColumn("listed", F.array_join("listed", ","))
    assert back["odd"].exceptAll(expected).isEmpty() and back["odd"].count() == 4
    assert [t for _, t in back["odd"].dtypes] == [t for _, t in expected.dtypes]


def test_damaged_runs_are_refused(spark, tmp_path):
    for name in ("gone", "more", "changed"):
        folder = str(tmp_path / name)
        sinks.write_results({"odd": odd_frame(spark)}, folder)
        sinks.finish_run(spark, folder, {})
        files = sorted((tmp_path / name / "odd").glob("part-*"))
        if name == "gone":
            files[0].unlink()
        elif name == "more":
            (tmp_path / name / "odd" / "part-more.parquet").write_bytes(files[0].read_bytes())
        else:
            other = odd_frame(spark).withColumn("id", F.col("id") + 6)
            other.write.parquet(str(tmp_path / "other"))
            made = sorted((tmp_path / "other").glob("part-*"))
            # Same names and sizes, other rows: only reading them tells.
            spoiled = [m.read_bytes() for m in made]
            if [len(x) for x in spoiled] != [f.stat().st_size for f in files]:
                continue
            for f, data in zip(files, spoiled):
                f.write_bytes(data)
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
            with pytest.raises(sinks.DamagedRun, match="rows differ"):
                sinks.read_run(spark, folder, verify=True)
            continue
        with pytest.raises(sinks.DamagedRun, match="files differ"):
            sinks.read_run(spark, folder)


def test_lives_day_by_day(spark, sf_dir, tmp_path):
    """A state per day, each from the open orders of the day before: the same lives."""
    events = (
        load_order_events(spark, sf_dir)
        .withColumn("order_id", F.substring_index("order_id", "-", 1))
        .withColumn("day", F.to_date("change_ts").cast("string"))
        .cache()
    )
    days = sorted(r.day for r in events.select("day").distinct().collect())[:4]
    base = str(tmp_path / "daily")
    for k, day in enumerate(days):
        today = events.where(F.col("day") == day)
        if k == 0:
            daily.first_day(today, base, day)
        else:
            daily.add_day(today, base, day, days[k - 1])
        so_far = events.where(F.col("day") <= day)
        found = daily.lives_until(spark, base, day)
        assert found.exceptAll(lifecycle_table(so_far)).isEmpty()
        assert found.count() == lifecycle_table(so_far).count()
    by_fill = daily.lives_until(spark, base, days[-1], by_fill=True)
    assert by_fill.exceptAll(lifecycle_table(so_far, by_fill=True)).isEmpty()
    events.unpersist()


def test_lives_day_by_day_of_events_with_a_time(spark, sf_dir, tmp_path):
    """Events without a time belong to no day; of all others the days give the same lives."""
    events = (
        load_order_events(spark, sf_dir)
        .withColumn("order_id", F.substring_index("order_id", "-", 1))
        .withColumn("day", F.to_date("change_ts").cast("string"))
        .where(F.col("day").isNotNull())
        .cache()
    )
    days = sorted(r.day for r in events.select("day").distinct().collect())[:3]
    base = str(tmp_path / "daily")
    daily.first_day(events.where(F.col("day") == days[0]), base, days[0])
    for before, day in zip(days, days[1:]):
        daily.add_day(events.where(F.col("day") == day), base, day, before)
    so_far = events.where(F.col("day") <= days[-1])
    found, want = daily.lives_until(spark, base, days[-1]), lifecycle_table(so_far)
    assert found.count() == want.count() > 0
    assert found.exceptAll(want).isEmpty()
    events.unpersist()


def test_reports(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir)
    first = reports.write_overview(events, str(tmp_path / "o"))
    total = spark.read.parquet(f"{first}/q01_new_orders").first()
    assert total[0] == overview.new_orders(overview.facts(events)).count()
    second = reports.write_lifecycle(events, str(tmp_path / "l"))
    orders = spark.read.parquet(f"{second}/order_lifecycle")
    assert orders.count() == lifecycle_table(events).count()
    assert spark.read.parquet(f"{second}/sample_orders_raw_events").count() > 0
    third = reports.write_validation(events, str(tmp_path / "v"), fmt="csv")
    shown = spark.read.option("sep", ";").option("header", True).csv(f"{third}/order_detail")
    assert shown.select("order_id").distinct().count() == 5
    for base, folder, table in (("o", first, "q16_top100"), ("l", second, "l5_resting_vs_outcome"), ("v", third, "repricing_by_stock")):
        # One folder per run, whatever the clock does meanwhile; the marker comes last.
        assert [str(p) for p in (tmp_path / base).iterdir()] == [folder]
        written = {p.name: p.stat().st_mtime for p in (tmp_path / base).glob("run=*/*")}
        assert table in written and max(written, key=written.get) == "_complete"
    settings = {r.setting: r.value for r in spark.read.json(f"{second}/_complete").collect()}
    assert settings["fraction"] == "1.0"


def test_a_sample_is_named_as_such(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir)
    folder = reports.write_lifecycle(events, str(tmp_path / "s"), fraction=0.5)
    settings = {r.setting: r.value for r in spark.read.json(f"{folder}/_complete").collect()}
    assert settings["fraction"] == "0.5"
    table = spark.read.parquet(f"{folder}/order_lifecycle")
    assert 0 < table.count() < lifecycle_table(events).count()


def test_history_follows_the_numbering(spark):
    """Equal times and two orders of one stock: rows by order, then as numbered."""
    from book import Book

    book = Book()
    for name in ("B", "A"):
        book.event(name, 6, 0.0, qty=100.0)
        for k in range(1, 5):
            book.event(name, 5, 5.0, qty=100.0 + 10 * k)
    tables = reports.history(book.frame(spark))
    ids = [r.composite_id for r in tables["order_detail"].collect()]
    assert ids == [f"{o}_{k}" for o in "AB" for k in range(5)]
    ids = [r.composite_id for r in tables["version_summary"].collect()]
    assert ids == [f"{o}_{k}" for o in "AB" for k in range(5)]


def test_enriched_rows(spark, sf_dir, tmp_path):
    events = load_order_events(spark, sf_dir)
    path = str(tmp_path / "e")
    reports.write_enriched(events, path)
    back = spark.read.parquet(path)
    assert back.count() == events.where("order_cat = 1").count()
    assert dict(back.dtypes)["sub_order_number"] == "int"
    first = back.where("change_reason = 6").select("sub_order_number").distinct().collect()
    assert [r[0] for r in first] == [0]
    assert enrich_events(events).columns == back.columns


def test_enriched_raw_files_have_two_more_columns(spark, raw_file, tmp_path):
    reports.write_enriched(read_events(spark, raw_file), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.columns == [*S.RAW_COLUMNS, "EK ALAN", "sub_order_number", "composite_id"]
