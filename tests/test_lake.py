"""Backfill, malformed records, line breaks, stored sums, committers, staged publishing."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_table import FIRST, SECOND, per_day, processed

from ledgerlake import __main__ as command
from ledgerlake import schemas
from ledgerlake.errors import MissingInput, PublishMismatch, SchemaMismatch
from ledgerlake.operators import ingest, reports
from ledgerlake.plans import daily, rollups
from ledgerlake.session import committer_for
from ledgerlake.sources import files, folders, jdbc, table

THIRD = dt.date(2026, 1, 29)


@pytest.fixture
def zones(tmp_path):
    return daily.Zones.under(str(tmp_path))


def raw(spark, day, rows, **changed):
    batch = processed(spark, day, rows, **changed).select(*schemas.RAW.names)
    return ingest.stamp(batch.withColumn("order_date", F.col("order_date").cast("string")), day)


def test_a_backfill_replaces_each_day_of_its_batches_once(spark, zones):
    table.replace_day(processed(spark, THIRD, 7), zones.processed, THIRD, zones.quarantine)
    table.replace_day(processed(spark, FIRST, 9), zones.processed, FIRST, zones.quarantine)
    files.land_raw(raw(spark, FIRST, 4).union(raw(spark, SECOND, 2)), zones.raw, FIRST)  # two strays
    files.land_raw(raw(spark, SECOND, 5), zones.raw, SECOND)
    files.land_raw(raw(spark, FIRST, 3), zones.raw, THIRD)  # nothing of its own day
    for _ in range(2):
        written = daily.transform_days(spark, dt.date(2026, 1, 20), dt.date(2026, 2, 2), zones)
        assert written == {FIRST: table.DayWrite(6, 2), SECOND: table.DayWrite(5, 0), THIRD: table.DayWrite(3, 3)}
        assert per_day(spark, zones.processed) == {FIRST: 4, SECOND: 5, THIRD: 7}
    dates = {r.processing_date for r in table.scan(spark, zones.processed).filter("order_day < 29").collect()}
    assert dates == {"2026-01-27", "2026-01-28"}
    assert sorted(Path(f).name for f in Path(zones.quarantine).iterdir()) == ["2026-01-27", "2026-01-29"]
    with pytest.raises(MissingInput):
        daily.transform_days(spark, dt.date(2025, 1, 1), dt.date(2025, 1, 3), zones)


def test_a_clean_batch_is_read_once(spark, zones):
    """Each row passes a counter on its way; counting the batch first would double it."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    batch = processed(spark, FIRST, 50)
    written = table.replace_day(batch.mapInArrow(passed, batch.schema), zones.processed, FIRST, zones.quarantine)
    assert written == table.DayWrite(50, 0) and read.value == 50


def test_files_of_two_layouts_in_a_day_are_named(spark, zones):
    table.replace_day(processed(spark, FIRST), zones.processed, FIRST, zones.quarantine)
    daily.check_day(spark, FIRST, zones)
    day = f"{zones.processed}/order_year=2026/order_month=1/order_day=27"
    odd = processed(spark, FIRST, 2).drop(*table.DAY_KEYS).withColumn("price", F.lit("12"))
    odd.write.mode("append").parquet(day)
    with pytest.raises(SchemaMismatch, match="write job .*price"):
        daily.check_day(spark, FIRST, zones)


def write_lines(path, lines):
    Path(path).mkdir(parents=True)
    Path(f"{path}/part.csv").write_text("\n".join(lines) + "\n")


def test_malformed_records_are_kept_aside_or_stop_the_run(spark, zones):
    header = ",".join(schemas.RAW_FILE.names)
    good = "ORD1,2026-01-27,CUST1,a,PROD1,b,c,2,10.5,Pune,UPI"
    bad = ["ORD2,2026-01-27,CUST1,a,PROD1,b,c,two,10.5,Pune,UPI", "ORD3,2026-01-27,CUST1,a"]
    path = f"{zones.source}/sales/2026/01/27/sales_raw.csv"
    write_lines(path, [header, good, *bad])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        daily.ingest_day(spark, FIRST, zones)
    with pytest.raises(ValueError, match="strict"):
        daily.ingest_day(spark, FIRST, zones, strict=True, malformed="keep")
    landed = daily.ingest_day(spark, FIRST, zones, malformed="keep")
    assert [r.order_id for r in files.read_csv(spark, landed).collect()] == ["ORD1"]
    aside = spark.read.parquet(f"{zones.malformed}/2026-01-27")
    assert sorted(r[files.RECORD] for r in aside.collect()) == bad
    write_lines(f"{zones.source}/sales/2026/01/28/sales_raw.csv", [header, good])
    daily.ingest_day(spark, SECOND, zones, malformed="keep")
    assert not folders.exists(spark, f"{zones.malformed}/2026-01-28")


def test_line_breaks_are_refused_by_name_unless_asked_for(spark, tmp_path):
    df = spark.createDataFrame([("a", "one\ntwo")], "id string, note string")
    with pytest.raises(Exception, match="column note holds a line break"):
        files.write_csv(df, f"{tmp_path}/x")
    files.write_csv(df, f"{tmp_path}/y", line_breaks=True)
    assert files.read_csv(spark, f"{tmp_path}/y", line_breaks=True).collect() == df.collect()


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from('ab "\n\r,;\\é'), min_size=1, max_size=12), min_size=1, max_size=8))
def test_text_with_line_breaks_comes_back_as_it_was(spark, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("csv") / "x")
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, note string")
    files.write_csv(df, path, line_breaks=True)
    assert sorted(files.read_csv(spark, path, line_breaks=True).collect()) == sorted(df.collect())


def test_reports_from_stored_sums_follow_a_replaced_day(spark, zones):
    cities = {"category": F.element_at(F.array(F.lit("a"), F.lit("b")), (F.rand(1) * 2).cast("int") + 1)}
    for day, rows in ((FIRST, 30), (SECOND, 20)):
        table.replace_day(processed(spark, day, rows, **cities), zones.processed, day, zones.quarantine)
    rollups.refresh(spark, zones)
    untouched = sorted(Path(f"{zones.rollups}/customer/order_year=2026/order_month=1/order_day=28").glob("*.parquet"))
    changed = processed(spark, FIRST, 8, price=F.lit(700.25), customer_id=F.col("order_id"))
    table.replace_day(changed, zones.processed, FIRST, zones.quarantine)
    rollups.refresh(spark, zones, [FIRST])
    measured = reports.measures(table.scan(spark, zones.processed))
    for name, (_, plain) in rollups.REPORTS.items():
        found, wanted = rollups.report(spark, zones, name), plain(measured)
        assert found.columns == wanted.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())), name
    assert untouched == sorted(Path(f"{zones.rollups}/customer/order_year=2026/order_month=1/order_day=28").glob("*.parquet"))
    scanned = table.scan(spark, zones.processed).filter(rollups.in_days([SECOND]))
    assert {Path(f).parent.name for f in scanned.inputFiles()} >= {"order_day=28"}
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "order_day" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    with pytest.raises(MissingInput):
        rollups.sums(spark, f"{zones.rollups}/none", "bucket")


@pytest.mark.parametrize("path, committer, settings_", [
    ("/data/lake", None, {"spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "1"}),
    ("hdfs://a/lake", None, {"spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "1"}),
    ("abfss://c@a/lake", None, {
        "spark.hadoop.mapreduce.outputcommitter.factory.scheme.abfss": "org.apache.hadoop.fs.azurebfs.commit.AzureManifestCommitterFactory"}),
    ("s3a://b/lake", "magic", {"spark.hadoop.fs.s3a.committer.name": "magic"}),
    ("s3a://b/lake", None, {"spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "1"}),
])
def test_the_committer_follows_the_file_system(path, committer, settings_):
    assert settings_.items() <= committer_for(path, committer).items()


def test_a_committer_that_cannot_replace_days_is_refused():
    with pytest.raises(ValueError, match="single partitions"):
        committer_for("s3a://b/lake", "magic", replaces_days=True)
    with pytest.raises(ValueError, match="no committer"):
        committer_for("/data/lake", "manifest")
    assert command.main(["day", "2026-01-27", "--lake", "s3a://b/lake", "--committer", "magic"]) == 1


def test_staged_publishing_swaps_only_what_is_complete(spark, tmp_path, monkeypatch):
    calls, stored = [], {}

    def replace(df, target, connections, batch_size):
        calls.append((target["dbtable"], connections))
        stored[target["dbtable"]] = df.count()

    monkeypatch.setattr(jdbc, "replace_table", replace)
    monkeypatch.setattr(jdbc, "row_count", lambda spark_, target: stored[target["dbtable"]])
    target = jdbc.connection("jdbc:x", user="u")
    sent = jdbc.publish_staged(spark.range(40), f"{tmp_path}/s", target, "staged", lambda: calls.append("swap"), 3)
    assert sent == 40 and calls == [("staged", 3), "swap"]
    monkeypatch.setattr(jdbc, "row_count", lambda *_: 41)
    calls.clear()
    with pytest.raises(PublishMismatch):
        jdbc.publish_staged(spark.range(40), f"{tmp_path}/s", target, "staged", lambda: calls.append("swap"))
    assert calls == [("staged", 16)]


def test_a_step_is_sized_by_what_it_reads(spark, zones):
    table.replace_day(processed(spark, FIRST, 500), zones.processed, FIRST, zones.quarantine)
    table.replace_day(processed(spark, SECOND, 10), zones.processed, SECOND, zones.quarantine)
    size = lambda *args: command.input_bytes(spark, *args)
    whole = folders.size(spark, zones.processed)
    assert size("publish", FIRST, zones) == 0
    assert 0 < size("check", SECOND, zones) < size("check", FIRST, zones) < size("check", FIRST, zones, "month") <= whole
    assert size("rollup", FIRST, zones, "day", SECOND) > size("rollup", FIRST, zones)
    assert size("day", SECOND, zones) == size("check", SECOND, zones)
