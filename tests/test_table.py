from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlake import __main__ as command
from ledgerlake import schemas
from ledgerlake.errors import DataQualityError, EmptyBatch, MissingInput, SchemaMismatch
from ledgerlake.operators import quality
from ledgerlake.operators.enrich import enrich
from ledgerlake.operators.ingest import stamp
from ledgerlake.plans import daily
from ledgerlake.sources import table

FIRST, SECOND = dt.date(2026, 1, 27), dt.date(2026, 1, 28)


def processed(spark, day, rows=3, **changed):
    df = spark.range(rows).select(
        F.concat(F.lit("ORD"), F.col("id")).alias("order_id"),
        F.lit(day).cast("date").alias("order_date"),
        *(F.lit("x").alias(c) for c in schemas.RAW.names[2:7]),
        F.lit(2).alias("quantity"), F.lit(10.5).alias("price"),
        F.lit("Pune").alias("city"), F.lit("UPI").alias("payment_type"),
    )
    for name, value in changed.items():
        df = df.withColumn(name, value)
    return schemas.assert_schema(enrich(stamp(df, day), day), schemas.PROCESSED)


def per_day(spark, path):
    counts = table.scan(spark, path).groupBy("order_date").count().collect()
    return {r.order_date: r["count"] for r in counts}


def replace(df, tmp_path, day):
    return table.replace_day(df, f"{tmp_path}/t", day, f"{tmp_path}/q")


def test_appending_twice_stores_two_copies(spark, tmp_path):
    for _ in range(2):
        table.append(processed(spark, FIRST), f"{tmp_path}/t")
    assert per_day(spark, f"{tmp_path}/t") == {FIRST: 6}
    assert (tmp_path / "t/order_year=2026/order_month=1").is_dir()


def test_replacing_a_day_twice_stores_one_copy_and_keeps_other_days(spark, tmp_path):
    replace(processed(spark, FIRST), tmp_path, FIRST)
    replace(processed(spark, SECOND, 4), tmp_path, SECOND)
    written = replace(processed(spark, FIRST, 5), tmp_path, FIRST)
    assert written == table.DayWrite(5, 0)
    assert per_day(spark, f"{tmp_path}/t") == {FIRST: 5, SECOND: 4}


def test_rows_of_other_days_are_quarantined(spark, tmp_path):
    replace(processed(spark, SECOND, 4), tmp_path, SECOND)
    stray = processed(spark, SECOND, 1).unionByName(processed(spark, FIRST, 2, order_date=F.lit(None).cast("date")))
    written = replace(processed(spark, FIRST).unionByName(stray), tmp_path, FIRST)
    assert written == table.DayWrite(6, 3)
    assert per_day(spark, f"{tmp_path}/t") == {FIRST: 3, SECOND: 4}
    kept = spark.read.parquet(f"{tmp_path}/q/2026-01-27")
    assert sorted(str(r.order_date) for r in kept.collect()) == ["2026-01-28", "None", "None"]


def test_empty_batch_leaves_the_stored_day(spark, tmp_path):
    replace(processed(spark, FIRST), tmp_path, FIRST)
    for batch in (processed(spark, FIRST, 0), processed(spark, SECOND, 2)):
        with pytest.raises(EmptyBatch):
            replace(batch, tmp_path, FIRST)
        assert per_day(spark, f"{tmp_path}/t") == {FIRST: 3}


def test_scan_names_missing_table_and_wrong_columns(spark, tmp_path):
    with pytest.raises(MissingInput):
        table.scan(spark, f"{tmp_path}/none")
    with pytest.raises(SchemaMismatch, match="price"):
        schemas.assert_schema(processed(spark, FIRST).drop("price"), schemas.PROCESSED)
    with pytest.raises(SchemaMismatch, match="out of order"):
        schemas.assert_schema(processed(spark, FIRST).select(*schemas.PROCESSED.names[::-1]), schemas.PROCESSED)


def test_scopes_prune_partitions(spark, tmp_path):
    for day in (FIRST, SECOND, dt.date(2026, 2, 1)):
        replace(processed(spark, day), tmp_path, day)
    spark.catalog.clearCache()
    stored = spark.read.parquet(f"{tmp_path}/t")
    for scope, keys, rows in (("month", "order_month", 6), ("day", "order_day", 3)):
        scoped = quality.in_scope(stored, FIRST, scope)
        scan = next(
            line for line in scoped._jdf.queryExecution().executedPlan().toString().splitlines()
            if "FileScan" in line
        )
        filters = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
        assert "order_year" in filters and keys in filters
        assert scoped.count() == rows
        assert len({Path(f).parent for f in scoped.inputFiles()}) <= 3
    with pytest.raises(ValueError):
        quality.in_scope(stored, FIRST, "week")


def test_a_large_day_is_written_by_many_tasks(spark, conf, tmp_path):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="20k", spark__sql__shuffle__partitions="4")
    large = processed(spark, FIRST, 20_000, city=F.md5(F.col("order_id"))).repartition(8)
    small = processed(spark, SECOND, 50)
    table.append(large.unionByName(small), f"{tmp_path}/t", keys=table.DAY_KEYS)
    day = "t/order_year=2026/order_month=1/order_day={}"
    files = {d: len(list((tmp_path / day.format(d)).glob("*.parquet"))) for d in (27, 28)}
    assert files[27] > 4 and files[28] == 1
    assert per_day(spark, f"{tmp_path}/t") == {FIRST: 20_000, SECOND: 50}


def failures(df, **options):
    with pytest.raises(DataQualityError) as caught:
        quality.gate(quality.quality_report(df, **options))
    return [(rule, n) for rule, _, n in caught.value.failures], str(caught.value)


def test_quality_reports_all_failures_in_order(spark):
    broken = processed(spark, FIRST, order_id=F.lit(None).cast("string"), quantity=F.lit(-1))
    found, message = failures(broken)
    assert found == [("order_id_not_null", 3), ("quantity_positive", 3), ("total_amount_positive", 3)]
    assert message == "order_id contains NULL values; quantity must be > 0; total_amount must be > 0"
    assert failures(processed(spark, FIRST, 0)) == ([("records_present", 1)], "No records found for given date")
    quality.gate(quality.quality_report(processed(spark, FIRST)))


def test_quality_lets_null_and_nan_pass_unless_strict(spark):
    unknown = processed(spark, FIRST, quantity=F.lit(None).cast("int"), price=F.lit(float("nan")))
    quality.gate(quality.quality_report(unknown))
    assert failures(unknown, strict=True)[0] == [
        ("quantity_not_null", 3), ("price_not_null", 3), ("total_amount_not_null", 3)]


def test_scope_day_or_month(spark, tmp_path):
    replace(processed(spark, FIRST, price=F.lit(-1.0)), tmp_path, FIRST)
    replace(processed(spark, SECOND), tmp_path, SECOND)
    stored = table.scan(spark, f"{tmp_path}/t")
    quality.gate(quality.quality_report(quality.in_scope(stored, SECOND)))
    assert failures(quality.in_scope(stored, SECOND, "month"))[0][0] == ("price_positive", 3)
    missing = dt.date(2026, 1, 29)
    assert failures(quality.in_scope(stored, missing))[0] == [("records_present", 1)]


def test_a_stored_day_without_a_column_stops_the_check(spark, tmp_path):
    zones = daily.Zones.under(str(tmp_path))
    table.replace_day(processed(spark, SECOND), zones.processed, SECOND, zones.quarantine)
    day = f"{zones.processed}/order_year=2026/order_month=1/order_day=27"
    processed(spark, FIRST).drop("price", *table.DAY_KEYS).write.parquet(day)
    with pytest.raises(SchemaMismatch, match="price"):
        daily.check_day(spark, FIRST, zones)
    with pytest.raises(SchemaMismatch, match="price"):
        daily.check_day(spark, SECOND, zones, "month")
    daily.check_day(spark, SECOND, zones)


def test_other_partition_keys_are_refused(spark, tmp_path):
    replace(processed(spark, FIRST), tmp_path, FIRST)
    with pytest.raises(SchemaMismatch, match="order_day"):
        table.append(processed(spark, SECOND), f"{tmp_path}/t")
    assert per_day(spark, f"{tmp_path}/t") == {FIRST: 3}
    table.append(processed(spark, SECOND), f"{tmp_path}/m")
    with pytest.raises(SchemaMismatch, match="order_month"):
        table.replace_day(processed(spark, FIRST), f"{tmp_path}/m", FIRST, f"{tmp_path}/q")


def test_a_clean_rerun_leaves_no_quarantine(spark, tmp_path):
    replace(processed(spark, FIRST).unionByName(processed(spark, SECOND, 1)), tmp_path, FIRST)
    assert (tmp_path / "q/2026-01-27").is_dir()
    assert replace(processed(spark, FIRST), tmp_path, FIRST) == table.DayWrite(3, 0)
    assert not (tmp_path / "q/2026-01-27").exists()


def test_publish_since_sends_later_days_with_wide_ids(spark, tmp_path):
    zones = daily.Zones.under(str(tmp_path))
    wide = processed(
        spark, SECOND, 4, order_id=F.concat(F.lit("ORD"), F.lit(3_000_000_000) + F.col("quantity")),
        customer_id=F.lit("CUST1"), product_id=F.lit("PROD1"))
    for day, df in ((FIRST, processed(spark, FIRST)), (SECOND, wide)):
        table.replace_day(df, zones.processed, day, zones.quarantine)
    sent = []
    assert daily.publish(spark, zones, lambda df: sent.extend(df.collect()), LongType(), since=SECOND) == 4
    assert {r.order_id for r in sent} == {3_000_000_002} and {r.order_date for r in sent} == {SECOND}


def test_the_command_line_passes_its_options_on(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(command, "session", lambda *_: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    monkeypatch.setattr(command, "input_bytes", lambda *_: 100 * 1024**4)
    monkeypatch.setattr(command.daily, "run_day", lambda *_, **options: seen.update(options))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        args = ["day", "2026-01-27", "--lake", str(tmp_path), "--strict", "--scope", "month", "--ids", "long"]
        assert command.main(args) == 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(100 * 1024**4 // (128 * 1024**2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == {"scope": "month", "strict": True, "id_type": LongType()}
