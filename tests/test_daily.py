from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlake import __main__ as cli
from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.errors import (
    BadRunDate, DataQualityError, EmptyPublish, MissingInput, ValidationError,
)
from ledgerlake.functions import params
from ledgerlake.operators import fact
from ledgerlake.plans import daily
from ledgerlake.session import SHUFFLE_PARTITION_BYTES, sized_for
from ledgerlake.sources import files, table, workspace

FIRST, SECOND = dt.date(2026, 1, 27), dt.date(2026, 1, 28)


@pytest.fixture
def lake(spark, tmp_path):
    zones = daily.Zones.under(str(tmp_path))
    daily.build_dimensions(spark, zones)
    return zones


class Target:
    """A sink that replaces what it holds."""

    def __init__(self, path):
        self.path, self.calls = path, 0

    def __call__(self, df):
        self.calls += 1
        schemas.assert_schema(df, schemas.FACT)
        df.write.mode("overwrite").parquet(self.path)


def test_days_run_and_rerun(spark, lake, tmp_path):
    target = Target(f"{tmp_path}/fact")
    first = daily.run_day(spark, "2026-01-27", lake, target, rows=60)
    second = daily.run_day(spark, "2026-01-28", lake, target, rows=40)
    assert (first.rows_landed, first.rows_quarantined, first.rows_published) == (60, 0, 60)
    assert (second.rows_landed, second.rows_published) == (40, 100)
    before = sorted(spark.read.parquet(target.path).collect())
    assert [r.order_id for r in before] == list(range(197_682, 197_782))
    for day, rows in ((SECOND, 40), (FIRST, 60)):
        daily.run_day(spark, day, lake, target, rows=rows)
        assert sorted(spark.read.parquet(target.path).collect()) == before


def test_order_numbers_never_meet(spark, lake):
    def reserve(day, rows):
        return daily.reserve_order_numbers(spark, lake, dt.date(2026, 1, day), rows)

    assert reserve(27, 10) == 197_681
    assert reserve(29, 5) == 197_691
    assert reserve(28, 7) == 197_696  # late, so after the day that follows it
    assert [reserve(27, 10), reserve(29, 5), reserve(28, 7)] == [197_681, 197_691, 197_696]
    assert reserve(27, 11) == 197_703  # a larger batch does not fit its old numbers
    assert reserve(30, 1) == 197_714


def test_default_batch_size(spark, lake, tmp_path):
    summary = daily.run_day(spark, FIRST, lake, Target(f"{tmp_path}/fact"))
    assert 5000 <= summary.rows_published <= 7000


def test_bad_date_stops_before_any_work(spark, lake):
    with pytest.raises(BadRunDate):
        daily.run_day(None, "27-01-2026", lake, None)


def test_ingest_gate_leaves_the_raw_zone_alone(spark, lake):
    source = daily.generate_day(spark, FIRST, lake, rows=5)
    bad = files.read_csv(spark, source, schemas.RAW_FILE).withColumn("price", -F.col("price"))
    rows = bad.collect()
    files.write_csv(spark.createDataFrame(rows, bad.schema), source)
    with pytest.raises(ValidationError, match="price must be greater than 0"):
        daily.ingest_day(spark, FIRST, lake)
    with pytest.raises(MissingInput):
        daily.transform_day(spark, FIRST, lake)


def test_quality_gate_blocks_publishing(spark, lake, tmp_path, monkeypatch):
    target = Target(f"{tmp_path}/fact")
    monkeypatch.setattr(daily.ingest, "validate", lambda df, strict=False: df.withColumn("quantity", F.lit(0)))
    with pytest.raises(DataQualityError, match="quantity must be > 0; total_amount must be > 0"):
        daily.run_day(spark, FIRST, lake, target, rows=5)
    assert target.calls == 0


def test_strays_are_quarantined_in_a_run(spark, lake):
    path = files.land_raw(
        files.read_csv(spark, daily.generate_day(spark, FIRST, lake, rows=10), schemas.RAW_FILE)
        .withColumn("order_date", F.when(F.col("quantity") > 2, "garbage").otherwise(F.col("order_date"))),
        f"{lake.source}2", FIRST,
    )
    late = daily.Zones(**{**lake.__dict__, "source": f"{lake.source}2"})
    daily.ingest_day(spark, FIRST, late)
    written = daily.transform_day(spark, FIRST, late)
    bad = files.read_csv(spark, path).filter("order_date = 'garbage'").count()
    assert 0 < bad < 10 and written == table.DayWrite(10, bad)
    assert table.scan(spark, lake.processed).count() == 10 - bad


def test_publish_refuses_an_empty_table(spark, lake):
    empty = spark.createDataFrame([], schemas.PROCESSED)
    empty.write.parquet(lake.processed)
    with pytest.raises(EmptyPublish, match="No data found for SQL load"):
        daily.publish(spark, lake, None)


def test_publish_can_persist_and_lets_go(spark, lake, tmp_path):
    target = Target(f"{tmp_path}/fact")
    daily.run_day(spark, FIRST, lake, target, rows=5)
    held = []

    def sink(df):
        held.append(df)
        assert df.storageLevel.useMemory and df.count() == fact.count(df).first()[0] == 5

    assert daily.publish(spark, lake, sink, persist=True) == 5
    assert not held[0].storageLevel.useMemory


class Cluster:
    """A session as far as the work folder is concerned."""

    def __init__(self, **settings):
        self.conf = {k.replace("__", "."): v for k, v in settings.items()}


def test_work_folder_is_the_one_the_cluster_names():
    named = Cluster(spark__master="yarn", spark__checkpoint__dir="hdfs://lake/work/")
    first, second = workspace.fresh(named), workspace.fresh(named)
    assert first.startswith("hdfs://lake/work/ledgerlake-") and first != second
    assert workspace.shared_folder(Cluster(spark__master="local[8]")) == tempfile.gettempdir()
    for settings in ({}, {"spark__master": "yarn"}, {"spark__master": "spark://host:1"}):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            workspace.fresh(Cluster(**settings))


def test_shuffle_partitions_follow_the_input():
    key = "spark.sql.shuffle.partitions"
    assert sized_for(1)[key] == "200"
    assert sized_for(10 * 1024**4)[key] == str(10 * 1024**4 // (128 * 1024**2))
    assert sized_for(1024**5)[key] == str(1024**5 // SHUFFLE_PARTITION_BYTES)


def test_command_line():
    assert cli.main(["check", "27-01-2026", "--lake", "x"]) == 1
    args = cli.arguments(["publish", "2026-01-27", "--lake", "x", "--jdbc", "url=jdbc:a=b", "--jdbc", "user=u"])
    assert cli.pairs(args.jdbc) == {"url": "jdbc:a=b", "user": "u"}
    assert params.run_date(args.run_date) == FIRST


def test_order_numbers_survive_an_empty_record(spark, tmp_path):
    zones = daily.Zones.under(str(tmp_path))
    files.write_json(spark.range(0).selectExpr("id first_number", "id last_number"), f"{zones.order_numbers}/run_date=2026-01-01")
    day = dt.date(2026, 1, 2)
    assert daily.reserve_order_numbers(spark, zones, day, 10) == fv.LAST_ORDER_NUMBER


def test_a_day_of_another_size_takes_no_number_back(spark, tmp_path):
    zones = daily.Zones.under(str(tmp_path))
    a, b, c = (dt.date(2026, 1, d) for d in (1, 2, 3))
    daily.reserve_order_numbers(spark, zones, a, 10)
    old = daily.reserve_order_numbers(spark, zones, b, 5)
    new = daily.reserve_order_numbers(spark, zones, b, 7)
    assert new >= old + 5 and daily.reserve_order_numbers(spark, zones, c, 1) == new + 7
    assert daily.reserve_order_numbers(spark, zones, b, 5) == old  # its old record is still there


def test_csv_keeps_blanks_around_text(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("  A B  ",)], "customer_name string"), f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c").first()[0] == "  A B  "
