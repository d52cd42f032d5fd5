from __future__ import annotations

import datetime as dt

import pytest

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.errors import MissingColumns, MissingInput, ValidationError
from ledgerlake.operators import ingest
from ledgerlake.operators.enrich import enrich
from ledgerlake.sources import files

HEADER = ",".join(fv.REQUIRED_COLUMNS)
ROW = "ORD000000001,2026-01-27,CUST1,A B,PROD1,Lamp Variant 1,Home,2,150.5,Pune,UPI"


def csv(tmp_path, *lines, name="sales_raw.csv"):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def raw(spark, **changed):
    values = dict(zip(fv.REQUIRED_COLUMNS, ROW.split(",")))
    values |= {"order_date": dt.date(2026, 1, 27), "quantity": 2, "price": 150.5} | changed
    return spark.createDataFrame([tuple(values[c] for c in schemas.RAW.names)], schemas.RAW)


def failure(df, **options):
    with pytest.raises(ValidationError) as caught:
        ingest.validate(df, **options)
    return caught.value.rule, str(caught.value)


def test_only_the_first_failure_is_raised(spark):
    assert failure(raw(spark).limit(0)) == ("non_empty", "CSV file is empty")
    broken = raw(spark, order_id=None, quantity=0, price=-1.0)
    assert failure(broken) == ("order_id_not_null", "order_id contains NULL values")
    assert failure(raw(spark, quantity=0, price=-1.0))[1] == "quantity must be greater than 0"
    assert failure(raw(spark, price=-1.0))[1] == "price must be greater than 0"
    assert ingest.validate(raw(spark)).count() == 1


def test_nulls_pass_unless_strict(spark):
    unknown = raw(spark, quantity=None, price=None)
    assert ingest.validate(unknown).count() == 1
    assert failure(unknown, strict=True) == ("quantity_not_null", "quantity contains NULL values")


def test_missing_and_extra_columns(spark, tmp_path):
    without = csv(tmp_path, HEADER.replace(",city", ""), ROW.replace(",Pune", ""))
    with pytest.raises(MissingColumns, match=r"Missing columns: \['city'\]"):
        ingest.validate(files.read_csv(spark, without))
    extra = csv(tmp_path, "note," + HEADER, "x," + ROW, name="extra.csv")
    found = ingest.validate(files.read_csv(spark, extra))
    assert found.columns[0] == "note" and found.first().price == 150.5


def test_empty_file_is_reported_before_missing_columns(spark, tmp_path):
    path = csv(tmp_path, HEADER.replace(",city", ""))
    assert failure(files.read_csv(spark, path))[0] == "non_empty"


def test_types_do_not_follow_the_data(spark, tmp_path):
    whole = csv(tmp_path, HEADER, ROW.replace("150.5", "150").replace("2026-01-27", "garbage"))
    explicit = files.read_csv(spark, whole)
    assert dict(explicit.dtypes)["price"] == "double"
    inferred = files.read_csv(spark, whole, infer=True)
    assert dict(inferred.dtypes)["price"] == "int"
    assert enrich(explicit, dt.date(2026, 1, 27)).first().order_date is None


def test_malformed_number_stops_the_scan(spark, tmp_path):
    path = csv(tmp_path, HEADER, ROW.replace(",2,", ",two,"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_csv(spark, path).select("quantity").collect()


def test_every_file_of_a_batch_needs_the_same_header(spark, tmp_path):
    folder = tmp_path / "batch"
    folder.mkdir()
    csv(folder, HEADER, ROW, name="a.csv")
    csv(folder, HEADER.replace("quantity,price", "price,quantity"), ROW, name="b.csv")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(folder)).collect()


def test_missing_input(spark, tmp_path):
    for read in (
        lambda: files.read_csv(spark, f"{tmp_path}/none.csv"),
        lambda: files.read_csv(spark, f"{tmp_path}/none.csv", infer=True),
        lambda: files.read_json(spark, f"{tmp_path}/none", schemas.PRODUCT),
    ):
        with pytest.raises(MissingInput):
            read()


def test_csv_round_trip_of_awkward_text(spark, tmp_path):
    awkward = raw(spark, customer_name='A "B", C\\', product_name="", city=None, quantity=None)
    files.write_csv(awkward, f"{tmp_path}/out")
    back = files.read_csv(spark, f"{tmp_path}/out", schemas.RAW_FILE).first()
    assert back.customer_name == 'A "B", C\\'
    assert (back.product_name, back.city, back.quantity) == (None, None, None)
    assert (back.order_date, back.price) == ("2026-01-27", 150.5)


def test_quotes_doubled_by_other_writers(spark, tmp_path):
    path = csv(tmp_path, HEADER, ROW.replace("A B", '"A ""B"", C"'))
    assert files.read_csv(spark, path).first().customer_name == 'A "B", C'


def test_several_days_are_one_read(spark, tmp_path):
    days = [dt.date(2026, 1, 27), dt.date(2026, 1, 28)]
    paths = [files.land_raw(raw(spark, order_date=d), str(tmp_path), d) for d in days]
    assert paths[0].endswith("/sales/2026/01/27/sales_raw.csv")
    assert sorted(r.order_date for r in files.read_csv(spark, paths).collect()) == ["2026-01-27", "2026-01-28"]


def test_landing_twice_keeps_one_copy(spark, tmp_path):
    for _ in range(2):
        path = files.land_raw(raw(spark), str(tmp_path), dt.date(2026, 1, 27))
    assert files.read_csv(spark, path).count() == 1


def test_json_array_and_json_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text(
        '[\n  {"product_id": "PROD1", "product_name": "Lamp", "category": "Home"},\n'
        '  {"product_id": "PROD2", "product_name": "Café", "category": "Home"}\n]'
    )
    array = files.read_json(spark, f"{tmp_path}/array.json", schemas.PRODUCT, array=True)
    files.write_json(array, f"{tmp_path}/lines")
    lines = files.read_json(spark, f"{tmp_path}/lines", schemas.PRODUCT)
    assert sorted(lines.collect()) == sorted(array.collect()) and lines.count() == 2


def test_stamp(spark):
    stamped = ingest.stamp(raw(spark), dt.date(2026, 1, 28)).first()
    assert (stamped.ingestion_date, stamped.source_system) == (dt.date(2026, 1, 28), "local_csv")
    assert ingest.stamp(raw(spark)).first().ingestion_date is not None


def test_strict_rules_count_nan(spark):
    from ledgerlake.operators import rules

    frame = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "price double")
    assert frame.agg(rules.not_null_rules("price")[0].violations).first()[0] == 2
