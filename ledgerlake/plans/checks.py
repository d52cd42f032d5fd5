"""Every operator as a query over the source tables, next to the SQL that must agree.

A query takes (spark, sf_dir). Queries over sinks write to a fresh directory in the
cluster's shared folder and return what they read back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import fixed_values as fv
from ledgerlake import schemas
from ledgerlake.functions import ids, sales
from ledgerlake.operators import (
    dimensions, fact, generate, ingest, ordinals, quality, reports, rules,
)
from ledgerlake.operators.enrich import enrich
from ledgerlake.plans import bridge, daily, rollups
from ledgerlake.sources import files, table, workspace

RUN_DATE = dt.date(2001, 8, 1)
MONTH = dt.date(1998, 3, 1)
INGESTED_ON = dt.date(2001, 8, 2)
LOADED_AT = "2001-08-02 03:04:05"
TOP_PRODUCTS = 20

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        _SQL[function.__name__] = sql.strip()
        return function
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL shared by the checks. Each is a list of common table expressions.

SALES = """
    lines AS (
        SELECT l_orderkey, l_partkey,
               printf('ORD%09d', l_orderkey) AS order_id,
               'PROD' || CAST(l_partkey + 100000 AS VARCHAR) AS product_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(floor(l_extendedprice * 100 / nullif(l_quantity, 0)) AS DOUBLE) / 100 AS price
        FROM lineitem
    ),
    sales_raw AS (
        SELECT l_orderkey, order_id, CAST(o_orderdate AS DATE) AS order_date,
               'CUST' || CAST(o_custkey + 100000 AS VARCHAR) AS customer_id,
               c_name AS customer_name, product_id, p_name AS product_name, p_type AS category,
               quantity, price, n_name AS city, o_orderpriority AS payment_type
        FROM lines
        LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN part ON l_partkey = p_partkey
    )"""

DEFECTS = SALES + """,
    defects AS (
        SELECT * REPLACE (
            CASE WHEN l_orderkey % 101 <> 0 THEN order_id END AS order_id,
            CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN l_orderkey % 89 <> 0 THEN quantity END AS quantity,
            CASE WHEN l_orderkey % 103 = 0 THEN -price WHEN l_orderkey % 107 <> 0 THEN price END AS price
        )
        FROM sales_raw
    )"""

BUCKET = "CASE WHEN price < 500 THEN 'LOW' WHEN price < 2000 THEN 'MEDIUM' ELSE 'HIGH' END"

PROCESSED = SALES + f""",
    processed AS (
        SELECT order_id, order_date, customer_id, customer_name, product_id, product_name, category,
               quantity, price, city, payment_type,
               DATE '2001-08-02' AS ingestion_date, 'local_csv' AS source_system,
               CAST(year(order_date) AS INTEGER) AS order_year,
               CAST(month(order_date) AS INTEGER) AS order_month,
               CAST(day(order_date) AS INTEGER) AS order_day,
               concat_ws('-', year(order_date), month(order_date)) AS order_year_month,
               quantity * price AS total_amount,
               {BUCKET} AS price_bucket,
               '2001-08-01' AS processing_date
        FROM sales_raw
    )"""

FACT_COLUMNS = ", ".join(schemas.FACT.names)

ROLLUP = """count(*) AS sales, CAST(sum(quantity) AS BIGINT) AS units,
            CAST(sum(CAST(total_amount AS DECIMAL(12,2))) AS DECIMAL(28,2)) AS revenue"""


def typed_sql(id_type: str) -> str:
    return f"""
    WITH {PROCESSED}
    SELECT CAST(substring(order_id, 4) AS {id_type}) AS order_id,
           CAST(substring(product_id, 5) AS {id_type}) AS product_id,
           CAST(substring(customer_id, 5) AS {id_type}) AS customer_id,
           quantity, CAST(price AS DECIMAL(10,2)) AS price,
           CAST(total_amount AS DECIMAL(12,2)) AS total_amount,
           price_bucket, order_date, order_year, order_month,
           CAST(processing_date AS DATE) AS processing_date
    FROM processed"""


def report_sql(source: str, rules_: list[tuple[str, str, str]]) -> str:
    """Rule counts as rows; each rule is (name, message, count expression)."""
    counts = ", ".join(f"{count} AS {name}" for name, _, count in rules_)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS rule, '{message}' AS message, "
        f"CAST({name} AS BIGINT) AS violations, {name} = 0 AS passed FROM counted"
        for i, (name, message, _) in enumerate(rules_, start=1)
    )
    return f"WITH {DEFECTS}, counted AS (SELECT {counts} FROM {source}), report AS ({rows})"


INGEST_REPORT = report_sql("defects", [
    ("non_empty", "CSV file is empty", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    ("order_id_not_null", "order_id contains NULL values", "count(*) FILTER (order_id IS NULL)"),
    ("quantity_positive", "quantity must be greater than 0", "count(*) FILTER (quantity <= 0)"),
    ("price_positive", "price must be greater than 0", "count(*) FILTER (price <= 0)"),
])

QUALITY_RULES = [
    ("records_present", "No records found for given date", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    ("order_id_not_null", "order_id contains NULL values", "count(*) FILTER (order_id IS NULL)"),
    ("quantity_positive", "quantity must be > 0", "count(*) FILTER (quantity <= 0)"),
    ("price_positive", "price must be > 0", "count(*) FILTER (price <= 0)"),
    ("total_amount_positive", "total_amount must be > 0", "count(*) FILTER (quantity * price <= 0)"),
]
QUALITY_REPORT = report_sql("defects", QUALITY_RULES)
STRICT_REPORT = report_sql("defects", QUALITY_RULES + [
    ("quantity_not_null", "quantity contains NULL values", "count(*) FILTER (quantity IS NULL)"),
    ("price_not_null", "price contains NULL values", "count(*) FILTER (price IS NULL)"),
    ("total_amount_not_null", "total_amount contains NULL values",
     "count(*) FILTER (quantity * price IS NULL)"),
])


# Frames shared by the checks.

def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stamp(bridge.sales_raw(spark, sf_dir), INGESTED_ON)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(landed(spark, sf_dir), RUN_DATE, F.lit(LOADED_AT).cast("timestamp"))


def fact_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed sales, reading only the tables the fact columns come from."""
    columns = ["order_id", "product_id", "customer_id", "quantity", "price", "order_date"]
    return fact.project(enrich(bridge.sales_raw(spark, sf_dir, columns), RUN_DATE))


def defects(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    columns = ["l_orderkey", "order_id", "quantity", "price", *extra]
    return bridge.with_defects(bridge.sales_raw(spark, sf_dir, columns))


def with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", sales.total_amount(F.col("quantity"), F.col("price")))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose date is text, unreadable in places."""
    raw = bridge.sales_raw(spark, sf_dir, ["l_orderkey", "order_id", "order_date"])
    unreadable = F.col("l_orderkey") % 113 == 0
    text = F.when(unreadable, "garbage").otherwise(F.col("order_date").cast("string"))
    return raw.select("order_id", text.alias("order_date"))


DATED = SALES + """,
    dated AS (
        SELECT order_id, CASE WHEN l_orderkey % 113 <> 0 THEN order_date END AS order_date
        FROM sales_raw
    )"""


def comparable(df: DataFrame) -> DataFrame:
    """Without the load time, which is a clock reading in real runs."""
    return df.drop("ingestion_timestamp")


# Dimensions and generation.

@query("""
    SELECT 'PROD' || CAST(100000 + p_partkey * 5 + v - 1 AS VARCHAR) AS product_id,
           p_name || ' Variant ' || CAST(v AS VARCHAR) AS product_name,
           p_type AS category
    FROM part, range(1, 6) AS variants(v)
""")
def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.products(bridge.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"),
        F.col("p_name").alias("base_name"),
        F.col("p_partkey").alias("base_ordinal"),
    ))


def _picked(options: list[str], start: int, length: int) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    drawn = f"CAST('0x' || substring(seed, {start}, {length}) AS BIGINT)"
    return f"[{listed}][{drawn} % {len(options)} + 1]"


@query(f"""
    WITH seeded AS (SELECT c_custkey, sha256('customer:' || CAST(c_custkey AS VARCHAR)) AS seed FROM customer)
    SELECT 'CUST' || CAST(100000 + c_custkey AS VARCHAR) AS customer_id,
           {_picked(dimensions.GIVEN_NAMES, 9, 14)} || ' '
               || {_picked(dimensions.FAMILY_NAMES, 23, 14)} AS customer_name,
           {_picked(dimensions.CITIES, 45, 12)} AS city
    FROM seeded
""")
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.customers(
        bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_ordinal"))
    )


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey")
    return bridge.products(spark, sf_dir).select(
        key.alias("product_key"), ids.product_id(key).alias("product_id"), "product_name", "category"
    )


@query("""
    SELECT p_type AS category, 'PROD' || CAST(100000 + p_partkey AS VARCHAR) AS product_id,
           p_name AS product_name,
           row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS category_position
    FROM part
""")
def products_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.products_by_category(
        part_products(spark, sf_dir), "product_key"
    ).drop("product_key")


@query(f"""
    WITH product AS (
        SELECT 'PROD' || CAST(100000 + p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
               p_type AS category,
               row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS category_position
        FROM part
    ),
    sizes AS (
        SELECT category, count(*) AS products,
               row_number() OVER (ORDER BY category) - 1 AS category_ordinal
        FROM product GROUP BY category
    ),
    buyer AS (
        SELECT 'CUST' || CAST(100000 + c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
               n_name AS city, row_number() OVER (ORDER BY c_custkey) - 1 AS customer_ordinal
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    ),
    seeded AS (
        SELECT o_orderkey, sha256('2001-08-01:' || CAST(o_orderkey AS VARCHAR)) AS seed FROM orders
    ),
    drawn AS (
        SELECT o_orderkey, seed,
               CAST('0x' || substring(seed, 1, 8) AS BIGINT) AS d_category,
               CAST('0x' || substring(seed, 9, 14) AS BIGINT) AS d_product,
               CAST('0x' || substring(seed, 23, 14) AS BIGINT) AS d_customer,
               CAST('0x' || substring(seed, 37, 8) AS BIGINT) AS d_quantity,
               CAST('0x' || substring(seed, 45, 12) AS BIGINT) AS d_price
        FROM orders JOIN seeded USING (o_orderkey)
    )
    SELECT printf('ORD%09d', o_orderkey) AS order_id, DATE '2001-08-01' AS order_date,
           customer_id, customer_name, product_id, product_name, product.category,
           CAST(d_quantity % 5 + 1 AS INTEGER) AS quantity,
           CAST(d_price % 7985001 + 15000 AS DOUBLE) / 100 AS price,
           city, {_picked(fv.PAYMENT_TYPES, 57, 8)} AS payment_type
    FROM drawn
    JOIN sizes ON category_ordinal = d_category % (SELECT count(*) FROM sizes)
    JOIN product ON product.category = sizes.category AND category_position = d_product % products
    JOIN buyer ON customer_ordinal = d_customer % (SELECT count(*) FROM customer)
""")
def gen_sales_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with one sale per order, drawn from the part and customer tables."""
    key = F.col("c_custkey")
    buyers = bridge.customers(spark, sf_dir).select(
        key.alias("customer_key"), ids.customer_id(key).alias("customer_id"), "customer_name", "city"
    )
    numbers = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_number"))
    counted = bridge.table(spark, sf_dir, "customer")
    return generate.draw_sales(numbers, RUN_DATE, part_products(spark, sf_dir), buyers, counted)


@query("""
    SELECT o_orderkey,
           printf('ORD%09d', (SELECT max(l_orderkey) FROM lineitem)
                             + row_number() OVER (ORDER BY o_orderkey)) AS order_id
    FROM orders
""")
def allocate_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = bridge.table(spark, sf_dir, "lineitem")
    mark = ordinals.high_water(existing, "l_orderkey", fv.LAST_ORDER_NUMBER)
    batch = bridge.table(spark, sf_dir, "orders").select("o_orderkey")
    return ordinals.allocate_order_ids(batch, "o_orderkey", mark)


@query(f"WITH {SALES} SELECT * EXCLUDE (l_orderkey) FROM sales_raw")
def denormalize_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.sales_raw(spark, sf_dir)


# Sources and sinks.

LANDED_SQL = f"""
    WITH {SALES}
    SELECT * EXCLUDE (l_orderkey) REPLACE (CAST(order_date AS VARCHAR) AS order_date),
           DATE '2001-08-02' AS ingestion_date, 'local_csv' AS source_system
    FROM sales_raw"""


@query(LANDED_SQL)
def scan_csv_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    files.write_csv(landed(spark, sf_dir), path)
    return files.read_csv(spark, path)


@query(LANDED_SQL)
def land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.land_raw(landed(spark, sf_dir), workspace.fresh(spark), RUN_DATE)
    return files.read_csv(spark, path)


@query(_SQL["dim_products"])
def scan_json_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    files.write_json(dim_products(spark, sf_dir), path)
    return files.read_json(spark, path, schemas.PRODUCT)


@query(_SQL["dim_customers"])
def scan_json_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    files.write_json(dim_customers(spark, sf_dir), path)
    return files.read_json(spark, path, schemas.CUSTOMER)


@query(f"WITH {PROCESSED} SELECT * FROM processed")
def append_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), path)
    return comparable(table.scan(spark, path))


@query(f"""
    WITH {PROCESSED}
    SELECT * FROM processed WHERE order_date <> DATE '1998-03-01' OR order_date IS NULL
    UNION ALL
    SELECT * REPLACE ('1998-03-01' AS processing_date) FROM processed WHERE order_date = DATE '1998-03-01'
""")
def replace_processed_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, then one of them again in a run of its own: still one copy of it."""
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), f"{path}/table", keys=table.DAY_KEYS)
    rerun = enrich(landed(spark, sf_dir).filter(F.col("order_date") == F.lit(MONTH)), MONTH)
    table.replace_day(rerun, f"{path}/table", MONTH, quarantine=f"{path}/quarantine")
    return comparable(table.scan(spark, f"{path}/table"))


@query(f"WITH {PROCESSED} SELECT * FROM processed WHERE order_year = 1998 AND order_month = 3")
def scan_processed_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), path)
    return comparable(quality.in_scope(table.scan(spark, path), MONTH, scope="month"))


@query(f"WITH {PROCESSED} SELECT * FROM processed")
def scan_processed_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), path)
    return comparable(table.scan(spark, path))


@query(f"WITH {PROCESSED} SELECT * FROM processed")
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one appended to what the other left, months of both among them."""
    path = workspace.fresh(spark)
    whole = processed(spark, sf_dir)
    first = F.coalesce(F.dayofmonth("order_date") <= 15, F.lit(False))
    table.append(whole.filter(first), path)
    table.append(whole.filter(~first), path)
    return comparable(table.scan(spark, path))


BACKFILL = [RUN_DATE + dt.timedelta(n) for n in range(3)]


@query(f"""
    WITH {SALES}
    SELECT order_id, product_id, quantity, price,
           CASE WHEN l_orderkey % 7 <> 0 THEN DATE '2001-08-01' + CAST(l_orderkey % 3 AS INTEGER) END AS order_date,
           strftime(DATE '2001-08-01' + CAST(l_orderkey % 3 AS INTEGER), '%Y-%m-%d') AS processing_date,
           l_orderkey % 7 = 0 AS quarantined
    FROM sales_raw
""")
def backfill_processed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three days in one read and one write; the day of a batch is that of its path.
    Rows whose date cannot be read go to their batch's quarantine."""
    zones = daily.Zones.under(workspace.fresh(spark))
    raw = bridge.sales_raw(spark, sf_dir, ["l_orderkey", *schemas.RAW.names])
    for n, day in enumerate(BACKFILL):
        text = F.when(F.col("l_orderkey") % 7 == 0, "garbage").otherwise(F.lit(day.isoformat()))
        batch = raw.filter(F.col("l_orderkey") % 3 == n).withColumn("order_date", text).drop("l_orderkey")
        files.land_raw(ingest.stamp(batch, INGESTED_ON), zones.raw, day)
    daily.transform_days(spark, BACKFILL[0], BACKFILL[-1], zones)
    columns = ["order_id", "product_id", "quantity", "price", "order_date", "processing_date"]
    strays = spark.read.schema(schemas.PROCESSED).parquet(*(f"{zones.quarantine}/{day}" for day in BACKFILL))
    stored = table.scan(spark, zones.processed).select(*columns, F.lit(False).alias("quarantined"))
    return stored.union(strays.select(*columns, F.lit(True).alias("quarantined")))


@query(f"""
    WITH {SALES}
    SELECT order_id, product_id, replace(product_name, ' ', chr(10)) AS product_name, quantity FROM sales_raw
""")
def scan_csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that runs over lines, written and read as such."""
    path = workspace.fresh(spark)
    raw = bridge.sales_raw(spark, sf_dir, ["order_id", "product_id", "product_name", "quantity"])
    broken = raw.withColumn("product_name", F.replace("product_name", F.lit(" "), F.lit("\n")))
    files.write_csv(broken, path, line_breaks=True)
    return files.read_csv(spark, path, line_breaks=True)


# Ingest checks and stamps.

@query(f"""
    WITH {SALES}, written AS (
        SELECT l_orderkey, order_id, product_id,
               CASE WHEN l_orderkey % 11 = 0 THEN 'q' || l_orderkey ELSE CAST(quantity AS VARCHAR) END AS text_quantity
        FROM sales_raw)
    SELECT CASE WHEN l_orderkey % 11 <> 0 THEN order_id END AS order_id,
           CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_orderkey AS INTEGER) END AS key,
           TRY_CAST(text_quantity AS INTEGER) AS quantity,
           CASE WHEN l_orderkey % 11 = 0 THEN order_id || ',' || l_orderkey || ',' || text_quantity END AS record
    FROM written
""")
def ingest_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none, in every eleventh order: their records are put aside as text and
    the others go on."""
    path = workspace.fresh(spark)
    raw = bridge.sales_raw(spark, sf_dir, ["l_orderkey", "order_id", "quantity"])
    bad = F.concat(F.lit("q"), F.col("l_orderkey").cast("string"))
    quantity = F.when(F.col("l_orderkey") % 11 == 0, bad).otherwise(F.col("quantity").cast("string"))
    files.write_csv(raw.select("order_id", F.col("l_orderkey").alias("key"), quantity.alias("quantity")), f"{path}/raw")
    contract = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("quantity", T.IntegerType())])
    found = files.read_csv(spark, f"{path}/raw", contract, malformed="keep")
    whole, _ = files.quarantine_malformed(found, f"{path}/aside")
    aside = spark.read.schema(found.schema).parquet(f"{path}/aside")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema]
    return whole.withColumn("record", F.lit(None).cast("string")).union(aside.select(*nothing, files.RECORD))


@query(f"{INGEST_REPORT} SELECT * FROM report")
def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validation_report(defects(spark, sf_dir))


@query(f"{INGEST_REPORT} SELECT * FROM report WHERE NOT passed ORDER BY position LIMIT 1")
def ingest_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_failure(ingest.validation_report(defects(spark, sf_dir)))


@query(f"WITH {SALES}\n" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, true AS present, count({c}) AS filled FROM sales_raw"
    if c != "city" else
    f"SELECT {i} AS position, '{c}' AS column_name, false AS present, CAST(0 AS BIGINT) AS filled"
    for i, c in enumerate(fv.REQUIRED_COLUMNS, start=1)
))
def ingest_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without `city` and with a column nobody asked for."""
    path = workspace.fresh(spark)
    columns = [c for c in fv.REQUIRED_COLUMNS if c != "city"]
    raw = bridge.sales_raw(spark, sf_dir, columns)
    files.write_csv(raw.select(F.lit("x").alias("note"), *columns), path)
    found = files.read_csv(spark, path)
    missing = ingest.missing_columns(found.columns)
    counted = found.agg(*(
        (F.lit(0).cast("bigint") if c in missing else F.count(c)).alias(c) for c in fv.REQUIRED_COLUMNS
    ))
    return counted.select(F.inline(F.array(*(
        F.struct(
            F.lit(position).alias("position"), F.lit(c).alias("column_name"),
            F.lit(c not in missing).alias("present"), F.col(c).alias("filled"),
        )
        for position, c in enumerate(fv.REQUIRED_COLUMNS, start=1)
    ))))


@query(f"""
    WITH {SALES}
    SELECT order_id, product_id, quantity, price, DATE '2001-08-02' AS ingestion_date,
           'local_csv' AS source_system
    FROM sales_raw
""")
def ingest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["order_id", "product_id", "quantity", "price"]
    return ingest.stamp(bridge.sales_raw(spark, sf_dir, columns), INGESTED_ON)


# Enrichment.

@query(f"WITH {DATED} SELECT order_id, order_date FROM dated")
def etl_order_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).select(
        "order_id", sales.parsed_date(F.col("order_date")).alias("order_date")
    )


@query(f"""
    WITH {DATED}
    SELECT order_id, CAST(year(order_date) AS INTEGER) AS order_year,
           CAST(month(order_date) AS INTEGER) AS order_month,
           CAST(day(order_date) AS INTEGER) AS order_day
    FROM dated
""")
def etl_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = sales.parsed_date(F.col("order_date"))
    return dated(spark, sf_dir).select(
        "order_id", F.year(day).alias("order_year"), F.month(day).alias("order_month"),
        F.dayofmonth(day).alias("order_day"),
    )


@query(f"""
    WITH {DATED}
    SELECT order_id, concat_ws('-', year(order_date), month(order_date)) AS order_year_month FROM dated
""")
def etl_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = sales.parsed_date(F.col("order_date"))
    return dated(spark, sf_dir).select(
        "order_id", sales.year_month(F.year(day), F.month(day)).alias("order_year_month")
    )


@query(f"WITH {DEFECTS} SELECT order_id, quantity, price, quantity * price AS total_amount FROM defects")
def etl_total_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_total(defects(spark, sf_dir)).select("order_id", "quantity", "price", "total_amount")


@query(f"WITH {DEFECTS} SELECT order_id, price, {BUCKET} AS price_bucket FROM defects")
def etl_price_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(spark, sf_dir).select(
        "order_id", "price", sales.price_bucket(F.col("price")).alias("price_bucket")
    )


@query(f"WITH {SALES} SELECT order_id, product_id, '2001-08-01' AS processing_date FROM sales_raw")
def etl_processing_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_lines(spark, sf_dir).select("order_id", "product_id", "processing_date")


@query(f"WITH {SALES} SELECT order_id, product_id, '{LOADED_AT}' AS loaded_at FROM sales_raw")
def etl_load_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the clock given; shown as text, which no session time zone changes."""
    return enriched_lines(spark, sf_dir).select(
        "order_id", "product_id", F.col("ingestion_timestamp").cast("string").alias("loaded_at")
    )


def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bridge.sales_raw(spark, sf_dir, ["order_id", "product_id", "quantity", "price"])
    no_date = raw.withColumn("order_date", F.lit(None).cast("date"))
    return enrich(no_date, RUN_DATE, F.lit(LOADED_AT).cast("timestamp"))


@query(f"WITH {PROCESSED} SELECT * FROM processed")
def etl_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(processed(spark, sf_dir))


# Data quality.

@query(f"""
    WITH {DEFECTS}
    SELECT order_id, order_date, quantity, price FROM defects
    WHERE year(order_date) = 1998 AND month(order_date) = 3
""")
def dq_partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = enrich(defects(spark, sf_dir, "order_date"), RUN_DATE)
    scoped = quality.in_scope(enriched, MONTH, scope="month")
    return scoped.select("order_id", "order_date", "quantity", "price")


@query(f"""
    WITH {PROCESSED}
    SELECT order_id, product_id, order_date, total_amount FROM processed WHERE order_year = 1998 AND order_month = 3
""")
def dq_stored_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of one month reads: only that month's directories of the stored table."""
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), path)
    scoped = quality.in_scope(table.scan(spark, path), MONTH, scope="month")
    return scoped.select("order_id", "product_id", "order_date", "total_amount")


@query(f"{QUALITY_REPORT} SELECT * FROM report")
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(with_total(defects(spark, sf_dir)))


@query(f"{STRICT_REPORT} SELECT * FROM report")
def dq_report_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(with_total(defects(spark, sf_dir)), strict=True)


@query(f"{QUALITY_REPORT} SELECT * FROM report WHERE NOT passed")
def dq_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.failures(dq_report(spark, sf_dir))


# The fact table.

@query(f"WITH {PROCESSED} SELECT {FACT_COLUMNS} FROM processed")
def fact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_source(spark, sf_dir)


@query(typed_sql("INTEGER"))
def fact_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.typed(fact_source(spark, sf_dir))


@query(typed_sql("BIGINT"))
def fact_typed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For order numbers past the declared INT."""
    return fact.typed(fact_source(spark, sf_dir), T.LongType())


@query(typed_sql("BIGINT"))
def publish_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table published as a whole. The target is a directory here; a
    database takes the same frame through `sources.jdbc`."""
    root = workspace.fresh(spark)
    zones = daily.Zones.under(root)
    table.append(processed(spark, sf_dir), zones.processed)
    daily.publish(
        spark, zones, lambda df: df.write.mode("overwrite").parquet(f"{root}/fact"), T.LongType()
    )
    return spark.read.schema(schemas.fact(T.LongType())).parquet(f"{root}/fact")


@query(f"{typed_sql('BIGINT')} WHERE order_date >= DATE '1998-03-01'")
def publish_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the days from one on are sent; earlier months are not read."""
    root = workspace.fresh(spark)
    zones = daily.Zones.under(root)
    table.append(processed(spark, sf_dir), zones.processed)
    daily.publish(
        spark, zones, lambda df: df.write.mode("overwrite").parquet(f"{root}/fact"), T.LongType(), since=MONTH
    )
    return spark.read.schema(schemas.fact(T.LongType())).parquet(f"{root}/fact")


@query(f"{typed_sql('BIGINT')} ORDER BY {', '.join(map(str, range(1, 12)))} LIMIT 5")
def preview_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.preview(fact_typed_wide(spark, sf_dir))


@query(f"WITH {SALES} SELECT count(*) AS rows_to_load FROM sales_raw")
def count_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.count(enriched_lines(spark, sf_dir))


@query(f"WITH {SALES} SELECT count(*) AS rows_to_load FROM sales_raw")
def count_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored table, which reads no column of it."""
    path = workspace.fresh(spark)
    table.append(processed(spark, sf_dir), path)
    return fact.count(table.scan(spark, path))


# Reports.

@query(f"WITH {PROCESSED} SELECT order_date, {ROLLUP} FROM processed GROUP BY ALL")
def report_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_sales(bridge.measured_orders(spark, sf_dir))


@query(f"WITH {PROCESSED} SELECT order_year, order_month, {ROLLUP} FROM processed GROUP BY ALL")
def report_monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("order_date")
    return reports.monthly_sales(bridge.measured_orders(spark, sf_dir).withColumns(
        {"order_year": F.year(day), "order_month": F.month(day)}
    ))


@query(f"WITH {PROCESSED} SELECT order_year, order_month, price_bucket, {ROLLUP} FROM processed GROUP BY ALL")
def report_revenue_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bridge.sales_raw(spark, sf_dir, ["order_date", "quantity", "price"])
    return reports.revenue_by_bucket(reports.measures(enrich(raw, RUN_DATE)))


@query(f"WITH {PROCESSED} SELECT category, product_id, {ROLLUP} FROM processed GROUP BY ALL")
def report_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.in_money(bridge.measured_products(spark, sf_dir))


@query(f"WITH {PROCESSED} SELECT category, {ROLLUP} FROM processed GROUP BY ALL")
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_sales(bridge.measured_products(spark, sf_dir))


@query(f"""
    WITH {PROCESSED}
    SELECT category, product_id, {ROLLUP} FROM processed GROUP BY ALL
    ORDER BY revenue DESC, product_id LIMIT {TOP_PRODUCTS}
""")
def report_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_products(report_products(spark, sf_dir), TOP_PRODUCTS)


@query(f"""
    WITH {PROCESSED}, spent AS (SELECT customer_id, {ROLLUP} FROM processed GROUP BY ALL)
    SELECT *, CAST(revenue AS DOUBLE) / sales AS average_value FROM spent
""")
def report_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_average(reports.in_money(bridge.measured_customers(spark, sf_dir)))


# Reports from stored sums. A day is first stored with wrong quantities and then replaced.

def replaced_sums(spark: SparkSession, sf_dir: str, store: str) -> DataFrame:
    path = workspace.fresh(spark)
    raw = bridge.sales_raw(spark, sf_dir, ["order_date", "quantity", "price", *({"category", "product_id"} if store == "product" else ())])
    sold = enrich(raw, RUN_DATE)
    replaced = F.col("order_date") == F.lit(MONTH)
    wrong = F.when(replaced, F.col("total_amount") * 3).otherwise(F.col("total_amount"))
    rollups.store_sums(sold.withColumn("total_amount", wrong), store, path)
    rollups.store_sums(sold.filter(replaced), store, path)
    return rollups.sums(spark, path, store)


@query(f"WITH {PROCESSED} SELECT order_date, {ROLLUP} FROM processed GROUP BY ALL")
def report_daily_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_sales(replaced_sums(spark, sf_dir, "bucket"))


@query(f"WITH {PROCESSED} SELECT category, product_id, {ROLLUP} FROM processed GROUP BY ALL")
def report_products_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.product_sales(replaced_sums(spark, sf_dir, "product"))
