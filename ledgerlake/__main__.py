"""Run one step of a day, or all of them.

    spark-submit --py-files ... ledgerlake/__main__.py day 2026-01-27 --lake s3a://lake
    python -m ledgerlake check 2026-01-27 --lake /data/lake --scope month
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlake.errors import SalesRunError
from ledgerlake.functions import params
from ledgerlake.operators import fact
from ledgerlake.plans import daily, rollups
from ledgerlake.session import TABLE_FORMATS, committer_for, session, sized_for
from ledgerlake.sources import folders, jdbc

STEPS = ["dimensions", "generate", "ingest", "transform", "check", "rollup", "publish", "day"]
ID_TYPES = {"int": T.IntegerType(), "long": T.LongType()}


def pairs(given: list[str]) -> dict[str, str]:
    return dict(item.split("=", 1) for item in given)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ledgerlake", description="Daily sales batch")
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("run_date", help="YYYY-MM-DD")
    parser.add_argument("--lake", required=True, help="root path of the lake's zones")
    parser.add_argument("--format", choices=sorted(TABLE_FORMATS), default="parquet")
    parser.add_argument("--rows", type=int, help="size of a generated batch")
    parser.add_argument("--scope", choices=["day", "month"], default="day")
    parser.add_argument("--strict", action="store_true", help="let null values fail a rule")
    parser.add_argument("--ids", choices=sorted(ID_TYPES), default="int", help="type of published ids")
    parser.add_argument("--until", help="last day of a backfill: transform, rollup")
    parser.add_argument("--since", help="publish only this day and later ones, for a sink that merges")
    parser.add_argument("--malformed", choices=["fail", "keep"], default="fail",
                        help="put records that do not fit their types aside")
    parser.add_argument("--line-breaks", action="store_true", help="text may run over lines")
    parser.add_argument("--committer", help="how finished files become visible; by the lake's scheme if not given")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE",
                        help="session setting, such as a storage credential")
    parser.add_argument("--jdbc", action="append", default=[], metavar="OPTION=VALUE",
                        help="target option: url, user, password, dbtable, driver")
    return parser.parse_args(argv)


def input_bytes(spark: SparkSession, step: str, day: dt.date, zones: daily.Zones, scope: str = "day", last: dt.date | None = None) -> int:
    """What the step's shuffles may carry: its own input, not the whole table. Publishing has none;
    `day` is sized for its largest step."""
    days = list(params.days(day, last or day))
    raw = [params.raw_path(zones.raw, d) for d in days]
    source = [params.raw_path(zones.source, d) for d in days]
    month = f"{zones.processed}/order_year={day.year}/order_month={day.month}"
    stored = [month] if scope == "month" else [
        f"{zones.processed}/order_year={d.year}/order_month={d.month}/order_day={d.day}" for d in days]
    reads = {
        "dimensions": [], "publish": [], "generate": [zones.dimensions], "ingest": source, "transform": raw,
        "check": stored, "rollup": stored,
    }
    if step == "day":
        return max(sum(folders.size(spark, path) for path in paths) for paths in ([zones.dimensions], source, raw, stored))
    return sum(folders.size(spark, path) for path in reads[step])


def main(argv: list[str]) -> int:
    args = arguments(argv)
    try:
        day = params.run_date(args.run_date)
        last = params.run_date(args.until) if args.until else day
        since = params.run_date(args.since) if args.since else None
        committer = committer_for(args.lake, args.committer, args.step in ("transform", "rollup", "day") and args.format != "delta")
    except (SalesRunError, ValueError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    spark = session(f"ledgerlake {args.step} {day}", {**committer, **pairs(args.conf)}, args.format)
    zones = daily.Zones.under(args.lake, args.format)
    given_conf = pairs(args.conf)
    for key, value in sized_for(input_bytes(spark, args.step, day, zones, args.scope, last)).items():
        if key not in given_conf:
            spark.conf.set(key, value)

    # Options that differ from those of `run_day`.
    chosen = {k: v for k, v, usual in (
        ("since", since, None), ("malformed", args.malformed, "fail"), ("line_breaks", args.line_breaks, False)) if v != usual}

    def to_database(df: DataFrame) -> None:
        given = pairs(args.jdbc)
        target = jdbc.connection(given.pop("url"), **given)
        jdbc.replace_table(df, target)
        jdbc.check_count(spark, target, fact.count(df).first()[0])

    try:
        if args.step == "dimensions":
            daily.build_dimensions(spark, zones)
        elif args.step == "generate":
            print(daily.generate_day(spark, day, zones, args.rows))
        elif args.step == "ingest":
            print(daily.ingest_day(
                spark, day, zones, strict=args.strict, malformed=args.malformed, line_breaks=args.line_breaks))
        elif args.step == "transform" and args.until:
            for done, written in daily.transform_days(spark, day, last, zones, line_breaks=args.line_breaks).items():
                print(done, written)
        elif args.step == "transform":
            print(daily.transform_day(spark, day, zones, line_breaks=args.line_breaks))
        elif args.step == "rollup":
            rollups.refresh(spark, zones, list(params.days(day, last)))
        elif args.step == "check":
            daily.check_day(spark, day, zones, args.scope, args.strict).show(truncate=False)
        elif args.step == "publish":
            print(daily.publish(spark, zones, to_database, ID_TYPES[args.ids], since=since))
        else:
            print(daily.run_day(
                spark, day, zones, to_database, args.rows,
                scope=args.scope, strict=args.strict, id_type=ID_TYPES[args.ids], **chosen))
    except SalesRunError as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
