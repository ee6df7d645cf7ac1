"""Incremental panel of event legs: each run takes the events that became final since the last one.

    python -m jobs.leg_panel --tables DIR --out DIR [--config FILE]

Reads DIR/events.parquet and keeps under the output folder, all as Parquet:

    panel/    one row an event of a leg, with its amount, fee and newest rate, by day and since
    report/   counts, volume, fees and rate labels, by day
    state/    each user's newest rate at the mark, by slot: two of them, the last and the one before
    mark/     one row a run: up to which time events are taken

An event is final once the newest event is `lag_seconds` later. A run takes what is final and later than
the mark, so it reads the new part of the table alone, and the state stands for all rates before it. The
mark is written last. A run that dies before that leaves partitions of the same `since`, which the next
one replaces, since it covers the same stretch and more; a run that finds nothing new writes nothing.
Events that arrive with a time before the mark come too late and are not taken.
"""

from __future__ import annotations

import argparse
import logging
import tomllib
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import asof, panel

CONFIG = str(Path(__file__).with_name("leg_panel.toml"))
PANEL = "event_id long, user_id long, leg int, us long, amount decimal(38,0), fee decimal(38,0), rate double, rate_us long, method string, day date, since long"
REPORT = "leg int, events long, users long, volume decimal(38,0), fees decimal(38,0), exact long, forward_fill long, unavailable long, ties long, day date"
STATE = "user_id long, us long, rate double, slot int"
MARK = "since long, upto long, read long, wrote long"
EPOCH = datetime(1970, 1, 1)
log = logging.getLogger("jobs.leg_panel")


def settings(spark: SparkSession, path: str = CONFIG) -> dict:
    """The configuration, a TOML file that Spark reads."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the output folder."""
    return spark.read.schema(schema).parquet(path)


def prepared(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """An empty table, where no run has written one."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").partitionBy(*by).parquet(path)


def put(df: DataFrame, path: str, *by: str) -> int:
    """Write df over those partitions that it holds, and count its rows on the way.

    Rows of a partition meet in few files; one that is too large for a task is split.
    """
    seen = Observation()
    df = df.hint("rebalance", *by)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def moment(us: int) -> Column:
    """A time without zone as a literal, so that comparisons with it reach the scan."""
    return F.expr(f"timestamp_ntz'{(EPOCH + timedelta(microseconds=us)).isoformat(sep=' ', timespec='microseconds')}'")


def taken(events: DataFrame, since: int | None, head: int, config: dict) -> DataFrame:
    """Final events after the mark, without the excluded parties."""
    final = panel.final_only(events, moment(head), F.expr(f"INTERVAL {int(config['lag_seconds'])} SECONDS"), "ts")
    later = final if since is None else final.filter(F.col("ts") > moment(since))
    kept = panel.exclude(later, "event_type", config["exclude"]["event_type"], ["user_id"], [str(u) for u in config["exclude"]["users"]])
    return kept.select("event_id", "user_id", "event_type", "value", asof.epoch_us("ts").alias("us"))


def legs_of(rows: DataFrame, rates: DataFrame, since: int, config: dict) -> DataFrame:
    """The panel's rows: legs with their exact amount and fee, and the newest rate of their user."""
    leg = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(k)) for k, kind in enumerate(config["legs"])])
    left = rows.withColumn("leg", leg).filter("leg IS NOT NULL").withColumn("amount", F.round(F.col("value") * 100).cast("decimal(38,0)"))
    joined = asof.label(asof.asof_backward(left.select("event_id", "user_id", "leg", "us", "amount"), rates, "us", "rate_us", ["rate"], by=["user_id"]), "us", "rate_us")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return joined.select(
        "event_id", "user_id", F.col("leg").cast("int").alias("leg"), "us", "amount", scalars.swap_fee(F.col("amount"), int(config["fee_tier"])).cast("decimal(38,0)").alias("fee"),
        "rate", "rate_us", "method", day.alias("day"), F.lit(since).cast("long").alias("since"),
    )


def summed(rows: DataFrame) -> DataFrame:
    """One row a day and leg. Ties are events at a time of their leg that another event has too."""
    at = rows.groupBy("day", "leg", "us", "method", "user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("fee").alias("fee"))
    times = at.groupBy("day", "leg", "us").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.sum("fee").alias("fee"),
        *[F.sum(F.when(F.col("method") == m, F.col("n")).otherwise(0)).alias(m) for m in ("exact", "forward_fill", "unavailable")],
    )
    days = times.groupBy("day", "leg").agg(
        F.sum("n").cast("long").alias("events"), F.sum("amount").cast("decimal(38,0)").alias("volume"), F.sum("fee").cast("decimal(38,0)").alias("fees"),
        *[F.sum(m).cast("long").alias(m) for m in ("exact", "forward_fill", "unavailable")],
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias("ties"),
    )
    users = rows.groupBy("day", "leg", "user_id").agg(F.lit(1).alias("x")).groupBy("day", "leg").agg(F.count("user_id").alias("users"))
    return days.join(users, ["day", "leg"]).select("leg", "events", "users", "volume", "fees", "exact", "forward_fill", "unavailable", "ties", "day")


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Take what is new into the output folder; how much was read and written, and the new mark.

    Without any event, or with nothing final since the mark, the counts are 0. Null times are never final;
    null users match no rate, and of the excluded event type they are left out; null amounts stay null. Columns beside the five of events
    that the job needs are ignored. Session settings are left alone.
    """
    config = config or settings(spark)
    events = spark.read.parquet(f"{tables.rstrip('/')}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")
    for name, schema, by in (("panel", PANEL, ("day", "since")), ("report", REPORT, ("day",)), ("state", STATE, ("slot",)), ("mark", MARK, ())):
        prepared(spark, f"{out}/{name}", schema, *by)
    marks = stored(spark, f"{out}/mark", MARK).agg(F.max("upto").alias("upto"), F.count("*").alias("runs")).first()
    since, slot = marks["upto"], marks["runs"] % 2
    fresh = events if since is None else events.filter(F.col("ts") > moment(since))
    head = fresh.agg(F.max(asof.epoch_us("ts"))).first()[0]
    upto = None if head is None else head - int(config["lag_seconds"]) * 1_000_000
    if upto is None or since is not None and upto <= since:
        log.info("nothing final since %s", since)
        return {"read": 0, "wrote": 0, "since": since, "upto": since}
    rows, start = taken(events, since, head, config), since or 0
    rates = rows.filter(F.col("event_type") == config["rate"]).groupBy("user_id", F.col("us").alias("rate_us")).agg(F.max("value").alias("rate"))
    if since is not None:
        before = stored(spark, f"{out}/state", STATE).filter(F.col("slot") == 1 - slot)
        rates = rates.unionByName(before.select("user_id", F.col("us").alias("rate_us"), "rate"))
    read = rows.count()
    log.info("read %d events of %s after %s up to %s", read, tables, since, upto)
    wrote = put(legs_of(rows, rates, start, config), f"{out}/panel", "day", "since")
    log.info("wrote %d rows to %s/panel", wrote, out)
    newest = rates.groupBy("user_id").agg(F.max(F.struct("rate_us", "rate")).alias("x"))
    held = put(newest.select("user_id", F.col("x.rate_us").alias("us"), "x.rate", F.lit(slot).alias("slot")), f"{out}/state", "slot")
    log.info("wrote %d rates to %s/state", held, out)
    touched = stored(spark, f"{out}/panel", PANEL)
    touched = touched if since is None else touched.filter(F.col("day") >= F.lit((EPOCH + timedelta(microseconds=since)).date()))
    log.info("wrote %d rows to %s/report", put(summed(touched), f"{out}/report", "day"), out)
    spark.createDataFrame([(start, upto, read, wrote)], MARK).coalesce(1).write.mode("append").parquet(f"{out}/mark")
    return {"read": read, "wrote": wrote, "since": since, "upto": upto}


def output(spark: SparkSession, out: str) -> DataFrame:
    """The panel as it stands, each row with the figures of its day and leg."""
    rows, days = stored(spark, f"{out}/panel", PANEL).drop("since"), stored(spark, f"{out}/report", REPORT)
    days = days.select("day", "leg", F.col("events").alias("day_events"), F.col("users").alias("day_users"), F.col("fees").cast("string").alias("day_fees"), F.col("exact").alias("day_exact"), F.col("ties").alias("day_ties"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("amount", "fee")}).join(days, ["day", "leg"], "left")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--tables", required=True, help="folder of the tables")
    args.add_argument("--out", required=True, help="output folder, the same for every run")
    args.add_argument("--config", default=CONFIG, help="TOML file")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("leg_panel").getOrCreate()
    try:
        run(spark, given.tables, given.out.rstrip("/"), settings(spark, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
