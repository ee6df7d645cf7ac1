"""Catalog: the three entry points over logs made of the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import bigints
from tideline.operators import hawkes
from tideline.plans import pipelines
from tideline.plans.catalog_process import process
from tideline.plans.registry import query
from tideline.session import table


def panel_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logs, states and rates in the shape of the sources: blocks are event ids, swaps are purchases."""
    w = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
    ev = table(spark, sf_dir, "events")
    topic = {v: k for k, v in bigints.TOPICS.items()}
    cents = F.round(F.col("value") * 100).cast("long") + 1
    swap = F.concat(F.lit("0x"), w(cents), F.lit("f" * 48), F.lpad(F.lower(F.hex(-cents)), 16, "0"), w(cents * 7), w(cents * 3), w(F.col("user_id")))
    t = lambda name: F.array(F.lit(topic[name]), F.concat(F.lit("0x"), w(F.col("user_id"))), F.concat(F.lit("0x"), w(F.col("user_id") + 1)))
    logs = ev.filter(F.col("event_type").isin("purchase", "click")).select(
        F.col("event_id").alias("blockNumber"), F.lit("").alias("blockHash"), F.concat(F.lit("0x"), F.sha2(F.col("event_id").cast("string"), 256)).alias("txHash"), F.lit(0).cast("long").alias("logIndex"),
        F.lit("0xpool").alias("contractAddress"), F.when(F.col("event_type") == "purchase", t("Swap")).otherwise(t("Transfer")).alias("topics"),
        F.when(F.col("event_type") == "purchase", swap).otherwise(F.concat(F.lit("0x"), w(cents))).alias("data"), F.col("event_id").alias("block_timestamp"),
    )
    state = ev.filter("event_id % 2 = 0").select(
        F.col("event_id").alias("blockNumber"), F.lit("1000000000000000000").alias("totalAmounts_0"), F.lit("2000000000000000000").alias("totalAmounts_1"), F.lit("1").alias("totalSupply"),
        F.col("user_id").cast("int").alias("currentTick"), F.lit(20).alias("lowerTick"), F.lit(60).alias("upperTick"),
    )
    rates = ev.filter("event_id % 10 = 0").select(F.col("event_id").alias("block"), F.lit("broker").alias("source"), (F.col("event_id") * 10).cast("string").alias("rate_x1e18"), F.when(F.col("event_id") % 20 == 0, "exact").otherwise("unavailable").alias("method"), F.lit("https://example.org").alias("provenance_url"))
    return logs, state, rates


@query(
    "panel",
    """
    WITH head AS (SELECT max(event_id) - 120 AS h FROM events),
    e AS (SELECT event_id AS block, event_type, user_id, (round(value * 100))::BIGINT + 1 AS c FROM events, head WHERE event_type IN ('purchase', 'click') AND event_id <= h),
    r AS (SELECT event_id AS rb, (event_id * 10)::VARCHAR AS rate FROM events WHERE event_id % 20 = 0)
    SELECT block, CASE event_type WHEN 'purchase' THEN 'Swap' ELSE 'Transfer' END AS event_name,
      CASE WHEN block % 2 <> 0 THEN FALSE WHEN event_type = 'purchase' THEN user_id BETWEEN 20 AND 60 END AS vault_in_range,
      CASE event_type WHEN 'purchase' THEN ((c * 100) // 999900)::VARCHAR END AS fee_token0,
      CASE event_type WHEN 'purchase' THEN '0' END AS fee_token1,
      rate AS rate_x1e18, CASE WHEN rb IS NULL THEN 'unavailable' WHEN rb = block THEN 'exact' ELSE 'forward_fill' END AS fx_method
    FROM e ASOF LEFT JOIN r ON e.block >= r.rb
    """,
)
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, state, rates = panel_inputs(spark, sf_dir)
    head = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    p = pipelines.materialize(logs, None, state, rates, head, 100)
    return p.select(F.col("blockNumber").alias("block"), "event_name", "vault_in_range", "fee_token0", "fee_token1", "rate_x1e18", "fx_method")


def _record(spark: SparkSession, record: dict) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in record.items()], "key string, value string")


@query("fit_report")
def fit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _ = process(spark, sf_dir)
    return _record(spark, pipelines.fit(l))


@query("hedge_verdict")
def hedge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _ = process(spark, sf_dir)
    report = pipelines.fit(l)
    h = report["hawkes"]
    p = hawkes.Params((h["mu0"], h["mu1"]), ((h["a00"], h["a01"]), (h["a10"], h["a11"])), h["beta"])
    return _record(spark, pipelines.hedge(report, hawkes.residuals(l, p)))
