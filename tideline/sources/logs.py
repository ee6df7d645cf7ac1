"""Sources with declared schemas: logs, vault state, rates, panels and their provenance."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import hex_to_long

LOG_WIRE = "blockNumber string, blockHash string, transactionHash string, txHash string, logIndex string, address string, contractAddress string, topics array<string>, data string, timeStamp string"
STATE = "blockNumber long, totalAmounts_0 string, totalAmounts_1 string, totalSupply string, currentTick int, lowerTick int, upperTick int"
RATES = "block long, source string, rate_x1e18 string, method string, provenance_url string"
LEDGER = "timestamp timestamp, endpoint string, cost double, _corrupt_record string"
PROVENANCE_KEYS = ("chainId", "contractAddress", "blockRange", "fetchTimestamp", "dataHash", "gitCommit")


def log_rows(raw: DataFrame) -> DataFrame:
    """Typed logs from the wire's strings. A null block or time stops the query.

    blockHash and transaction hash default to the empty string, the log index to 0; addresses are in lower case.
    """
    need = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"null {name} in a log")).cast("long"))
    return raw.select(
        need(hex_to_long("blockNumber"), "blockNumber").alias("blockNumber"),
        F.coalesce("blockHash", F.lit("")).alias("blockHash"),
        F.coalesce("transactionHash", "txHash", F.lit("")).alias("txHash"),
        F.coalesce(hex_to_long("logIndex"), F.lit(0)).cast("long").alias("logIndex"),
        F.lower(F.coalesce("address", "contractAddress", F.lit(""))).alias("contractAddress"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("data", F.lit("0x")).alias("data"),
        need(hex_to_long("timeStamp"), "timeStamp").alias("block_timestamp"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs from JSON lines; blank lines are skipped, other lines must parse."""
    return log_rows(spark.read.schema(LOG_WIRE).option("mode", "FAILFAST").json(path))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).json(path)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rates; an empty file is an empty table of the same columns."""
    return spark.read.schema(RATES).json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows that parse; others are skipped."""
    return spark.read.schema(LEDGER).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache().filter("_corrupt_record IS NULL").drop("_corrupt_record")


def write_panel(df: DataFrame, path: str, provenance: Mapping[str, str]) -> None:
    """Parquet whose first column carries the provenance in its metadata; all six keys are needed before any write."""
    if missing := [k for k in PROVENANCE_KEYS if k not in provenance]:
        raise ValueError(f"provenance lacks {', '.join(missing)}")
    first = df.columns[0]
    meta = {**df.schema[first].metadata, "provenance": json.dumps(dict(provenance), sort_keys=True)}
    df.withMetadata(first, meta).write.parquet(path)


def read_provenance(spark: SparkSession, path: str) -> dict[str, str]:
    """The provenance of a panel, from its schema alone."""
    schema = spark.read.parquet(path).schema
    return json.loads(schema[0].metadata.get("provenance", "{}")) if len(schema) else {}


def normalise_tx_logs(items: DataFrame, topic: str) -> DataFrame:
    """Logs of transactions in the newer shape, only those of one topic, as wire rows; they bear no time."""
    return items.filter(F.get("topics", F.lit(0)) == topic).select(
        F.concat(F.lit("0x"), F.hex(F.col("block_number").cast("long"))).alias("blockNumber"), F.col("block_hash").alias("blockHash"),
        F.col("transaction_hash").alias("transactionHash"), F.lit(None).cast("string").alias("txHash"),
        F.concat(F.lit("0x"), F.hex(F.col("index").cast("long"))).alias("logIndex"), F.col("address.hash").alias("address"),
        F.lit(None).cast("string").alias("contractAddress"), F.array_compact("topics").alias("topics"), "data", F.lit("0x0").alias("timeStamp"),
    )
