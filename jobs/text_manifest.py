"""Streaming manifest of text tables: which texts are held, since when, how often, and a hash of it all.

    python -m jobs.text_manifest --tables DIR --out DIR [--config FILE]

Each table of the config is a file stream with its own checkpoint under OUT/checkpoint. A run takes the
files that no earlier run has taken, in batches of at most `files_per_batch`, and ends. Under the output
folder, as Parquet by kind and batch:

    manifest/  one row a text that this batch brings for the first time: its sha256, least id and bytes
    copies/    one row a text of this batch, new or not: its rows and least id
    ledger/    one row a source: rows, texts, nulls, bytes, and sums that make an order-free hash

A batch that is taken again after a failure writes the same partitions again, as it is held against
earlier batches alone, so each row is there once. Ledgers and copies of batches add up: the result does
not depend on how the files fell into batches.
"""

from __future__ import annotations

import argparse
import logging
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = str(Path(__file__).with_name("text_manifest.toml"))
MANIFEST = "key string, first_id array<long>, bytes long, kind string, batch long"
COPIES = "key string, n_rows long, first_id array<long>, kind string, batch long"
LANES = 8
LEDGER = "source string, n_rows long, n_null long, bytes long, " + ", ".join(f"s{k} decimal(38,0)" for k in range(LANES)) + ", kind string, batch long"
log = logging.getLogger("jobs.text_manifest")


def settings(spark: SparkSession, path: str = CONFIG) -> dict:
    """The configuration, a TOML file that Spark reads."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the output folder."""
    return spark.read.schema(schema).parquet(path)


def prepared(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """An empty table, where no run has written one."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").partitionBy(*by).parquet(path)


def put(df: DataFrame, path: str) -> None:
    """Write a batch over its own partition and no other."""
    df.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(path)


def records(rows: DataFrame, table: dict) -> DataFrame:
    """id (its columns as longs), source (null: empty), key (sha256 of the text; null for none) and bytes."""
    source: Column = F.expr(table["source"]).cast("string")
    text = F.col(table["text"])
    return rows.select(F.array(*[F.col(c).cast("long") for c in table["id"]]).alias("id"), F.coalesce(source, F.lit("")).alias("source"), F.sha2(text.cast("binary"), 256).alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def sums(rows: DataFrame) -> DataFrame:
    """One row a source; the sums of a row's hash in eight lanes of 32 bits add up over batches in any order."""
    row = F.sha2(F.concat_ws("|", F.array_join("id", ":", "-"), "source", F.coalesce("key", F.lit("-"))), 256)
    lane = lambda k: F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(28,0)")).cast("decimal(38,0)").alias(f"s{k}")
    return rows.withColumn("h", row).groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("key").isNull()).alias("n_null"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), *map(lane, range(LANES)))


def take(out: str, table: dict):
    """What a stream does with each batch of a table's rows."""

    def one(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marked = lambda df: df.withColumns({"kind": F.lit(table["name"]), "batch": F.lit(batch).cast("long")})
        found = records(rows, table)
        put(marked(sums(found)), f"{out}/ledger")
        texts = found.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.first("bytes").alias("bytes"))
        put(marked(texts.select("key", "n_rows", "first_id")), f"{out}/copies")
        mine = (F.col("kind") == table["name"]) & (F.col("batch") < batch)
        known = stored(spark, f"{out}/manifest", MANIFEST).filter(mine).select("key")
        put(marked(texts.join(known, "key", "left_anti").select("key", "first_id", "bytes")), f"{out}/manifest")
        here = (F.col("kind") == table["name"]) & (F.col("batch") == batch)
        n = stored(spark, f"{out}/ledger", LEDGER).filter(here).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        log.info("batch %d of %s: read %d rows, wrote %d new texts to %s", batch, table["name"], n, stored(spark, f"{out}/manifest", MANIFEST).filter(here).count(), out)

    return one


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Take every file not taken before into the output folder; the batches each table had in this run.

    The tables' own schemas are read first; columns that the config does not name are ignored. Null texts
    count in the ledger and have no entry; null sources are the source ''; null ids stay null in their id.
    Session settings are left alone.
    """
    config = config or settings(spark)
    for name, schema in (("manifest", MANIFEST), ("copies", COPIES), ("ledger", LEDGER)):
        prepared(spark, f"{out}/{name}", schema, "kind", "batch")
    taken = {}
    for table in config["tables"]:
        path = f"{tables.rstrip('/')}/{table['name']}.parquet"
        # as a pattern of its one name, since a stream takes a plain path for a folder, and a table may be one file
        rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(f"{path[:-1]}[{path[-1]}]")
        stream = rows.writeStream.foreachBatch(take(out, table)).option("checkpointLocation", f"{out}/checkpoint/{table['name']}").trigger(availableNow=True).start()
        stream.awaitTermination()
        taken[table["name"]] = sum(p["numInputRows"] > 0 for p in stream.recentProgress)
        log.info("%s: %d batches", path, taken[table["name"]])
    return taken


def output(spark: SparkSession, out: str) -> DataFrame:
    """The manifest as it stands: one row a kind and text, with its rows so far and the hash of its kind."""
    entries = stored(spark, f"{out}/manifest", MANIFEST)
    copies = stored(spark, f"{out}/copies", COPIES).groupBy("kind", "key").agg(F.sum("n_rows").alias("n_rows"), F.min("first_id").alias("first_id"))
    ledger = stored(spark, f"{out}/ledger", LEDGER).groupBy("kind").agg(F.sum("n_rows").alias("kind_rows"), F.sum("n_null").alias("kind_null"), F.sum("bytes").alias("kind_bytes"), F.count_distinct("source").alias("kind_sources"), *[F.sum(f"s{k}").cast("string").alias(f"s{k}") for k in range(LANES)])
    hashed = F.sha2(F.concat_ws(":", F.col("kind_rows").cast("string"), *[F.col(f"s{k}") for k in range(LANES)]), 256)
    kinds = F.broadcast(ledger.select("kind", "kind_rows", "kind_null", "kind_bytes", "kind_sources", hashed.alias("kind_hash")))  # one row a table of the config
    return entries.select("kind", "key", "bytes").join(copies, ["kind", "key"]).join(kinds, "kind").select("kind", "key", "bytes", "n_rows", F.array_join("first_id", ":").alias("first_id"), "kind_rows", "kind_null", "kind_bytes", "kind_sources", "kind_hash")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--tables", required=True, help="folder of the tables")
    args.add_argument("--out", required=True, help="output folder, the same for every run")
    args.add_argument("--config", default=CONFIG, help="TOML file")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_manifest").getOrCreate()
    try:
        run(spark, given.tables, given.out.rstrip("/"), settings(spark, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
