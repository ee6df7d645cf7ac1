"""Cost ledger, manifests, budgets, samples, artifact contracts and sweeps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH = "graph-mainnet"
MONTHLY_CAP = 90_000
PAGE_ROWS = 1_000
BLOCK_CHUNK = 10_000


def guard(ledger: DataFrame, endpoint: str = GRAPH) -> DataFrame:
    """One row: ok, hits: whether no call went to a forbidden endpoint. Rows that did not parse are skipped."""
    return ledger.agg(F.count_if(F.coalesce(F.col("endpoint") == endpoint, F.lit(False))).alias("hits")).select((F.col("hits") == 0).alias("ok"), "hits")


def month_to_date(ledger: DataFrame, now: Column, endpoint: str = GRAPH, cap: int = MONTHLY_CAP) -> DataFrame:
    """One row: used, over: calls to an endpoint since the month of `now` began, against a cap."""
    since = F.date_trunc("MONTH", now)
    return ledger.filter((F.col("endpoint") == endpoint) & (F.col("timestamp") >= since)).agg(F.count("*").alias("used")).withColumn("over", F.col("used") >= cap)


def budget(vaults: DataFrame, earmark: int = 30_000) -> DataFrame:
    """vaults that are active, with pages of blocks and swaps, calls, and whether they exceed an earmark."""
    d = vaults.filter("active")
    chunks, pages = F.ceil(F.col("blocks") / BLOCK_CHUNK), F.ceil(F.col("swaps") / PAGE_ROWS)
    d = d.withColumns({"block_calls": chunks, "swap_calls": pages}).withColumn("calls", F.col("block_calls") + F.col("swap_calls"))
    return d.withColumn("over", F.col("calls") > earmark)


def insert_new(manifest: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """manifest and those of rows whose key it does not hold, one a key: the upsert that never replaces."""
    fresh = rows.join(manifest.select(key), key, "left_anti").dropDuplicates([key])
    return manifest.unionByName(fresh)


def find(manifest: DataFrame, key: str, value: str) -> DataFrame:
    return manifest.filter(F.col(key) == value)


def seeded_sample(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows by the order of a hash of seed and key: the same in any engine and under any partitioning."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def fresh(meta: DataFrame, head: int, most: int = 100) -> DataFrame:
    """meta with lag and fresh; a missing block is not fresh."""
    lag = F.lit(head) - F.col("block")
    return meta.withColumn("lag", lag).withColumn("fresh", F.coalesce(lag <= most, F.lit(False)))


def missing_keys(present: Column, required: Sequence[str]) -> Column:
    """Required keys that a record lacks, in order."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of all rows with their multiplicities: order and partitioning do not matter.

    Each row's sha256 is eight numbers of 32 bits; their sums and the number of rows are hashed. Sums
    combine before the shuffle, so one small row a task is all that moves.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    lane = lambda k: F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(28,0)")).cast("string")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[lane(k).alias(f"s{k}") for k in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}") for k in range(8)]), 256).alias("hash"))


MOST_CELLS = 10_000


def sweep_rows(df: DataFrame, grids: Mapping[str, Sequence[float]], decision: Column) -> DataFrame:
    """Every row of df at every combination of some small grids, with the decision there.

    The grids are exploded where the row is, so nothing is joined or shuffled; more than MOST_CELLS combinations are an error.
    """
    if (cells := math.prod(len(v) for v in grids.values())) > MOST_CELLS:
        raise ValueError(f"{cells} combinations, at most {MOST_CELLS} a row")
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df.withColumn("decision", decision)


def invariance(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The keys `by`, cells, outcomes (distinct decisions, null is none), invariant: whether there is just one."""
    seen = lambda d: F.coalesce(F.bool_or(d).cast("int"), F.lit(0))
    d = cells.groupBy(*by).agg(F.count("*").alias("cells"), (seen(F.col("decision")) + seen(~F.col("decision"))).cast("long").alias("outcomes"))
    return d.withColumn("invariant", F.col("outcomes") == 1)
