"""Event panel: cutoff, names, exclusion, state join with a range flag, fees, rates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import bigints, scalars
from tideline.operators import asof

FINALITY = 120
#: Addresses whose transfers are fee bookkeeping.
ADAPTERS = (
    "0x000000000000000000000000000000000ce106a5",
    "0xcd437749e43a154c07f3553504c68fbfd56b8778",
    "0x4200000000000000000000000000000000000011",
    "0x2f25deb3848c207fc8e0c34035b3ba7fc157602b",
    "0x0e2a3e05bc9a16f5292a6170456a710cb89c6f72",
)


def final_only(df: DataFrame, head: int | Column, lag: int | Column = FINALITY, on: str = "blockNumber") -> DataFrame:
    """Rows at least `lag` behind the head. First in every plan, so that it reaches the scan."""
    return df.filter(F.col(on) <= (head if isinstance(head, Column) else F.lit(head)) - lag)


def lookup(key: Column, names: Mapping[str, str], default: str = "Unknown") -> Column:
    """A constant map applied to a key, exact in case; rows of other keys get the default."""
    if not names:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(default))


def event_name(topics: str = "topics") -> Column:
    names = bigints.TOPICS | {bigints.topic_of(f"{n}(address,address,uint256,uint256,uint256)"): n for n in ("Deposit", "Withdraw")}
    return lookup(F.get(F.col(topics), 0), names)


def exclude(df: DataFrame, event: str, kind: str, columns: Iterable[str], addresses: Iterable[str] = ADAPTERS) -> DataFrame:
    """Without the rows of one kind that touch an address of a set, in any case of letters.

    As in the reference, a row of that kind whose predicate is unknown, by a null column, is dropped too.
    """
    found = [a.lower() for a in addresses]
    touched = None
    for c in columns:
        one = F.lower(F.col(c).cast("string")).isin(found)
        touched = one if touched is None else touched | one
    return df.filter(~((F.coalesce(F.col(event), F.lit("")) == kind) & touched))


def decode(df: DataFrame) -> DataFrame:
    """df with event_name and the fields of the payload; what cannot be decoded says why in decode_error."""
    named = df.withColumn("event_name", event_name())
    out = named.withColumn("_p", bigints.decode_udf(F.col("event_name"), F.col("topics"), F.col("data")))
    return out.select(*named.columns, "_p.*")


def in_range(left: DataFrame, state: DataFrame, on: str, value: str, lower: str, upper: str, flag: str = "in_range", small_state: bool = False) -> DataFrame:
    """left join of a state table by key, and whether value is in [lower, upper].

    False where a bound is missing; null where the bounds are there but the value is not. The state has
    one row a key; broadcast it only if its size is known to be small.
    """
    s = F.broadcast(state) if small_state else state
    bounds = F.col(lower).isNotNull() & F.col(upper).isNotNull()
    return left.join(s, on, "left").withColumn(flag, bounds & (F.col(value) >= F.col(lower)) & (F.col(value) <= F.col(upper)))


def attach_fees(df: DataFrame, tier: int) -> DataFrame:
    """Swap rows get fees and the vault's share as decimal strings, exact; others null.

    Products of up to 38 digits stay in the JVM; where one overflows, the Arrow function redoes it.
    """
    swap = F.col("event_name") == "Swap"
    live = F.coalesce(F.col("vault_in_range"), F.lit(False))
    out = df
    for k in (0, 1):
        fee = scalars.swap_fee(F.col(f"amount{k}"), tier)
        out = out.withColumn(f"fee_token{k}", F.when(swap, fee.cast("string")))
        share = scalars.vault_share(F.col(f"fee_token{k}").cast(scalars.NUMERIC), F.col("vault_liquidity"), F.col("liquidity"), live)
        again = F.when(live, bigints.share_udf(F.col(f"fee_token{k}"), F.col("vault_liquidity"), F.col("liquidity"))).otherwise(F.lit("0"))
        out = out.withColumn(f"vault_fee_token{k}", F.when(swap, F.coalesce(share.cast("string"), again)))
    return out


def attach_rates(df: DataFrame, rates: DataFrame, on: str = "blockNumber") -> DataFrame:
    """The newest exact rate at or before each row, how it was found, and where it is from.

    rates has block, rate_x1e18, method, provenance_url. The rate is named by its unit: out per in, times 1e18.
    """
    exact = rates.filter(F.col("method") == "exact").groupBy(F.col("block").alias("rate_block")).agg(F.max("rate_x1e18").alias("rate_x1e18"), F.max("provenance_url").alias("rate_url"))
    out = asof.asof_backward(df, exact, on, "rate_block", ["rate_x1e18", "rate_url"])
    return asof.label(out, on, "rate_block", "fx_method").withColumns({"usd_rate": F.lit("1.0"), "usd_method": F.lit("stipulated")})


def materialize(pool_logs: DataFrame, transfer_logs: DataFrame | None, state: DataFrame, rates: DataFrame, head: int, tier: int, lag: int = FINALITY) -> DataFrame:
    """The whole panel as one lazy plan: union, cutoff, decode, exclusion, state, liquidity, fees, rates."""
    logs = pool_logs if transfer_logs is None else pool_logs.unionByName(transfer_logs)
    p = decode(final_only(logs, head, lag))
    p = exclude(p, "event_name", "Transfer", ["from", "to"])
    s = state.withColumnRenamed("currentTick", "vault_currentTick")
    p = in_range(p, s, "blockNumber", "tick", "lowerTick", "upperTick", "vault_in_range")
    swap = F.col("event_name") == "Swap"
    own = bigints.liquidity_udf(F.col("vault_currentTick"), F.col("lowerTick"), F.col("upperTick"), F.col("totalAmounts_0"), F.col("totalAmounts_1"))
    p = p.withColumn("vault_liquidity", F.when(swap, own))
    return attach_rates(attach_fees(p, tier), rates)


def legs(panel: DataFrame, time: str = "block_timestamp") -> DataFrame:
    """(leg, t) of swaps: leg 0 where amount0 comes in, leg 1 where amount1 does."""
    swaps = panel.filter("event_name = 'Swap'")
    pairs = F.array(*[F.struct(F.lit(k).alias("leg"), (F.col(f"amount{k}").cast(scalars.NUMERIC) > 0).alias("on")) for k in (0, 1)])
    return swaps.select(F.col(time).cast("double").alias("t"), F.explode(pairs).alias("p")).filter("p.on").select("p.leg", "t")
