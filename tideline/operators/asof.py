"""Backward as-of join with provenance labels.

Both sides are unioned and the newest right row at or before each left row is carried forward, within
the keys and ranges of the order, so that neither a hot key nor a join without keys is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import ranges


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Left rows with the columns right_on and values of the newest right row whose key is <= on.

    Every left row stays, duplicates too; nulls where no right row precedes. Right keys should be
    unique within by; on equal keys the right row counts as preceding. Null keys match nothing.
    """
    lcols = [c for c in left.columns if c not in by]
    lrow = left.select(*by, F.col(on).alias("_k"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in lcols]).alias("_l"), F.lit(None).alias("_r"))
    lrow = lrow.drop("_r")
    rrow = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_k"), F.lit(0).alias("_side"), F.struct(F.col(right_on), *[F.col(c) for c in values]).alias("_r"))
    both = lrow.unionByName(rrow, allowMissingColumns=True)
    out = ranges.carried(both, by, "_k", "_side", "_r").filter("_side = 1")
    matched = F.col("_k").isNotNull()
    return out.select(*by, "_l.*", *[F.when(matched, F.col(f"_r.{c}")).alias(c) for c in (right_on, *values)])


def label(df: DataFrame, on: str, right_on: str, name: str = "method") -> DataFrame:
    """Provenance of an as-of match: unavailable, exact or forward_fill."""
    return df.withColumn(
        name,
        F.when(F.col(right_on).isNull(), "unavailable").when(F.col(right_on) == F.col(on), "exact").otherwise("forward_fill"),
    )
