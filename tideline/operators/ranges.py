"""Ordered work in ranges: ranks, lags and carried values whose tasks follow the rows, not the number of keys.

A window over a key is one task a key, and here there are often two keys. So rows are dealt into ranges of
about equal size by the ordering column; each key's part of a range is a window of its own, and what a
window needs from the ranges before it (a count, the last value) comes from a table of one row a key and range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should have, and the most ranges there are; beyond, ranges grow.
RANGE_ROWS = 200_000
MOST_RANGES = 1024

#: A range begins at an order value, and within one very common value at a tie value.
Point = tuple[float | int, float | int | None]


def _quantiles(column: str, n: int) -> Column:
    return F.expr(f"percentile_approx(`{column}`, array({', '.join(repr(i / n) + 'D' for i in range(1, n))}), 10000)")


def cuts(df: DataFrame, order: str, tie: str | None = None, range_rows: int | None = None, most: int = MOST_RANGES) -> list[Point]:
    """Where ranges of about range_rows rows begin, in order: one pass over two columns, a bounded result.

    A value too common for one range is cut by `tie`, where there is one. Both columns must be numbers.
    """
    range_rows = range_rows or RANGE_ROWS
    n_rows = df.count()
    n = min(most, math.ceil(n_rows / range_rows))
    if n <= 1:
        return []
    at = df.agg(_quantiles(order, n).alias("q")).first()["q"] or []
    at = [v for v in at if v is not None and math.isfinite(v)]
    points: list[Point] = [(v, None) for v in sorted(set(at))]
    often = {v: at.count(v) for v in set(at) if at.count(v) > 1}
    if tie and often:
        own = df.filter(F.col(order).isin(list(often))).groupBy(order).agg(_quantiles(tie, n).alias("q")).collect()  # at most n rows
        for r in own:
            k = often[r[order]]
            some = [r["q"][(i * len(r["q"])) // (k + 1)] for i in range(1, k + 1)] if r["q"] else []
            points += [(r[order], t) for t in sorted(set(some))]
    return sorted(points, key=lambda p: (p[0], -math.inf if p[1] is None else p[1]))


def _literal(v: float | int) -> str:
    return f"{v!r}D" if isinstance(v, float) else f"{v}L"


def place(points: Sequence[Point], order: str, tie: str | None = None) -> Column:
    """The number of the range of each row, by a decision tree over the points; null orders are in the first."""

    def reached(p: Point) -> str:
        v, t = p
        if t is None:
            return f"`{order}` >= {_literal(v)}"
        return f"(`{order}` > {_literal(v)} OR (`{order}` = {_literal(v)} AND `{tie}` >= {_literal(t)}))"

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high + 1) // 2
        return f"IF({reached(points[mid - 1])}, {tree(mid, high)}, {tree(low, mid - 1)})"

    return F.expr(tree(0, len(points)))


def ranked(df: DataFrame, by: Sequence[str], order: str, tie: str | None = None, name: str = "i", totals: Mapping[str, Column] | None = None, range_rows: int | None = None) -> DataFrame:
    """df with `name`, the row number from 1 within the keys `by` in the order of `order`, then `tie`, and with
    each key's `totals`, which are aggregates. Keys must not be null."""
    points = cuts(df, order, tie, range_rows)
    d = df.withColumn("_b", place(points, order, tie))
    sizes = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    known = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    if totals:
        known = known.join(df.groupBy(*by).agg(*[c.alias(k) for k, c in totals.items()]), list(by))
    w = Window.partitionBy(*by, "_b").orderBy(order, *([tie] if tie else []))
    out = d.withColumn("_own", F.row_number().over(w)).join(known, [*by, "_b"])
    return out.select(*[F.col(c) for c in df.columns], (F.col("_own") + F.col("_before")).alias(name), *(totals or {}))


def lagged(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, range_rows: int | None = None) -> DataFrame:
    """df with `name`, the value of the row before within the keys in the order of `order`, then the value; null for the first."""
    points = cuts(df, order, None, range_rows)
    d = df.withColumn("_b", place(points, order))
    w = Window.partitionBy(*by, "_b").orderBy(order, value)
    ends = d.groupBy(*by, "_b").agg(F.max_by(value, F.struct(order, value)).alias("_end"))
    known = ends.select(*by, "_b", F.lag("_end").over(Window.partitionBy(*by).orderBy("_b")).alias("_before"))
    out = d.withColumns({"_own": F.lag(value).over(w), "_at": F.row_number().over(w)}).join(known, [*by, "_b"])
    return out.select(*[F.col(c) for c in df.columns], F.when(F.col("_at") == 1, F.col("_before")).otherwise(F.col("_own")).alias(name))


def carried(both: DataFrame, by: Sequence[str], order: str, side: str, value: str, range_rows: int | None = None) -> DataFrame:
    """both with `value` filled by the newest one so far, within the keys, in the order of `order`, nulls first,
    then `side`. Keys may be null."""
    points = cuts(both, order, None, range_rows)
    d = both.withColumn("_b", place(points, order))
    up_to = Window.partitionBy(*by, "_b").orderBy(F.col(order).asc_nulls_first(), side).rowsBetween(Window.unboundedPreceding, 0)
    swept = d.withColumn(value, F.last(value, ignorenulls=True).over(up_to))
    if not points:
        return swept.drop("_b")
    ends = d.groupBy(*by, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(*[F.col(c).alias(f"_key_{c}") for c in by], F.col("_b").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    same = F.col("_b") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    out = swept.join(known, same, "left").withColumn(value, F.coalesce(value, "_before"))
    return out.select(*both.columns)
