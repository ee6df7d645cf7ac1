"""Ordered sums over time without an ordered pass: decayed sums, counts and last values as native windows.

Time is dealt into leaves of equal width, so short that exp(beta * width) is a number and that a leaf holds
about ranges.RANGE_ROWS distinct times. What a time needs from its own leaf is a running sum; what it needs
from the leaves before comes from tables of one row a leaf, of one row a group of leaves, and of one row a
stretch of groups. None of them has a bound, and no window holds more than about the root of the number of leaves,
times apart. Events at one time are one row with their number, so ties take no more work than a single event.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ranges

#: The largest exponent that a running sum of exponentials may reach; what lies further back has faded to nothing.
EXPONENT = 600.0
LEGS = (0, 1)


@dataclass(frozen=True)
class Leaves:
    """Leaves of one width from `low` on; group: leaves of a group; stretch: groups of a stretch; root: leaves of a block of plain sums;
    rows: how many times are dealt. Leaves can far outnumber rows where the decay is fast and the span long."""

    low: float
    width: float
    group: int
    stretch: int
    root: int
    rows: int = 0

    @property
    def alone(self) -> bool:
        """Whether one leaf holds all, so that nothing comes from leaves before."""
        return self.root == 1

    def of(self, t: Column) -> Column:
        return F.floor((t - F.lit(self.low)) / F.lit(self.width)).cast("long")


def leaves_of(times: DataFrame, beta: float, range_rows: int | None = None) -> Leaves:
    """How to deal the column t of times: one aggregate over it."""
    r = times.agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("t").alias("n")).first()
    if not r["n"] or r["high"] <= r["low"]:
        return Leaves(r["low"] or 0.0, 1.0, 1, 1, 1, r["n"])
    span = r["high"] - r["low"]
    width = min(EXPONENT / beta, span * (range_rows or ranges.RANGE_ROWS) / r["n"])
    root = max(1, math.ceil(math.sqrt(math.floor(span / width) + 1)))
    group = max(1, min(root, int(EXPONENT / (beta * width))))
    return Leaves(r["low"], width, group, max(1, int(EXPONENT / (beta * width * group))), root, r["n"])


def earlier(*by: str, order: str):
    """The rows before the present one."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def before(leaves: DataFrame, root: int, sums: Sequence[str] = (), tops: Sequence[str] = ()) -> DataFrame:
    """_leaf with the sums and the greatest values of all leaves before it, by blocks of `root` leaves."""
    d = leaves.withColumn("_block", F.expr(f"_leaf div {root}"))
    folds = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(tops, F.max)}
    blocks = d.groupBy("_block").agg(*[f(c).alias(c) for c, f in folds.items()])
    over = earlier(order="_block")  # as many rows as blocks
    known = blocks.select("_block", *[f(c).over(over).alias(f"_{c}") for c, f in folds.items()])
    own = d.select("_leaf", "_block", *[f(c).over(earlier("_block", order="_leaf")).alias(c) for c, f in folds.items()])
    both = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0)) if f is F.sum else F.greatest(c, f"_{c}") for c, f in folds.items()}
    return own.join(known, "_block").select("_leaf", *[v.alias(c) for c, v in both.items()])


def faded(leaves: DataFrame, beta: float, at: Leaves) -> DataFrame:
    """_leaf with s_0, s_1: what is left, at its beginning, of all leaves before it; leaves has the sums at each one's end.

    Running sums are anchored at the beginning of their group or stretch, so that no exponent passes EXPONENT.
    Only the stretch just before reaches into the next one: what is older has faded by exp(-EXPONENT / 2) and more.
    """
    w = at.width

    def level(rows: DataFrame, key: str, up: str, n: int, wide: float) -> tuple[DataFrame, DataFrame]:
        """Rows with what the others of their group leave at their beginning, and the groups with their sums at their end."""
        d = rows.withColumn(up, F.expr(f"{key} div {n}"))
        begin = (F.col(key) - F.col(up) * n).cast("double") * wide
        over = earlier(up, order=key)
        own = [(F.coalesce(F.sum(F.col(f"s_{k}") * F.exp(beta * (begin + wide))).over(over), F.lit(0.0)) * F.exp(-beta * begin)).alias(f"_{up}s_{k}") for k in LEGS]
        end = [F.sum(F.col(f"s_{k}") * F.exp(-beta * (n * wide - begin - wide))).alias(f"s_{k}") for k in LEGS]
        return d.select(key, up, begin.alias(f"_{key}_begin"), *own), d.groupBy(up).agg(*end)

    leaf, groups = level(leaves, "_leaf", "_group", at.group, w)
    group, stretches = level(groups, "_group", "_stretch", at.stretch, w * at.group)
    last = stretches.select((F.col("_stretch") + 1).alias("_stretch"), *[F.col(f"s_{k}").alias(f"_l_{k}") for k in LEGS])
    into = [(F.col(f"__stretchs_{k}") + F.coalesce(F.col(f"_l_{k}"), F.lit(0.0)) * F.exp(-beta * F.col("__group_begin"))).alias(f"_g_{k}") for k in LEGS]
    known = group.join(last, "_stretch", "left").select("_group", *into)
    return leaf.join(known, "_group").select("_leaf", *[(F.col(f"__groups_{k}") + F.col(f"_g_{k}") * F.exp(-beta * F.col("__leaf_begin"))).alias(f"s_{k}") for k in LEGS])


def times(legs: DataFrame, beta: float, start: float = 0.0, range_rows: int | None = None) -> tuple[DataFrame, Leaves]:
    """One row a distinct time: _leaf, t; n_0, n_1, its events of each leg; r_0, r_1, the sums of exp(-beta (t - t')) over
    all strictly earlier events; c_0, c_1, how many of those are at or after start. Null times are left out."""
    d = legs.select("leg", F.col("t").cast("double").alias("t")).filter(F.col("t").isNotNull())
    at = leaves_of(d, beta, range_rows)
    each = d.groupBy(at.of(F.col("t")).alias("_leaf"), "t").agg(*[F.count_if(F.col("leg") == k).alias(f"n_{k}") for k in LEGS])
    begin = F.col("t") - (F.lit(at.low) + F.col("_leaf") * F.lit(at.width))
    new = [F.when(F.col("t") >= start, F.col(f"n_{k}")).otherwise(0) for k in LEGS]
    over = earlier("_leaf", order="t")
    own = each.select(
        "_leaf", "t", "n_0", "n_1", begin.alias("_begin"),
        *[(F.coalesce(F.sum(F.col(f"n_{k}") * F.exp(beta * begin)).over(over), F.lit(0.0)) * F.exp(-beta * begin)).alias(f"r_{k}") for k in LEGS],
        *[F.coalesce(F.sum(new[k]).over(over), F.lit(0)).alias(f"c_{k}") for k in LEGS],
    )
    if at.alone:
        return own.select("_leaf", "t", "n_0", "n_1", "r_0", "r_1", *[F.col(f"c_{k}").cast("double").alias(f"c_{k}") for k in LEGS]), at
    leaves = each.groupBy("_leaf").agg(*[F.sum(F.col(f"n_{k}") * F.exp(beta * (begin - at.width))).alias(f"s_{k}") for k in LEGS], *[F.sum(new[k]).alias(f"q_{k}") for k in LEGS])
    state = faded(leaves, beta, at).join(before(leaves, at.root, sums=["q_0", "q_1"]), "_leaf")
    out = own.join(state, "_leaf").select(
        "_leaf", "t", "n_0", "n_1",
        *[(F.col(f"r_{k}") + F.col(f"s_{k}") * F.exp(-beta * F.col("_begin"))).alias(f"r_{k}") for k in LEGS],
        *[(F.col(f"c_{k}") + F.col(f"q_{k}")).cast("double").alias(f"c_{k}") for k in LEGS],
    )
    return out, at


def ks_exponential(res: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, d: the Kolmogorov-Smirnov distance of positive values to the unit exponential; keys with one value are left out.

    Values are dealt by their logarithm into slots of 0.4 %, of which there can be about 200,000 a key; equal
    values are one row. A value's ranks are those of its slot's beginning and what runs up to it there.
    """
    d = res.filter(F.col(value) > 0).groupBy(key, F.floor(F.ln(value) * 256).alias("_slot"), F.col(value).alias("x")).agg(F.count("*").alias("m"))
    slots = d.groupBy(key, "_slot").agg(F.sum("m").alias("m"))
    total = F.sum("m").over(Window.partitionBy(key))
    known = slots.select(key, "_slot", F.coalesce(F.sum("m").over(earlier(key, order="_slot")), F.lit(0)).alias("_before"), total.alias("n"))
    low = F.col("_before") + F.coalesce(F.sum("m").over(earlier(key, "_slot", order="x")), F.lit(0))
    e = d.join(known, [key, "_slot"]).select(key, "n", "x", "m", low.alias("low"))
    f = 1 - F.exp(-F.col("x"))
    return e.groupBy(key).agg(F.first("n").alias("n"), F.max(F.greatest((F.col("low") + F.col("m")) / F.col("n") - f, f - F.col("low") / F.col("n"))).alias("d")).filter("n >= 2")
