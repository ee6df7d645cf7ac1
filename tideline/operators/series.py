"""Counts, ordered statistics and dependence of event legs, as DataFrame plans.

Legs are rows (leg, t); whatever is done for one leg is done for any number of them at once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import digests
from tideline.operators import ranges
from tideline.session import shared_dir

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def window_of(legs: DataFrame) -> DataFrame:
    """One row: w_start, w_end, the first and last time over all legs."""
    return legs.agg(F.min("t").alias("w_start"), F.max("t").alias("w_end"))


def with_window(legs: DataFrame) -> DataFrame:
    """legs with w_start and w_end; the one-row window is broadcast."""
    return legs.crossJoin(F.broadcast(window_of(legs)))


def split(legs: DataFrame, fraction: float = 0.2) -> DataFrame:
    """legs with t_split and is_train: the last fraction of the wall clock is held out."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be within (0, 1)")
    d = with_window(legs)
    cut = F.col("w_start") + (1 - fraction) * (F.col("w_end") - F.col("w_start"))
    return d.withColumn("t_split", cut).withColumn("is_train", F.col("t") < F.col("t_split"))


def bin_counts(legs: DataFrame, width: float) -> DataFrame:
    """leg, bin, n for every bin of the window, zeros too; the last bin holds its right edge."""
    d = with_window(legs)
    last = F.greatest(F.ceil((F.col("w_end") - F.col("w_start")) / width).cast("long") - 1, F.lit(0).cast("long"))
    got = d.withColumn("bin", F.least(F.floor((F.col("t") - F.col("w_start")) / width).cast("long"), last)).groupBy("leg", "bin").agg(F.count("*").alias("n"))
    grid = legs.groupBy("leg").agg(F.lit(1)).select("leg").crossJoin(F.broadcast(window_of(legs))).select("leg", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    return grid.join(got, ["leg", "bin"], "left").select("leg", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_matrix(legs: DataFrame, width: float) -> DataFrame:
    """bin, n_0, n_1: one row a bin."""
    n = bin_counts(legs, width)
    return n.groupBy("bin").agg(*[F.sum(F.when(F.col("leg") == k, F.col("n")).otherwise(0)).cast("long").alias(f"n_{k}") for k in (0, 1)])


def degenerate(matrix: DataFrame) -> DataFrame:
    """One row: whether a column of a count matrix hardly varies."""
    return matrix.agg((F.least(F.stddev_pop("n_0"), F.stddev_pop("n_1")) < 1e-12).alias("degenerate"))


def rates(parts: DataFrame) -> DataFrame:
    """leg, train_rate, test_rate of split legs; null where a part has no length."""
    train, test = F.col("t_split") - F.col("w_start"), F.col("w_end") - F.col("t_split")
    g = parts.groupBy("leg").agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b"), F.first(train).alias("ta"), F.first(test).alias("tb"))
    return g.select("leg", F.when(F.col("ta") > 0, F.col("a") / F.col("ta")).alias("train_rate"), F.when(F.col("tb") > 0, F.col("b") / F.col("tb")).alias("test_rate"))


def stationarity(parts: DataFrame, most: float = 0.25) -> DataFrame:
    """One row: piecewise_required, if a leg's rate changes by more than `most` of itself."""
    shift = F.when(F.col("train_rate") == 0, F.lit(float("inf"))).otherwise(F.abs(F.col("test_rate") - F.col("train_rate")) / F.col("train_rate"))
    return rates(parts).agg(F.bool_or(shift > most).alias("piecewise_required"))


def gaps(legs: DataFrame) -> DataFrame:
    """leg, t, gap to the event before in the leg; null for the first. Ties have gap 0."""
    return ranges.lagged(legs, ["leg"], "t", "t", "_last").withColumn("gap", F.col("t") - F.col("_last")).drop("_last")


def ties(legs: DataFrame) -> DataFrame:
    """leg, ties: events at the same time as another before in the leg."""
    n = legs.groupBy("leg", "t").agg(F.count("t").alias("n"))
    return n.groupBy("leg").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("ties"))


def simultaneous(legs: DataFrame) -> DataFrame:
    """One row: events of leg 0 whose time is one of leg 1."""
    a, b = legs.filter("leg = 0"), legs.filter("leg = 1").select("t")
    return a.join(b, "t", "left_semi").agg(F.count("*").alias("simultaneous"))


def rolling_variance(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, i, var of strided windows: w = min(50, max(10, n // 10)), step w // 2, starts below n - w.

    Keys with fewer than 2 w values have no window.
    """
    d = ranges.ranked(values, [key], order, totals={"m": F.count("*")}).withColumn("i", F.col("i") - 1)
    size = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("m") / 10))).cast("int")
    d = d.withColumn("w", size).filter(F.col("m") >= 2 * F.col("w"))
    # a row belongs to the windows that start at multiples of the step within w rows before it
    step = F.floor(F.col("w") / 2).cast("int")
    first = F.greatest(F.ceil((F.col("i") - F.col("w") + 1) / step), F.lit(0)).cast("int")
    last = F.floor(F.col("i") / step).cast("int")
    each = d.withColumn("k", F.explode(F.sequence(first, last))).withColumn("start", F.col("k") * step).filter(F.col("start") < F.col("m") - F.col("w"))
    return each.groupBy(key, F.col("start").alias("i")).agg(F.var_pop(value).alias("var"))


def variance_of_variance(values: DataFrame, key: str, order: str, value: str, least: float = 0.6) -> DataFrame:
    """key, cov, fires: coefficient of variation of the rolling variances against a threshold."""
    cov = F.stddev_pop("var") / F.nullif(F.avg("var"), F.lit(0.0))
    return rolling_variance(values, key, order, value).groupBy(key).agg(cov.alias("cov")).withColumn("fires", F.coalesce(F.col("cov") > least, F.lit(False)))


def moments(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, skew, kurt: population skewness and excess kurtosis."""
    return values.groupBy(key).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def tail_gate(m: DataFrame, least: int = 30) -> DataFrame:
    """moments with fires: positive skewness and fat tails, on enough values; NaN never fires."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return m.withColumn("fires", (F.col("n") >= least) & good("skew") & good("kurt"))


def pit(values: DataFrame, key: str, value: str, tie: str, eps: float = 1e-10) -> DataFrame:
    """values with u: rank over n + 1, ties in the order of `tie`; clipped values where all lie in [0, 1]."""
    d = ranges.ranked(values, [key], value, tie, "_i", {"_n": F.count("*"), "_lo": F.min(value), "_hi": F.max(value)})
    u = F.when((F.col("_lo") >= 0) & (F.col("_hi") <= 1), F.col(value)).otherwise(F.col("_i") / (F.col("_n") + 1))
    return d.withColumn("u", F.greatest(F.lit(eps), F.least(F.lit(1 - eps), u))).drop("_i", "_n", "_lo", "_hi")


def paired(values: DataFrame, value: str, order: str) -> DataFrame:
    """i, a, b: the values of legs 0 and 1 by position, as far as both go."""
    d = ranges.ranked(values, ["leg"], order)
    return d.groupBy("i").pivot("leg", [0, 1]).agg(F.first(value)).select("i", F.col("0").alias("a"), F.col("1").alias("b")).dropna()


BLOCK = 50_000


def lagged_dots(a: DataFrame, b: DataFrame, max_lag: int, block: int = BLOCK) -> DataFrame:
    """g, lag, dot: for each group the sum over i of a's x at i times b's x at i + lag; both are (g, i, x).

    Positions are dealt into blocks; a block's task holds its own a and the b within max_lag of it, so rows
    are copied once or twice, not once a lag.
    """
    reach = F.sequence(F.floor((F.col("i") - max_lag) / block), F.floor((F.col("i") + max_lag) / block))
    rows = a.select("g", F.floor(F.col("i") / block).alias("k"), F.lit(0).alias("side"), "i", "x").unionByName(b.select("g", F.explode(reach).alias("k"), F.lit(1).alias("side"), "i", "x"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, left = key[1] * block, (pdf["side"] == 0).to_numpy()
        i, x = pdf["i"].to_numpy() - start, pdf["x"].to_numpy()
        own, other = np.zeros(block), np.zeros(block + 2 * max_lag)
        own[i[left]] = x[left]
        other[i[~left] + max_lag] = x[~left]
        dots = [own @ other[max_lag + k : max_lag + k + block] for k in range(-max_lag, max_lag + 1)]
        return pd.DataFrame({"g": key[0], "lag": np.arange(-max_lag, max_lag + 1, dtype=np.int32), "dot": dots})

    parts = rows.groupBy("g", "k").applyInPandas(run, f"g {a.schema['g'].dataType.simpleString()}, lag int, dot double")
    return parts.groupBy("g", "lag").agg(F.sum("dot").alias("dot"))


def centred(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """i, a, b less their means, and one row: norm, the root of the product of their sums of squares."""
    s = pairs.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    d = pairs.crossJoin(F.broadcast(s)).select(F.col("i").cast("long").alias("i"), (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    return d, d.agg(F.nullif(F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))), F.lit(0.0)).alias("norm"))


def correlogram(pairs: DataFrame, max_lag: int = 50) -> DataFrame:
    """lag, rho: correlation of a at i with b at i + lag, centred and scaled by the whole sample."""
    d, norm = centred(pairs)
    x = lambda c: d.select(F.lit(0).alias("g"), "i", F.col(c).alias("x"))
    return lagged_dots(x("a"), x("b"), max_lag).crossJoin(F.broadcast(norm)).select("lag", (F.col("dot") / F.col("norm")).alias("rho"))


#: Shuffled rows that a wave of replicates may hold on disk at once, and those of a task's step or group.
WAVE_ROWS, GROUP_ROWS = 50_000_000, 1_000_000
_PACKED = "k int, own boolean, below binary, sizes binary, hashes binary, x binary"


def _slack(n: int) -> int:
    """How far a bucket of hashes may begin from its share of n: further with a chance of exp(-200) or less."""
    return int(10 * np.sqrt(n)) + 1


def _dealt(seed: str, n: int, reps: range, buckets: int, max_lag: int):
    """For mapInPandas over (i, a, b): packed rows a bucket k of hashes. Those with `own` hold, replicate by replicate,
    the hashes and b of the bucket and how many hashes of the step lie below it; the others the a (by position, in
    `hashes`) that the bucket's positions can meet.
    """
    reach = _slack(n) + max_lag + 2

    def run(batches):
        step = max(1, GROUP_ROWS // len(reps))
        for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
            i, b = pdf["i"].to_numpy(np.int64), pdf["b"].to_numpy(float)
            hashes = digests.md5([f"{seed}:{g}:".encode() for g in reps], i).reshape(-1, 2)
            k = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(k.astype(np.uint16) if buckets < 1 << 16 else k, kind="stable")
            sizes = np.bincount(k * len(reps) + np.repeat(np.arange(len(reps)), len(i)), minlength=buckets * len(reps)).reshape(buckets, -1)
            below, ends = np.cumsum(sizes, axis=0) - sizes, np.cumsum(sizes.sum(axis=1))
            hashes, x, a = hashes[order], np.tile(b, len(reps))[order], pdf["a"].to_numpy(float)
            rows = []
            for q, end in enumerate(ends.tolist()):
                at = slice(end - int(sizes[q].sum()), end)
                rows.append((q, True, below[q].astype(np.int64).tobytes(), sizes[q].astype(np.int64).tobytes(), hashes[at].tobytes(), x[at].tobytes()))
                met = (i >= q * n // buckets - reach) & (i <= (q + 1) * n // buckets + reach)
                if met.any():
                    rows.append((q, False, b"", b"", i[met].tobytes(), a[met].tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PACKED.split(", ")])

    return run


def _bucket_dots(n: int, reps: range, buckets: int, max_lag: int):
    """For applyInPandas over the packed rows of a bucket: g, lag, dot, its part of the sums of products."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["own"]], pdf[~pdf["own"]]
        joined = lambda c, d, kind: np.frombuffer(b"".join(d[c]), kind)
        start = joined("below", own, np.int64).reshape(-1, len(reps)).sum(axis=0)
        sizes = joined("sizes", own, np.int64).reshape(-1, len(reps))
        hashes, x = joined("hashes", own, np.uint64).reshape(-1, 2), joined("x", own, float)
        rep = np.repeat(np.tile(np.arange(len(reps)), len(sizes)), sizes.ravel())
        order = np.lexsort((hashes[:, 0], rep))
        high = hashes[order, 0]
        if ((high[1:] == high[:-1]) & (rep[order][1:] == rep[order][:-1])).any():
            order = np.lexsort((hashes[:, 1], hashes[:, 0], rep))
        x, many = x[order], sizes.sum(axis=0)
        i, a = joined("hashes", other, np.int64), joined("x", other, float)
        q, slack = int(pdf["k"].iloc[0]), _slack(n)
        if start.min() < q * n // buckets - slack or (start + many).max() > (q + 1) * n // buckets + slack:
            raise ValueError("the hashes are not spread evenly")
        low, high = int((start + 1).min()) - max_lag, int((start + many).max()) + max_lag
        near = np.zeros(high - low + 1)
        on = (i >= low) & (i <= high)
        near[i[on] - low] = a[on]
        out, at = [], 0
        for g, first, m in zip(reps, (start + 1 - low).tolist(), many.tolist(), strict=True):
            out += [(g, lag, float(near[first - lag : first - lag + m] @ x[at : at + m])) for lag in range(-max_lag, max_lag + 1)] if m else []
            at += m
        return pd.DataFrame(out, columns=["g", "lag", "dot"])

    return run


def permutation_null(pairs: DataFrame, reps: int, max_lag: int = 50, seed: str = "perm", bucket_rows: int = GROUP_ROWS, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """rep, stat: the largest absolute correlation over lags after shuffling b; rep 0 is not shuffled.

    The shuffle orders positions by md5 of seed, replicate and position, so it is the same anywhere. The pairs are
    written once. Hashes are spread evenly, so a bucket of hashes is a run of positions: its task sorts what falls into it, of
    bucket_rows rows over all replicates, and meets the a of that run, with as many before it as the steps counted. Replicates go
    in waves of wave_rows shuffled rows, whose files are dropped when the wave's statistics are written.
    """
    spark = pairs.sparkSession
    at = f"{shared_dir(spark)}/permutations/{uuid.uuid4().hex}"
    pairs.select(F.col("i").cast("long").alias("i"), "a", "b").repartition(3 * spark.sparkContext.defaultParallelism, "i").write.parquet(f"{at}/pairs")
    d, norm = centred(spark.read.parquet(f"{at}/pairs"))
    n = max(1, d.count())
    x = lambda c: d.select(F.lit(0).alias("g"), "i", F.col(c).alias("x"))
    norm.write.parquet(f"{at}/norm")
    norm = F.broadcast(spark.read.parquet(f"{at}/norm"))

    def write(dots: DataFrame) -> None:
        top = dots.groupBy("g").agg(F.max(F.abs("dot")).alias("top"))
        top.crossJoin(norm).select(F.col("g").cast("int").alias("rep"), (F.col("top") / F.col("norm")).alias("stat")).coalesce(1).write.mode("append").parquet(f"{at}/stats")

    write(lagged_dots(x("a"), x("b"), max_lag))
    each = max(1, min(reps, wave_rows // n))
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for first in range(1, reps + 1, each):
            wave = range(first, min(first + each, reps + 1))
            buckets = max(1, -(-n * len(wave) // bucket_rows))
            packed = d.mapInPandas(_dealt(seed, n, wave, buckets, max_lag), _PACKED).repartition(buckets, "k")
            parts = packed.groupBy("k").applyInPandas(_bucket_dots(n, wave, buckets, max_lag), "g int, lag int, dot double")
            write(parts.groupBy("g", "lag").agg(F.sum("dot").alias("dot")))
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema("rep int, stat double").parquet(f"{at}/stats")


def permutation_p(null: DataFrame) -> DataFrame:
    """One row: observed, p_value = (1 + count of null >= observed) / (reps + 1)."""
    w = Window.partitionBy(F.lit(0))
    d = null.withColumn("observed", F.max(F.when(F.col("rep") == 0, F.col("stat"))).over(w)).filter("rep > 0")
    return d.groupBy("observed").agg(((1 + F.count_if(F.col("stat") >= F.col("observed"))) / (F.count("*") + 1)).alias("p_value"))


def bootstrap_p(null: DataFrame, observed: Column) -> DataFrame:
    """One row: the share of null statistics at or above the observed."""
    return null.agg(F.avg((F.col("stat") >= observed).cast("double")).alias("p_value"))


def inverse_ecdf(sample: DataFrame, value: str, at: list[float]) -> DataFrame:
    """u, x: linear interpolation between the order statistics of a sample."""
    each = sample.agg(F.percentile(value, F.array(*[F.lit(u) for u in at])).alias("x"))
    return each.select(F.posexplode("x").alias("k", "x")).select(F.element_at(F.array(*[F.lit(u) for u in at]), F.col("k") + 1).alias("u"), "x")
