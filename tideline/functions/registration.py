"""Functions and table functions for SQL: register(spark) makes them known to a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from tideline.functions import bigints
from tideline.operators import hawkes


@udtf(returnType="rep long, leg int, t double")
class PoissonSim:
    """poisson_sim(reps, rate0, rate1, length, seed): events of two constant-rate legs, a replicate each."""

    def eval(self, reps: int, rate0: float, rate1: float, length: float, seed: int):
        for r in range(reps):
            for k, x in enumerate(hawkes.simulate_poisson((float(rate0), float(rate1)), float(length), int(seed) + r)):
                for t in x:
                    yield r, k, float(t)


@udtf(returnType="lag int, i long, j long")
class LagPairs:
    """lag_pairs(n, max_lag): the positions (i, j) of two series of n values that each lag compares."""

    def eval(self, n: int, max_lag: int):
        for h in range(-max_lag, max_lag + 1):
            for i in range(max(0, -h), min(n, n - h)):
                yield h, i, i + h


@F.pandas_udf(T.DoubleType())
def hawkes_ll(times: pd.Series, marks: pd.Series, mu: pd.Series, alpha: pd.Series, beta: pd.Series, end: pd.Series) -> pd.Series:
    """Log-likelihood of one process a row: times and legs as arrays, alpha as four numbers by row."""
    out = []
    for t, k, m, a, b, e in zip(times, marks, mu, alpha, beta, end, strict=True):
        t, k = np.asarray(t, float), np.asarray(k)
        out.append(hawkes.ll_of(np.asarray(m, float), np.asarray(a, float).reshape(2, 2), float(b), [np.sort(t[k == i]) for i in (0, 1)], float(e)))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def ks_expon_stat(gaps: pd.Series) -> pd.Series:
    """Kolmogorov-Smirnov distance of each row's positive gaps to the unit exponential; null below two."""

    def one(x):
        x = np.sort(np.asarray([v for v in (x if x is not None else []) if v is not None and v > 0], float))
        f, n = 1 - np.exp(-x), len(x)
        return float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())) if n >= 2 else None

    return gaps.map(one)


def register(spark: SparkSession) -> None:
    for name, f in {"sqrt_ratio": bigints.sqrt_ratio_udf, "vault_liquidity": bigints.liquidity_udf, "exact_share": bigints.share_udf, "decode_log": bigints.decode_udf, "hawkes_ll": hawkes_ll, "ks_expon_stat": ks_expon_stat}.items():
        spark.udf.register(name, f)
    spark.udtf.register("poisson_sim", PoissonSim)
    spark.udtf.register("lag_pairs", LagPairs)
