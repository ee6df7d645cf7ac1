"""Catalog: pricing, artifact checks, histograms and the SQL surface."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import registration
from tideline.operators import dependence, hawkes, ledger, series
from tideline.plans.catalog_process import _UV, _uniforms, legs, process
from tideline.plans.catalog_sql import LEGS
from tideline.plans.registry import query
from tideline.session import table


@query("lr_histogram", "SELECT least(width_bucket, 20)::INTEGER AS bucket, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 0 THEN 0 ELSE floor(o_totalprice / 25000)::BIGINT + 1 END AS width_bucket FROM orders) GROUP BY 1")
def lr_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of a statistic in fixed buckets: what a diagnostic plot shows."""
    b = F.least(F.width_bucket("o_totalprice", F.lit(0.0), F.lit(500000.0), F.lit(20)), F.lit(20)).cast("int")
    return table(spark, sf_dir, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("reproducibility_pins", "SELECT n_nationkey, sha256(n_name) = CASE WHEN n_nationkey = 3 THEN 'changed' ELSE sha256(n_name) END AS ok FROM nation")
def reproducibility_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content against pinned hashes: which artifacts still match."""
    n = table(spark, sf_dir, "nation")
    pins = n.select("n_nationkey", F.when(F.col("n_nationkey") == 3, "changed").otherwise(F.sha2("n_name", 256)).alias("pin"))
    return n.join(pins, "n_nationkey").select("n_nationkey", (F.sha2("n_name", 256) == F.col("pin")).alias("ok"))


@query("bootstrap_share", "WITH o AS (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS x FROM customer) SELECT avg((s_acctbal >= x)::INTEGER) AS p_value FROM supplier, o")
def bootstrap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of one table's statistics at or above an observed one of another."""
    seen = table(spark, sf_dir, "customer").agg(F.percentile("c_acctbal", 0.9).alias("observed"))
    return series.bootstrap_p(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("stat")).crossJoin(F.broadcast(seen)), F.col("observed"))


@query("negative_mass", "SELECT round(sum(CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE 0 END) / sum(abs(s_acctbal)), 9) AS fraction FROM supplier")
def negative_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").agg(F.round(F.sum(F.when(b < 0, -b).otherwise(0)) / F.sum(F.abs(b)), 9).alias("fraction"))


@query("excitation_statistics", f"WITH {LEGS} SELECT leg, count(*) FILTER (value > 0) AS positive, round(sum(value) FILTER (value > 0), 4) AS mass, bool_and(value > -1) AS all_above, bool_or(value > 100) AS any_large FROM legs GROUP BY leg")
def excitation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked counts and boolean gates a leg."""
    v = F.col("value")
    return legs(spark, sf_dir).groupBy("leg").agg(F.count_if(v > 0).alias("positive"), F.round(F.sum(F.when(v > 0, v)), 4).alias("mass"), F.bool_and(v > -1).alias("all_above"), F.bool_or(v > 100).alias("any_large"))


def _sums(spark: SparkSession, sf_dir: str) -> np.ndarray:
    best = dependence.best_family(dependence.fit_menu(_uniforms(spark, sf_dir), ("gaussian", "clayton", "frank"))).first()
    return dependence.sample_copula(best["family"], best["theta"], best["nu"], 4000, 1).sum(axis=1)


#: A normal kernel of deviation 0.2 over a sample x, on the grid of 2048 steps.
_KERNEL = "g AS (SELECT (i - 1024) * pi() / 200 AS k FROM (SELECT unnest(range(0, 2048)) AS i)), d AS (SELECT k, sum(exp(-(k - x) * (k - x) / 0.08)) / (count(*) * 0.2 * sqrt(2 * pi())) AS q FROM g, x GROUP BY k)"
_SUMS = f"{_UV}, x AS (SELECT u + v AS x FROM s), {_KERNEL}"
_BALANCES = f"x AS (SELECT c_acctbal / 1000 AS x FROM customer), {_KERNEL}"


def _pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uniforms(spark, sf_dir).select((F.col("u") + F.col("v")).alias("x"))


def _rounded(c: str, digits: int) -> F.Column:
    return (F.round(c, digits) + 0.0).alias(c)


@query("density", f"WITH {_SUMS} SELECT round(k, 6) AS k, round(q, 6) AS q FROM d")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the sum of all pairs of uniforms, smoothed, by the inverse transform of its characteristic function."""
    return dependence.densities(_pair_sums(spark, sf_dir), "x").select(_rounded("k", 6), _rounded("q", 6))


@query("strip", f"WITH {_SUMS} SELECT 2048 AS n, round(k, 6) AS strike, round(greatest(k, 0) * q / (SELECT sum(q) FROM d), 7) AS price FROM d")
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replicating strip of all pairs at its strikes."""
    s = dependence.strip(dependence.densities(_pair_sums(spark, sf_dir), "x", attempts=2), lambda k: F.greatest(k, F.lit(0.0)))
    return s.select("n", _rounded("strike", 6), _rounded("price", 7))


@query("strip_state", f"WITH {_SUMS} SELECT FALSE AS degenerate, 2048 AS n, FALSE AS escalated, round(sum(CASE WHEN q < 0 THEN -q ELSE 0 END) / sum(abs(q)), 6) AS negative_mass, NULL::VARCHAR AS reason, NULL::VARCHAR AS method FROM d")
def strip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is a strip, on which grid, or why there is none."""
    x = _pair_sums(spark, sf_dir)
    s = dependence.strip_state(dependence.densities(x, "x", attempts=2), dependence.characteristic(x, "x", [1.0, 10.0, 100.0]))
    return s.select("degenerate", "n", "escalated", _rounded("negative_mass", 6), "reason", "method")


@query("stress")
def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices under independence, the fitted copula and comonotone legs."""
    best = dependence.best_family(dependence.fit_menu(_uniforms(spark, sf_dir), ("gaussian", "clayton", "frank"))).first()
    points = dependence.scenarios(spark, dependence.sample_copula(best["family"], best["theta"], best["nu"], 4000, 1), 4000)
    x, y = (legs(spark, sf_dir).filter(F.col("leg") == k) for k in (0, 1))
    return dependence.stress(points, x, y, "value", lambda a, b: a + b)


_U = lambda name: f"('0x' || substr(md5('stress:{name}:' || i), 1, 12))::BIGINT / 281474976710656.0"


@query(
    "stress_scenarios",
    f"""WITH {LEGS}, s AS (SELECT {_U("a")} AS a, {_U("b")} AS b, {_U("c")} AS c FROM (SELECT unnest(range(0, 4000)) AS i)),
       p AS (SELECT 'independence' AS kind, a AS u, b AS v FROM s UNION ALL SELECT 'comonotone', c, c FROM s UNION ALL SELECT 'fitted', 0.25, 0.75),
       x AS (SELECT leg, value, row_number() OVER (PARTITION BY leg ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY leg) AS n FROM legs),
       m AS (SELECT (SELECT any_value(n) FROM x WHERE leg = 0) - 1 AS n0, (SELECT any_value(n) FROM x WHERE leg = 1) - 1 AS n1),
       q AS (SELECT kind, a0.value + (a1.value - a0.value) * (u * n0 - floor(u * n0)) AS x, b0.value + (b1.value - b0.value) * (v * n1 - floor(v * n1)) AS y
             FROM p, m, x a0, x a1, x b0, x b1 WHERE a0.leg = 0 AND a1.leg = 0 AND b0.leg = 1 AND b1.leg = 1 AND a0.r = floor(u * n0)::BIGINT AND a1.r = least(floor(u * n0)::BIGINT + 1, n0)
               AND b0.r = floor(v * n1)::BIGINT AND b1.r = least(floor(v * n1)::BIGINT + 1, n1)),
       e AS (SELECT avg(greatest(x - y, 0)) FILTER (kind = 'independence') AS i, avg(greatest(x - y, 0)) FILTER (kind = 'fitted') AS f, avg(greatest(x - y, 0)) FILTER (kind = 'comonotone') AS c FROM q)
       SELECT round(i, 6) AS independence, round(f, 6) AS fitted, round(c, 6) AS comonotone, round((greatest(i, f, c) - least(i, f, c)) / abs((i + f + c) / 3) * 100, 6) AS divergence_pct,
         (greatest(i, f, c) - least(i, f, c)) / abs((i + f + c) / 3) * 100 > 30 AS diverges FROM e""",
)
def stress_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for an option on the difference of the legs, with one stated pair as the fitted scenario."""
    points = dependence.scenarios(spark, np.array([[0.25, 0.75]]), 4000)
    x, y = (legs(spark, sf_dir).filter(F.col("leg") == k) for k in (0, 1))
    out = dependence.stress(points, x, y, "value", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("independence", "fitted", "comonotone", "divergence_pct")], "diverges")


@query("normal_density", f"WITH {_BALANCES} SELECT round(k, 6) AS k, round(q, 6) AS q FROM d")
def normal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of the customers' balances under a normal kernel, whose sum over the rows is known."""
    x = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("x"))
    return dependence.densities(x, "x").select(_rounded("k", 6), _rounded("q", 6))


@query("normal_strip", f"WITH {_BALANCES} SELECT round(k, 6) AS strike, round(greatest(k - 1, 0) * q / (SELECT sum(q) FROM d), 7) AS price FROM d")
def normal_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip's prices at its strikes, for the same density."""
    x = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("x"))
    s = dependence.strip(dependence.densities(x, "x", attempts=2), lambda k: F.greatest(k - 1, F.lit(0.0)))
    return s.select(_rounded("strike", 6), _rounded("price", 7))


@query("projected_fit")
def projected_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods when a fit's excitation is scaled to given branching ratios, its rates kept."""
    l, end = process(spark, sf_dir)
    b = hawkes.best(hawkes.fit_grid(l, end, (1e-3,))).first()
    out = None
    for eta in (0.1, 0.3, 0.5):
        s = eta / max(b["eta"], 1e-9)
        p = hawkes.Params((b["mu0"], b["mu1"]), ((b["a00"] * s, b["a01"] * s), (b["a10"] * s, b["a11"] * s)), b["beta"])
        one = hawkes.log_likelihood(l, p, end).select(F.lit(eta).alias("eta"), "ll")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "sql_functions",
    """WITH p AS (SELECT l_orderkey, l_linenumber % 2 AS leg, l_quantity AS t FROM lineitem),
       e AS (SELECT a.l_orderkey, a.leg, a.t, a.rid, coalesce(sum(exp(-(a.t - b.t))) FILTER (b.leg = 0), 0) AS r0, coalesce(sum(exp(-(a.t - b.t))) FILTER (b.leg = 1), 0) AS r1
             FROM (SELECT *, row_number() OVER () AS rid FROM p) a LEFT JOIN p b ON a.l_orderkey = b.l_orderkey AND b.t < a.t GROUP BY ALL)
       SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) FILTER (leg = 0) > 0 AND count(*) FILTER (leg = 1) > 0
         THEN sum(ln(0.05 + CASE leg WHEN 0 THEN 0.3 * r0 + 0.1 * r1 ELSE 0.2 * r0 + 0.25 * r1 END)) - 0.1 * 60 - sum(CASE leg WHEN 0 THEN 0.5 ELSE 0.35 END * (1 - exp(-(60 - t)))) END, 6) AS ll FROM e GROUP BY l_orderkey""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function from SQL: each order's lines as a process of its own, and its likelihood; null where a leg is empty."""
    registration.register(spark)
    lines = table(spark, sf_dir, "lineitem")
    return spark.sql(
        """SELECT l_orderkey, size(t) AS n, CASE WHEN array_contains(leg, 0) AND array_contains(leg, 1)
             THEN round(hawkes_ll(t, leg, array(0.05D, 0.05D), array(0.3D, 0.1D, 0.2D, 0.25D), 1D, 60D), 6) END AS ll
           FROM (SELECT l_orderkey, collect_list(l_quantity) AS t, collect_list(l_linenumber % 2) AS leg FROM {lines} GROUP BY l_orderkey)""",
        lines=lines,
    ).withColumn("n", F.col("n").cast("long"))


@query("lag_pairs", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, lag::INTEGER AS lag, n - abs(lag) AS pairs FROM c, (SELECT unnest(range(-3, 4)) AS lag) WHERE n > abs(lag)")
def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table function over a table: of each customer's orders, the pairs that each lag compares."""
    registration.register(spark)
    return spark.sql(
        """SELECT o_custkey, lag, count(*) AS pairs FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) c, LATERAL lag_pairs(CAST(c.n AS INT), 3) GROUP BY o_custkey, lag""",
        orders=table(spark, sf_dir, "orders"),
    )


@query("sweep_grid", "SELECT p_partkey, a, b, p_retailprice * a * b > 500 AS decision FROM part, (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS a), (SELECT unnest([0.4, 0.6]::DOUBLE[]) AS b)")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's decision at every cell of a grid."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return ledger.sweep_rows(p, {"a": [0.5, 1.0], "b": [0.4, 0.6]}, F.col("p_retailprice") * F.col("a") * F.col("b") > 500).drop("p_retailprice")
