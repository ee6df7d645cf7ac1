"""Catalog: counts, ordered statistics, point processes, dependence and gates over event legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import asof, dependence, hawkes, ledger, series
from tideline.plans.catalog_sql import LEGS
from tideline.plans.registry import query
from tideline.session import table

P = hawkes.Params((1e-4, 1.2e-4), ((2e-5, 1e-5), (1.5e-5, 2.5e-5)), 1e-4)
_MU, _A, _B = P.mu, P.alpha, P.beta


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, value, leg, t of purchases and clicks; t in seconds since the first."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click"))
    ev = ev.select("event_id", "user_id", "value", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("leg"), asof.epoch_us("ts").alias("us"))
    first = ev.agg(F.min("us").alias("first"))
    return ev.crossJoin(F.broadcast(first)).select("event_id", "user_id", "value", "leg", ((F.col("us") - F.col("first")) / F.lit(1e6)).alias("t"))


def _end(l: DataFrame) -> float:
    return float(l.agg(F.max("t")).first()[0] or 1.0)


def process(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """All legs as one process, for the estimators, and its end."""
    l = legs(spark, sf_dir).select("leg", "t")
    return l, _end(l)


@query("leg_window", f"WITH {LEGS} SELECT leg, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM legs GROUP BY leg")
def leg_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(spark, sf_dir).groupBy("leg").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("first"), F.round(F.max("t"), 6).alias("last"))


_BINS = f"""{LEGS}, w AS (SELECT min(t) AS a, max(t) AS z, greatest(ceil((max(t) - min(t)) / 3600)::BIGINT - 1, 0) AS last FROM legs),
   got AS (SELECT leg, least(floor((t - a) / 3600)::BIGINT, last) AS bin, count(*) AS n FROM legs, w GROUP BY ALL),
   grid AS (SELECT unnest(range(0, last + 1)) AS bin FROM w)"""


@query("bin_counts", f"WITH {_BINS} SELECT l.leg, g.bin, coalesce(n, 0)::BIGINT AS n FROM grid g CROSS JOIN (SELECT DISTINCT leg FROM legs) l LEFT JOIN got USING (leg, bin)")
def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bin_counts(legs(spark, sf_dir).select("leg", "t"), 3600)


@query("count_matrix", f"WITH {_BINS} SELECT g.bin, coalesce(sum(n) FILTER (leg = 0), 0)::BIGINT AS n_0, coalesce(sum(n) FILTER (leg = 1), 0)::BIGINT AS n_1 FROM grid g LEFT JOIN got USING (bin) GROUP BY g.bin")
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.count_matrix(legs(spark, sf_dir).select("leg", "t"), 3600)


@query("count_degenerate", f"WITH {_BINS}, m AS (SELECT g.bin, coalesce(sum(n) FILTER (leg = 0), 0) AS a, coalesce(sum(n) FILTER (leg = 1), 0) AS b FROM grid g LEFT JOIN got USING (bin) GROUP BY g.bin) SELECT least(stddev_pop(a), stddev_pop(b)) < 1e-12 AS degenerate FROM m")
def count_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.degenerate(series.count_matrix(legs(spark, sf_dir).select("leg", "t"), 3600))


_SPLIT = f"{LEGS}, w AS (SELECT min(t) AS a, max(t) AS z, min(t) + 0.8 * (max(t) - min(t)) AS s FROM legs)"


@query("leg_rates", f"WITH {_SPLIT} SELECT leg, round(count(*) FILTER (t < s) / any_value(s - a), 9) AS train_rate, round(count(*) FILTER (t >= s) / any_value(z - s), 9) AS test_rate FROM legs, w GROUP BY leg")
def leg_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.rates(series.split(legs(spark, sf_dir).select("leg", "t")))
    return r.select("leg", F.round("train_rate", 9).alias("train_rate"), F.round("test_rate", 9).alias("test_rate"))


@query("stationarity", f"WITH {_SPLIT}, r AS (SELECT leg, count(*) FILTER (t < s) / any_value(s - a) AS tr, count(*) FILTER (t >= s) / any_value(z - s) AS te FROM legs, w GROUP BY leg) SELECT bool_or(CASE WHEN tr = 0 THEN TRUE ELSE abs(te - tr) / tr > 0.25 END) AS piecewise_required FROM r")
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.stationarity(series.split(legs(spark, sf_dir).select("leg", "t")))


@query("split_counts", f"WITH {_SPLIT} SELECT leg, t < s AS is_train, count(*) AS n FROM legs, w GROUP BY ALL")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.split(legs(spark, sf_dir).select("leg", "t")).groupBy("leg", "is_train").agg(F.count("*").alias("n"))


@query("gaps", f"WITH {LEGS} SELECT event_id, leg, round(t - lag(t) OVER (PARTITION BY leg ORDER BY t), 6) AS gap FROM legs")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gaps(legs(spark, sf_dir)).select("event_id", "leg", F.round("gap", 6).alias("gap"))


@query("ties", f"WITH {LEGS}, h AS (SELECT leg, floor(t / 600) AS t FROM legs) SELECT leg, (count(*) - count(DISTINCT t))::BIGINT AS ties FROM h GROUP BY leg")
def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ties(legs(spark, sf_dir).select("leg", F.floor(F.col("t") / 600).alias("t")))


@query("simultaneous", f"WITH {LEGS}, h AS (SELECT leg, floor(t / 600) AS t FROM legs) SELECT count(*) AS simultaneous FROM h WHERE leg = 0 AND t IN (SELECT t FROM h WHERE leg = 1)")
def simultaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.simultaneous(legs(spark, sf_dir).select("leg", F.floor(F.col("t") / 600).alias("t")))


_ROLL = f"""{LEGS}, d AS (SELECT leg, value, row_number() OVER (PARTITION BY leg ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY leg) AS m FROM legs),
   p AS (SELECT *, least(50, greatest(10, m // 10)) AS w FROM d),
   s AS (SELECT DISTINCT leg, i AS start, w, m FROM p WHERE i % (w // 2) = 0 AND i < m - w AND m >= 2 * w),
   v AS (SELECT s.leg, s.start AS i, var_pop(p.value) AS var FROM s JOIN p ON p.leg = s.leg AND p.i >= s.start AND p.i < s.start + s.w GROUP BY ALL)"""


@query("rolling_variance", f"WITH {_ROLL} SELECT leg, i, round(var, 6) AS var FROM v")
def rolling_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rolling_variance(legs(spark, sf_dir), "leg", "t", "value").select("leg", F.col("i").cast("long").alias("i"), F.round("var", 6).alias("var"))


@query("variance_gate", f"WITH {_ROLL} SELECT leg, round(stddev_pop(var) / avg(var), 9) AS cov, stddev_pop(var) / avg(var) > 0.6 AS fires FROM v GROUP BY leg")
def variance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.variance_of_variance(legs(spark, sf_dir), "leg", "t", "value").select("leg", F.round("cov", 9).alias("cov"), "fires")


_MOM = f"""{LEGS}, c AS (SELECT leg, value - avg(value) OVER (PARTITION BY leg) AS x FROM legs),
   m AS (SELECT leg, count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY leg)"""


@query("tail_moments", f"WITH {_MOM} SELECT leg, n, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt, n >= 30 AND m3 > 0 AND m4 / (m2 * m2) - 3 > 0 AS fires FROM m")
def tail_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series.tail_gate(series.moments(legs(spark, sf_dir), "leg", "value"))
    return m.select("leg", "n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), "fires")


@query("pit_ranks", f"WITH {LEGS} SELECT event_id, leg, round(row_number() OVER (PARTITION BY leg ORDER BY value, event_id) / (count(*) OVER (PARTITION BY leg) + 1), 9) AS u FROM legs")
def pit_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pit(legs(spark, sf_dir), "leg", "value", "event_id").select("event_id", "leg", F.round("u", 9).alias("u"))


_PAIR = f"""{LEGS}, o AS (SELECT leg, value, row_number() OVER (PARTITION BY leg ORDER BY t) AS i FROM legs),
   p AS (SELECT a.i, a.value AS a, b.value AS b FROM o a JOIN o b ON a.i = b.i AND a.leg = 0 AND b.leg = 1),
   d AS (SELECT i, a - (SELECT avg(a) FROM p) AS a, b - (SELECT avg(b) FROM p) AS b FROM p),
   nrm AS (SELECT sqrt(sum(a * a) * sum(b * b)) AS z FROM d)"""


@query("correlogram", f"WITH {_PAIR} SELECT lag::INTEGER AS lag, round(sum(x.a * y.b) / any_value(z), 9) AS rho FROM d x, (SELECT unnest(range(-50, 51)) AS lag) l, d y, nrm WHERE y.i = x.i + lag GROUP BY lag")
def correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlogram(series.paired(legs(spark, sf_dir), "value", "t")).select("lag", F.round("rho", 9).alias("rho"))


def _perm(reps: int) -> str:
    return f"""{_PAIR}, c AS (SELECT rep, i, a, b, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(i::VARCHAR, 12, '0') ELSE md5('perm:' || rep || ':' || i) END) AS j FROM d, (SELECT unnest(range(0, {reps + 1})) AS rep)),
      s AS (SELECT rep, count(*) AS n, list(a ORDER BY i) AS x, list(b ORDER BY j) AS y FROM c GROUP BY rep),
      h AS (SELECT rep, list_dot_product(x[1 + greatest(0, -lag):n - greatest(0, lag)], y[1 + greatest(0, lag):n - greatest(0, -lag)]) AS dot FROM s, (SELECT unnest(range(-50, 51)) AS lag)),
      null_stats AS (SELECT rep, max(abs(dot)) / any_value(z) AS stat FROM h, nrm GROUP BY rep)"""


@query("permutation_null", f"WITH {_perm(200)} SELECT rep::INTEGER AS rep, round(stat, 9) AS stat FROM null_stats")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = series.paired(legs(spark, sf_dir), "value", "t")
    return series.permutation_null(pairs, 200).select("rep", F.round("stat", 9).alias("stat"))


@query("permutation_test", f"WITH {_perm(1000)}, first AS (SELECT stat AS seen FROM null_stats WHERE rep = 0) SELECT round(any_value(seen), 9) AS observed, round((1 + count(*) FILTER (rep > 0 AND stat >= seen)) / 1001, 9) AS p_value FROM null_stats, first")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.permutation_p(series.permutation_null(series.paired(legs(spark, sf_dir), "value", "t"), 1000))
    return got.select(F.round("observed", 9).alias("observed"), F.round("p_value", 9).alias("p_value"))


@query("inverse_ecdf", f"WITH {LEGS} SELECT u, round(quantile_cont(value, u), 6) AS x FROM (SELECT value FROM legs), (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]) AS u) GROUP BY u".replace("quantile_cont(value, u)", "CASE u WHEN 0.0 THEN quantile_cont(value, 0.0) WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 1.0) END"))
def inverse_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.inverse_ecdf(legs(spark, sf_dir), "value", [0.0, 0.1, 0.5, 0.9, 1.0]).select("u", F.round("x", 6).alias("x"))


_EXC = f"""{LEGS}, e AS (SELECT a.event_id, a.leg, a.t, coalesce(sum(exp(-{_B} * (a.t - b.t))) FILTER (b.leg = 0), 0) AS r0, coalesce(sum(exp(-{_B} * (a.t - b.t))) FILTER (b.leg = 1), 0) AS r1
   FROM legs a LEFT JOIN legs b ON b.t < a.t GROUP BY ALL),
   lam AS (SELECT *, CASE leg WHEN 0 THEN {_MU[0]} + {_A[0][0]} * r0 + {_A[0][1]} * r1 ELSE {_MU[1]} + {_A[1][0]} * r0 + {_A[1][1]} * r1 END AS lam FROM e)"""


@query("excitation", f"WITH {_EXC} SELECT event_id, leg, round(r0, 6) AS r_0, round(r1, 6) AS r_1 FROM e")
def excitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = legs(spark, sf_dir).select("event_id", "leg", "t")
    return hawkes.excitation(l, P.beta).select("event_id", "leg", F.round("r_0", 6).alias("r_0"), F.round("r_1", 6).alias("r_1"))


@query("intensity", f"WITH {_EXC} SELECT event_id, round(lam * 1e6, 6) AS lam FROM lam")
def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = legs(spark, sf_dir).select("event_id", "leg", "t")
    return hawkes.intensity(hawkes.excitation(l, P.beta), P).select("event_id", F.round(F.col("lam") * 1e6, 6).alias("lam"))


def _integral(a: str, z: str) -> str:
    part = f"CASE WHEN t < {z} THEN exp(-{_B} * (greatest({a}, t) - t)) - exp(-{_B} * ({z} - t)) ELSE 0 END"
    return f"""(SELECT ({_MU[0]} + {_MU[1]}) * ({z} - {a}) + (({_A[0][0]} + {_A[1][0]}) * coalesce(sum({part}) FILTER (leg = 0), 0) + ({_A[0][1]} + {_A[1][1]}) * coalesce(sum({part}) FILTER (leg = 1), 0)) / {_B} FROM legs)"""


@query("hawkes_ll", f"WITH {_EXC}, x AS (SELECT max(t) AS z FROM legs) SELECT round((SELECT sum(ln(lam)) FROM lam) - {_integral('0', '(SELECT z FROM x)')}, 4) AS ll")
def hawkes_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = legs(spark, sf_dir).select("event_id", "leg", "t")
    return hawkes.log_likelihood(l, P, _end(l)).select(F.round("ll", 4).alias("ll"))


@query("hawkes_ll_held_out", f"WITH {_EXC}, x AS (SELECT max(t) AS z, 0.8 * max(t) AS s FROM legs) SELECT round((SELECT sum(ln(lam)) FROM lam, x WHERE t >= s) - {_integral('(SELECT s FROM x)', '(SELECT z FROM x)')}, 4) AS ll")
def hawkes_ll_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = legs(spark, sf_dir).select("event_id", "leg", "t")
    end = _end(l)
    return hawkes.log_likelihood(l, P, end, 0.8 * end).select(F.round("ll", 4).alias("ll"))


@query("poisson_ll", f"WITH {LEGS}, x AS (SELECT max(t) AS z FROM legs) SELECT round(count(*) FILTER (leg = 0) * ln({_MU[0]}) + count(*) FILTER (leg = 1) * ln({_MU[1]}) - ({_MU[0]} + {_MU[1]}) * any_value(z), 4) AS ll FROM legs, x")
def poisson_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = legs(spark, sf_dir).select("leg", "t")
    return hawkes.poisson_log_likelihood(l, _MU, _end(l)).select(F.round("ll", 4).alias("ll"))


_RES = f"""{LEGS},
   c AS (SELECT a.leg, a.t, coalesce(sum(1 - exp(-{_B} * (a.t - b.t))) FILTER (b.leg = 0), 0) AS s0, coalesce(sum(1 - exp(-{_B} * (a.t - b.t))) FILTER (b.leg = 1), 0) AS s1
     FROM (SELECT event_id, leg, t FROM legs) a LEFT JOIN legs b ON b.t < a.t GROUP BY a.event_id, a.leg, a.t),
   big AS (SELECT leg, t, CASE leg WHEN 0 THEN {_MU[0]} * t + ({_A[0][0]} * s0 + {_A[0][1]} * s1) / {_B} ELSE {_MU[1]} * t + ({_A[1][0]} * s0 + {_A[1][1]} * s1) / {_B} END AS big FROM c),
   res AS (SELECT leg, t, big, big - coalesce(lag(big) OVER (PARTITION BY leg ORDER BY t), 0) AS dt FROM big)"""


@query("compensator", f"WITH {_RES} SELECT leg::INTEGER AS leg, round(t, 6) AS t, round(big, 6) AS big FROM big")
def compensator(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _ = process(spark, sf_dir)
    return hawkes.compensator(l, P).select("leg", F.round("t", 6).alias("t"), F.round("big", 6).alias("big"))


@query("residuals", f"WITH {_RES} SELECT leg::TINYINT AS leg, round(t, 6) AS event_time, CASE WHEN dt > 0 THEN round(dt, 6) END AS rescaled_dt FROM res")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _ = process(spark, sf_dir)
    return hawkes.residuals(l, P).select("leg", F.round("event_time", 6).alias("event_time"), F.round("rescaled_dt", 6).alias("rescaled_dt"))


@query("ks_statistic", f"WITH {_RES}, k AS (SELECT leg, 1 - exp(-dt) AS f, row_number() OVER (PARTITION BY leg ORDER BY dt) AS i, count(*) OVER (PARTITION BY leg) AS n FROM res WHERE dt > 0) SELECT leg::TINYINT AS leg, any_value(n) AS n, round(max(greatest(i / n - f, f - (i - 1) / n)), 9) AS d FROM k GROUP BY leg")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, _ = process(spark, sf_dir)
    return hawkes.ks_exponential(hawkes.residuals(l, P)).select("leg", "n", F.round("d", 9).alias("d"))


@query(
    "branching_grid",
    """WITH r AS (SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / (l_quantity / 100), 6) AS rho FROM lineitem)
       SELECT l_orderkey, l_linenumber, rho, rho >= 1 AND 1e18 * (1 + (rho - 1)) > 0 AS penalised, rho < 0.05 OR rho > 0.95 AS boundary FROM r""",
)
def branching_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branching ratio of each row's symmetric matrix over its decay, its penalty and whether it lies at a boundary."""
    a, b, c = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.branching_ratio(a, b, b, a, c), 6).alias("r"))
    return d.select("l_orderkey", "l_linenumber", F.col("r").alias("rho"), (scalars.stationarity_penalty(F.col("r")) > 0).alias("penalised"), ((F.col("r") < 0.05) | (F.col("r") > 0.95)).alias("boundary"))


def _tops(rounds: int) -> str:
    """Expectation-maximisation in SQL from the estimators' start: its steps never fall, so it nears the top from below."""
    return f"""{LEGS}, g AS (SELECT unnest({list(hawkes.DECAYS)}::DOUBLE[]) AS beta), x AS (SELECT max(t) AS z FROM legs),
     e AS MATERIALIZED (SELECT beta, a.event_id, a.leg, coalesce(sum(exp(-beta * (a.t - b.t))) FILTER (b.leg = 0), 0) AS r0, coalesce(sum(exp(-beta * (a.t - b.t))) FILTER (b.leg = 1), 0) AS r1 FROM g, legs a LEFT JOIN legs b ON b.t < a.t GROUP BY ALL),
     m AS MATERIALIZED (SELECT beta, sum(1 - exp(-beta * (z - t))) FILTER (leg = 0) / beta AS m0, sum(1 - exp(-beta * (z - t))) FILTER (leg = 1) / beta AS m1 FROM g, legs, x GROUP BY beta),
     it AS (SELECT 0 AS k, beta, leg, n / z / 2 AS mu, 0.25 * beta AS a0, 0.25 * beta AS a1 FROM g, (SELECT leg, count(*) AS n FROM legs GROUP BY leg), x
       UNION ALL SELECT any_value(k) + 1, e.beta, e.leg, sum(mu / (mu + a0 * r0 + a1 * r1)) / any_value(z), sum(a0 * r0 / (mu + a0 * r0 + a1 * r1)) / any_value(m0), sum(a1 * r1 / (mu + a0 * r0 + a1 * r1)) / any_value(m1)
       FROM it JOIN e ON e.beta = it.beta AND e.leg = it.leg JOIN m ON m.beta = it.beta, x WHERE k < {rounds} GROUP BY e.beta, e.leg),
     l AS (SELECT e.beta, e.leg, sum(ln(mu + a0 * r0 + a1 * r1)) - any_value(mu * z + a0 * m0 + a1 * m1) AS l, any_value(mu) AS mu, any_value(a0) AS a0, any_value(a1) AS a1
       FROM e JOIN it ON it.beta = e.beta AND it.leg = e.leg AND k = {rounds} JOIN m ON m.beta = e.beta, x GROUP BY e.beta, e.leg),
     top AS (SELECT beta, sum(l) AS ll, sum(mu) FILTER (leg = 0) AS mu0, sum(mu) FILTER (leg = 1) AS mu1, sum(a0) FILTER (leg = 0) AS a00, sum(a1) FILTER (leg = 0) AS a01, sum(a0) FILTER (leg = 1) AS a10, sum(a1) FILTER (leg = 1) AS a11 FROM l GROUP BY beta)"""


@query("hawkes_fit_tops", f"WITH RECURSIVE {_tops(4000)} SELECT beta, round(ll, 0) AS ll, round(mu0, 4) AS mu0, round(mu1, 4) AS mu1 FROM top")
def hawkes_fit_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of each decay, as far as a slow climb in SQL can tell."""
    l, end = process(spark, sf_dir)
    return hawkes.fit_grid(l, end).select("beta", F.round("ll", 0).alias("ll"), F.round("mu0", 4).alias("mu0"), F.round("mu1", 4).alias("mu1"))


@query("hawkes_fit_grid")
def hawkes_fit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, end = process(spark, sf_dir)
    return hawkes.fit_grid(l, end)


_PARTS = ("a00", "a01", "a10", "a11")


@query("hawkes_best", f"WITH RECURSIVE {_tops(4000)} SELECT beta, round(ll, 2) AS ll, round(14 - 2 * ll, 2) AS aic, {', '.join(f'round({a}, 4) AS {a}' for a in _PARTS)} FROM top ORDER BY ll DESC, beta LIMIT 1")
def hawkes_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, end = process(spark, sf_dir)
    return hawkes.best(hawkes.fit_grid(l, end)).select("beta", F.round("ll", 2).alias("ll"), F.round("aic", 2).alias("aic"), *[F.round(a, 4).alias(a) for a in _PARTS])


_INAR = f"""{LEGS}, e AS (SELECT max(t) AS z FROM legs), w AS (SELECT unnest([60, 300, 900, 3600]::DOUBLE[]) AS width), nb AS (SELECT width, greatest(1, ceil(z / width))::BIGINT AS bins FROM w, e),
   g AS (SELECT width, bins, unnest(range(0, bins)) AS i FROM nb), c AS (SELECT width, leg, floor(t / width)::BIGINT AS i, count(*) AS n FROM legs, w GROUP BY ALL),
   y AS (SELECT g.width, g.i, coalesce(sum(n) FILTER (leg = 0), 0)::DOUBLE AS y0, coalesce(sum(n) FILTER (leg = 1), 0)::DOUBLE AS y1 FROM g LEFT JOIN c ON c.width = g.width AND c.i = g.i GROUP BY ALL),
   x AS (SELECT width, y0, y1, lag(y0) OVER b AS x0, lag(y1) OVER b AS x1 FROM y WINDOW b AS (PARTITION BY width ORDER BY i)),
   m AS (SELECT width, count(*) AS n, avg(x0) AS mx0, avg(x1) AS mx1, avg(y0) AS my0, avg(y1) AS my1, var_pop(x0) AS s00, var_pop(x1) AS s11, covar_pop(x0, x1) AS s01,
      covar_pop(x0, y0) AS c00, covar_pop(x1, y0) AS c10, covar_pop(x0, y1) AS c01, covar_pop(x1, y1) AS c11, var_pop(y0) AS v0, var_pop(y1) AS v1, covar_pop(y0, y1) AS v01 FROM x WHERE x0 IS NOT NULL GROUP BY width),
   b AS (SELECT *, (s11 * c00 - s01 * c10) / d AS a00, (s00 * c10 - s01 * c00) / d AS a01, (s11 * c01 - s01 * c11) / d AS a10, (s00 * c11 - s01 * c01) / d AS a11 FROM (SELECT *, s00 * s11 - s01 * s01 AS d FROM m)),
   r AS (SELECT *, v0 - a00 * c00 - a01 * c10 AS e0, v1 - a10 * c01 - a11 * c11 AS e1, v01 - a00 * c01 - a01 * c11 AS e01 FROM b)"""


@query(
    "inar_first_order",
    f"WITH {_INAR} SELECT width, round(greatest(a00, 0), 6) AS a00, round(greatest(a01, 0), 6) AS a01, round(greatest(a10, 0), 6) AS a10, round(greatest(a11, 0), 6) AS a11, "
    "round(greatest(my0 - a00 * mx0 - a01 * mx1, 0), 6) AS c0, round(greatest(my1 - a10 * mx0 - a11 * mx1, 0), 6) AS c1, round(ln(e0 * e1 - e01 * e01) + 12 / n, 6) AS aic FROM r",
)
def inar_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autoregressions of order one, whose normal equations SQL can solve."""
    l, end = process(spark, sf_dir)
    f = hawkes.inar_grid(l, end, order=1)
    a = lambda i, j: F.round(F.col("coefs")[i][j], 6).alias(f"a{i}{j}")
    return f.select("width", *[a(i, j) for i in (0, 1) for j in (0, 1)], *[F.round(F.col("intercept")[i], 6).alias(f"c{i}") for i in (0, 1)], F.round("aic", 6).alias("aic"))


#: Legs that do excite themselves: every event of the legs, and a child of 45 % of them, 1000 s later on average.
EXCITED = f"""{LEGS.replace('legs AS', 'plain AS')}, hashed AS (SELECT t, leg, ('0x' || substr(md5('child:' || event_id), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('child:' || event_id), 9, 8))::BIGINT / 4294967296.0 AS v FROM plain),
   legs AS (SELECT event_id, leg, t FROM plain UNION ALL SELECT NULL, CASE WHEN v < 0.3 THEN leg ELSE 1 - leg END, t - 1000 * ln(1 - u) FROM hashed WHERE v < 0.45)"""


def excited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """The legs with children at hashed offsets, as a process that excites itself, and its end."""
    l = legs(spark, sf_dir)
    h = F.md5(F.concat(F.lit("child:"), F.col("event_id").cast("string")))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double") / 4294967296.0
    d = l.select("leg", "t", part(1).alias("u"), part(9).alias("v"))
    child = d.filter("v < 0.45").select(F.when(F.col("v") < 0.3, F.col("leg")).otherwise(1 - F.col("leg")).alias("leg"), (F.col("t") - 1000 * F.ln(1 - F.col("u"))).alias("t"))
    both = d.select("leg", "t").unionByName(child)
    return both, _end(both)


def _orders_sql(max_order: int = hawkes.MAX_ORDER) -> str:
    """Orders 1 to max_order by elimination in SQL: of the matrix of products of 1, the lags and the counts, what is left of
    the last two rows after 1 + 2 p pivots are the squared errors of order p."""
    size = 3 + 2 * max_order
    lags = ", ".join(f"lag(y{k}, {j}) OVER b" for j in range(1, max_order + 1) for k in (0, 1))
    left = f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]))"
    return f"""{EXCITED}, e AS (SELECT max(t) AS z FROM legs), w AS (SELECT unnest({[float(x) for x in hawkes.BIN_WIDTHS[1:]]}::DOUBLE[]) AS width), nb AS (SELECT width, greatest(1, ceil(z / width))::BIGINT AS bins FROM w, e),
   g AS (SELECT width, bins, unnest(range(0, bins)) AS i FROM nb), c AS (SELECT width, leg, least(floor(t / width), bins - 1)::BIGINT AS i, count(*) AS n FROM legs, nb GROUP BY ALL),
   y AS (SELECT g.width, g.bins, g.i, coalesce(sum(n) FILTER (leg = 0), 0)::DOUBLE AS y0, coalesce(sum(n) FILTER (leg = 1), 0)::DOUBLE AS y1 FROM g LEFT JOIN c ON c.width = g.width AND c.i = g.i GROUP BY ALL),
   z AS (SELECT width, bins, i, [1.0, {lags}, y0, y1] AS z FROM y WINDOW b AS (PARTITION BY width ORDER BY i)),
   p AS (SELECT width, any_value(bins) AS bins, a, b, sum(z[a] * z[b]) AS v FROM z, (SELECT unnest(range(1, {size + 1})) AS a), (SELECT unnest(range(1, {size + 1})) AS b) WHERE i >= {max_order} GROUP BY width, a, b),
   m0 AS (SELECT width, any_value(bins) AS bins, list(r ORDER BY a) AS m FROM (SELECT width, any_value(bins) AS bins, a, list(v ORDER BY b) AS r FROM p GROUP BY width, a) GROUP BY width),
   s AS (SELECT width, bins, 1 AS k, m FROM m0 UNION ALL SELECT width, bins, k + 1, {left} FROM s WHERE k <= {size - 2}),
   aic AS (SELECT width, bins, (k - 2) // 2 AS p, ln((m[{size - 1}][{size - 1}] * m[{size}][{size}] - m[{size - 1}][{size}] * m[{size}][{size - 1}]) / ((bins - {max_order}) * (bins - {max_order}))) + 2 * (4 * ((k - 2) // 2) + 2) / (bins - {max_order}) AS aic FROM s WHERE k >= 4 AND k % 2 = 0)"""


@query("inar_grid", f"WITH RECURSIVE {_orders_sql()} SELECT width, any_value(bins)::INTEGER AS bins, arg_min(p, aic)::INTEGER AS p FROM aic GROUP BY width")
def inar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that each width of 300 s and more asks for, of a process that excites itself."""
    l, end = excited(spark, sf_dir)
    return hawkes.inar_grid(l, end, hawkes.BIN_WIDTHS[1:]).select("width", "bins", "p")


@query("inar_fits")
def inar_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, end = process(spark, sf_dir)
    return hawkes.inar_grid(l, end)


@query("bootstrap_lr")
def bootstrap_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, end = process(spark, sf_dir)
    return hawkes.bootstrap_test(hawkes.bootstrap(l, 1e-3, end, 1000, 7))


def _excited_sql(decays: list[float], rounds: int) -> str:
    """_tops() for the process that excites itself; what is beyond 40 decay times is below the doubles' precision."""
    t = _tops(rounds).replace(LEGS, EXCITED).replace(f"{list(hawkes.DECAYS)}::DOUBLE[]", f"{decays}::DOUBLE[]")
    t = t.replace("SELECT beta, a.event_id, a.leg,", "SELECT beta, a.rid, a.leg,")
    return t.replace("FROM g, legs a LEFT JOIN legs b ON b.t < a.t GROUP BY ALL", "FROM g, (SELECT *, row_number() OVER () AS rid FROM legs) a LEFT JOIN legs b ON b.t < a.t AND b.t > a.t - 40 / g.beta GROUP BY ALL")


def _fitted_sql(decays: list[float]) -> str:
    parts = ", ".join(f"round({c} / beta, 4) AS {c}" for c in _PARTS)
    return f"WITH RECURSIVE {_excited_sql(decays, 3000)} SELECT beta, round(ll, 2) AS ll, round(14 - 2 * ll, 1) AS aic, round(mu0 * 1e6, 1) AS mu0, round(mu1 * 1e6, 1) AS mu1, {parts} FROM top"


def _fitted(f: DataFrame) -> DataFrame:
    """Likelihoods, rates a million seconds and the parts of the branching matrix."""
    rates = [F.round(F.col(c) * 1e6, 1).alias(c) for c in ("mu0", "mu1")]
    return f.select("beta", F.round("ll", 2).alias("ll"), F.round("aic", 1).alias("aic"), *rates, *[F.round(F.col(c) / F.col("beta"), 4).alias(c) for c in _PARTS])


@query("hawkes_fit_excited", _fitted_sql([3e-4, 1e-3, 3e-3]))
def hawkes_fit_excited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of a process that excites itself, which constant rates do not come near."""
    l, end = excited(spark, sf_dir)
    return _fitted(hawkes.fit_grid(l, end, (3e-4, 1e-3, 3e-3)))


@query("hawkes_best_excited", f"{_fitted_sql([3e-4, 1e-3, 3e-3])} ORDER BY aic, beta LIMIT 1")
def hawkes_best_excited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decay of least criterion for the same process."""
    l, end = excited(spark, sf_dir)
    return _fitted(hawkes.best(hawkes.fit_grid(l, end, (3e-4, 1e-3, 3e-3))))


@query("hawkes_fit_wide", _fitted_sql([1e-3]))
def hawkes_fit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by aggregates over all tasks, the way for processes that no task should hold."""
    l, end = excited(spark, sf_dir)
    return _fitted(hawkes.fit_grid(l, end, (1e-3,), most_events=0))


def _profile_sql(etas: list[float], rounds: int) -> str:
    """The constrained top in SQL, by expectation and conditional maximisation: with x, s, q as in hawkes._OnEta, each
    has a closed best value given the others, so no round falls."""
    root = lambda a, b, d: f"CASE WHEN abs({d}) < 1e-12 * ({a} + {b}) THEN {a} / ({a} + {b}) ELSE (({d}) + {a} + {b} - sqrt((({d}) + {a} + {b}) * (({d}) + {a} + {b}) - 4 * ({d}) * {a})) / (2 * ({d})) END"
    return f"""{EXCITED}, z AS (SELECT max(t) AS z FROM legs), b AS (SELECT 0.001::DOUBLE AS beta),
     e AS MATERIALIZED (SELECT a.leg, a.t, a.rowid AS i, coalesce(sum(exp(-beta * (a.t - p.t))) FILTER (p.leg = 0), 0) AS r0, coalesce(sum(exp(-beta * (a.t - p.t))) FILTER (p.leg = 1), 0) AS r1
       FROM (SELECT *, row_number() OVER () AS rowid FROM legs) a LEFT JOIN legs p ON p.t < a.t AND p.t > a.t - 40000, b GROUP BY ALL),
     m AS MATERIALIZED (SELECT z, beta, sum(1 - exp(-beta * (z - t))) FILTER (leg = 0) / beta AS m0, sum(1 - exp(-beta * (z - t))) FILTER (leg = 1) / beta AS m1, count(*) FILTER (leg = 0) AS n0, count(*) FILTER (leg = 1) AS n1 FROM legs, z, b GROUP BY z, beta),
     it AS (SELECT 0 AS k, eta, eta * beta AS c, n0 / z * (1 - eta) AS u0, n1 / z * (1 - eta) AS u1, 0.5::DOUBLE AS s, 0.5::DOUBLE AS q, 1.0::DOUBLE AS x FROM m, (SELECT unnest({etas}::DOUBLE[]) AS eta)
       UNION ALL SELECT k, eta, c, u0, u1, s, q, (w10 - w01 + sqrt((w10 - w01) * (w10 - w01) + 4 * c * q * m0 * c * (1 - s) * m1)) / (2 * c * q * m0) FROM
        (SELECT k + 1 AS k, eta, c, v0 / z AS u0, v1 / z AS u1, {root("w00", "w01", "c * (m0 - m1 / x)")} AS s, {root("w10", "w11", "c * (x * m0 - m1)")} AS q, x, w01, w10, m0, m1 FROM
         (SELECT any_value(k) AS k, it.eta, any_value(c) AS c, any_value(x) AS x,
            sum(u0 / (u0 + c * s * r0 + c * (1 - s) / x * r1)) FILTER (leg = 0) AS v0, sum(c * s * r0 / (u0 + c * s * r0 + c * (1 - s) / x * r1)) FILTER (leg = 0) AS w00, sum(c * (1 - s) / x * r1 / (u0 + c * s * r0 + c * (1 - s) / x * r1)) FILTER (leg = 0) AS w01,
            sum(u1 / (u1 + c * x * q * r0 + c * (1 - q) * r1)) FILTER (leg = 1) AS v1, sum(c * x * q * r0 / (u1 + c * x * q * r0 + c * (1 - q) * r1)) FILTER (leg = 1) AS w10, sum(c * (1 - q) * r1 / (u1 + c * x * q * r0 + c * (1 - q) * r1)) FILTER (leg = 1) AS w11
          FROM it, e WHERE k < {rounds} GROUP BY it.eta), m)),
     l AS (SELECT eta, sum(CASE leg WHEN 0 THEN ln(u0 + c * s * r0 + c * (1 - s) / x * r1) ELSE ln(u1 + c * x * q * r0 + c * (1 - q) * r1) END)
         - any_value((u0 + u1) * z + c * s * m0 + c * (1 - s) / x * m1 + c * x * q * m0 + c * (1 - q) * m1) AS ll FROM it, e, m WHERE k = {rounds} GROUP BY eta)"""


PROFILED = [0.4, 0.5, 0.6]


@query("profile_likelihood", f"WITH RECURSIVE {_profile_sql(PROFILED, 800)} SELECT eta, round(ll, 2) AS ll FROM l")
def profile_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood at three branching ratios of a process that excites itself."""
    l, end = excited(spark, sf_dir)
    return hawkes.profile(l, 1e-3, end, PROFILED).filter("eta IS NOT NULL").select("eta", F.round("ll", 2).alias("ll"))


@query("profile_interval")
def profile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, end = process(spark, sf_dir)
    return hawkes.profile_interval(hawkes.profile(l, 1e-3, end))


_UV = f"""{LEGS}, k AS (SELECT leg, row_number() OVER (PARTITION BY leg ORDER BY t) AS i, row_number() OVER (PARTITION BY leg ORDER BY value, event_id) / (count(*) OVER (PARTITION BY leg) + 1) AS u FROM legs),
   s AS (SELECT a.u AS u, b.u AS v FROM k a JOIN k b ON a.i = b.i AND a.leg = 0 AND b.leg = 1)"""


def _uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.paired(series.pit(legs(spark, sf_dir), "leg", "value", "event_id"), "u", "t").select(F.col("a").alias("u"), F.col("b").alias("v"))


@query(
    "copula_ll",
    f"""WITH {_UV}, g AS (SELECT unnest([1.2, 2.0]::DOUBLE[]) AS th), a AS (SELECT th,
        sum(ln(1 + th) - (1 + th) * (ln(u) + ln(v)) - (2 + 1 / th) * ln(pow(u, -th) + pow(v, -th) - 1)) AS clayton,
        sum(ln(th) + ln(1 - exp(-th)) - th * (u + v) - 2 * ln(abs((1 - exp(-th)) - (1 - exp(-th * u)) * (1 - exp(-th * v))))) AS frank,
        sum(-pow(pow(-ln(u), th) + pow(-ln(v), th), 1 / th) - ln(u) - ln(v) + (th - 1) * (ln(-ln(u)) + ln(-ln(v))) + (1 / th - 2) * ln(pow(-ln(u), th) + pow(-ln(v), th))
            + ln(pow(pow(-ln(u), th) + pow(-ln(v), th), 1 / th) + th - 1)) AS gumbel FROM s, g GROUP BY th)
      SELECT family, th AS theta, round(ll, 4) AS ll FROM (SELECT 'clayton' AS family, th, clayton AS ll FROM a UNION ALL SELECT 'frank', th, frank FROM a UNION ALL SELECT 'gumbel', th, gumbel FROM a)""",
)
def copula_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = _uniforms(spark, sf_dir), None
    for f in ("clayton", "frank", "gumbel"):
        one = dependence.log_likelihood(s, f, [1.2, 2.0]).select(F.lit(f).alias("family"), "theta", F.round("ll", 4).alias("ll"))
        out = one if out is None else out.unionByName(one)
    return out


#: Pairs that do depend on each other: the rank of a mixture of both uniforms against the first.
_DEPENDENT = f"{_UV}, dep AS (SELECT u, row_number() OVER (ORDER BY (u * 0.6 + v * 0.4) * 10, u) / (count(*) OVER () + 1) AS v FROM s)"


def dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _uniforms(spark, sf_dir).select(F.lit(0).alias("g"), "u", ((F.col("u") * 0.6 + F.col("v") * 0.4) * 10).alias("w"))
    ranked = series.ranges.ranked(d, ["g"], "w", "u", "i", {"n": F.count("*")})
    return ranked.select("u", (F.col("i") / (F.col("n") + 1)).alias("v"))


def _menu_sql(rounds: int = 18) -> str:
    """Tops in SQL: eight parts of each family's bracket, the best point's neighbours are the next bracket; the normal family from its sums."""
    th = "(lo + (hi - lo) * j / 8)"
    parts = {
        "clayton": "ln(1 + th) - (1 + th) * (ln(u) + ln(v)) - (2 + 1 / th) * ln(pow(u, -th) + pow(v, -th) - 1)",
        "frank": "ln(th) + ln(1 - exp(-th)) - th * (u + v) - 2 * ln(abs((1 - exp(-th)) - (1 - exp(-th * u)) * (1 - exp(-th * v))))",
        "gumbel": "-pow(pow(-ln(u), th) + pow(-ln(v), th), 1 / th) - ln(u) - ln(v) + (th - 1) * (ln(-ln(u)) + ln(-ln(v))) + (1 / th - 2) * ln(pow(-ln(u), th) + pow(-ln(v), th)) + ln(pow(pow(-ln(u), th) + pow(-ln(v), th), 1 / th) + th - 1)",
    }
    cases = " ".join(f"WHEN '{f}' THEN {e}" for f, e in parts.items())
    start = ", ".join(f"('{f}', {dependence.BOUNDS[f][0]}::DOUBLE, {dependence.BOUNDS[f][1]}::DOUBLE)" for f in parts)
    return f"""{_DEPENDENT}, pairs AS MATERIALIZED (SELECT u::DOUBLE AS u, v::DOUBLE AS v FROM dep), it AS (SELECT 0 AS k, f, lo, hi, NULL::DOUBLE AS ll FROM (VALUES {start}) t(f, lo, hi)
       UNION ALL SELECT any_value(k) + 1, f, greatest(any_value(lo), arg_max(th, ll) - any_value(step)), least(any_value(hi), arg_max(th, ll) + any_value(step)), max(ll)
       FROM (SELECT k, f, lo, hi, (hi - lo) / 8 AS step, th, sum(CASE f {cases} END) AS ll FROM (SELECT *, {th} AS th FROM it, (SELECT unnest(range(0, 9)) AS j) WHERE k < {rounds}), pairs GROUP BY ALL) GROUP BY f),
     q AS (SELECT {dependence.normal_quantile("u")} AS x, {dependence.normal_quantile("v")} AS y FROM pairs), sums AS (SELECT count(*) AS n, sum(x * x + y * y) AS a, sum(x * y) AS b FROM q),
     h AS (SELECT 0 AS k, -0.999::DOUBLE AS lo, 0.999::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN g > 0 THEN m ELSE lo END, CASE WHEN g > 0 THEN hi ELSE m END FROM
       (SELECT *, n * m * (1 - m * m) + (1 + m * m) * b - m * a AS g FROM (SELECT *, (lo + hi) / 2 AS m FROM h WHERE k < 70), sums)),
     tops AS (SELECT f, (lo + hi) / 2 AS th, ll, n FROM it, sums WHERE k = {rounds} UNION ALL SELECT 'gaussian', lo, -0.5 * n * ln(1 - lo * lo) - (lo * lo * a - 2 * lo * b) / (2 * (1 - lo * lo)), n FROM h, sums WHERE k = 70)"""


@query("copula_fits", f"WITH RECURSIVE {_menu_sql()} SELECT f AS family, round(th, 4) AS theta, round(ll, 4) AS ll, round(ln(n) - 2 * ll, 3) AS bic FROM tops")
def copula_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each one-parameter family's fit to pairs that depend on each other."""
    m = dependence.fit_menu(dependent(spark, sf_dir), ("gaussian", "clayton", "frank", "gumbel"))
    return m.select("family", F.round("theta", 4).alias("theta"), F.round("ll", 4).alias("ll"), F.round("bic", 3).alias("bic"))


@query("copula_menu")
def copula_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.best_family(dependence.fit_menu(_uniforms(spark, sf_dir)))


def _design_sql(n: int) -> str:
    return f"""b AS (SELECT s_suppkey, k, s_acctbal * (s_nationkey + 1) > 60000 AS base, CASE k WHEN 0 THEN s_acctbal WHEN 1 THEN s_nationkey + 1.0 ELSE -s_acctbal / 1e5 END AS b FROM supplier, (SELECT unnest(range(0, 3)) AS k)),
       h AS (SELECT s_suppkey, base, i, k, least(b * 0.5, b * 1.5) AS lo, greatest(b * 0.5, b * 1.5) AS hi, md5('lhs:' || k || ':' || s_suppkey || ':' || i) AS h FROM b, (SELECT unnest(range(0, {n})) AS i)),
       x AS (SELECT s_suppkey, base, i, k, lo + (hi - lo) * (row_number() OVER (PARTITION BY s_suppkey, k ORDER BY h) - 1 + ('0x' || substr(h, 1, 12))::BIGINT / 281474976710656.0) / {n} AS x FROM h),
       p AS (SELECT s_suppkey, base, i, max(x) FILTER (k = 0) AS x0, max(x) FILTER (k = 1) AS x1, max(x) FILTER (k = 2) AS x2 FROM x GROUP BY s_suppkey, base, i)"""


def _designs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") + 1.0).alias("nation"), (-F.col("s_acctbal") / 1e5).alias("shift"))
    return dependence.designs(s, "s_suppkey", ["s_acctbal", "nation", "shift"], n)


@query("latin_hypercube", f"WITH {_design_sql(16)} SELECT s_suppkey, i, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM p")
def latin_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen points around each supplier's own parameters, each stratum of each parameter once."""
    return _designs(spark, sf_dir, 16).select("s_suppkey", "i", *[F.round(f"x{k}", 6).alias(f"x{k}") for k in range(3)])


@query(
    "sensitivity_flips",
    f"""WITH {_design_sql(64)}, f AS (SELECT s_suppkey, i, (x0 * x1 > 60000) <> base AS flip FROM p)
       SELECT s_suppkey, count(*) FILTER (flip) AS flips, coalesce(array_to_string(list_slice(list(i ORDER BY i) FILTER (flip), 1, 5), ','), '') AS examples, count(*) FILTER (flip) > 0 AS fragile FROM f GROUP BY s_suppkey""",
)
def sensitivity_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier: how many of 64 points decide otherwise than its own parameters do."""
    own = F.col("s_acctbal") * F.col("nation") > 60000
    s = dependence.sensitivity(_designs(spark, sf_dir, 64), F.col("x0") * F.col("x1") > 60000, own, ["s_suppkey"])
    return s.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("gate", f"WITH {_MOM}, k AS (SELECT bool_or(n >= 30 AND m3 > 0 AND m4 / (m2 * m2) - 3 > 0) AS tails FROM m) SELECT tails, FALSE AS excited, tails OR FALSE AS any_passed FROM k")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series.tail_gate(series.moments(legs(spark, sf_dir), "leg", "value"))
    excited = dependence.self_excitation_gate(F.lit(float("nan")), F.lit(True))
    return m.agg(F.bool_or("fires").alias("tails")).withColumn("excited", excited).withColumn("any_passed", F.col("tails") | F.col("excited"))


@query("characteristic", f"WITH {LEGS} SELECT u, round(avg(cos(u * value)), 9) AS re, round(avg(sin(u * value)), 9) AS im FROM legs, (SELECT unnest([-1.0, 0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS u) GROUP BY u")
def characteristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dependence.characteristic(legs(spark, sf_dir), "value", [-1.0, 0.01, 0.1, 1.0, 10.0])
    return c.select("u", F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


@query("decay_method", f"WITH {LEGS}, c AS (SELECT u, avg(cos(u * value)) AS re, avg(sin(u * value)) AS im FROM legs, (SELECT unnest([1.0, 10.0, 100.0]::DOUBLE[]) AS u) GROUP BY u), s AS (SELECT regr_slope(ln(greatest(sqrt(re * re + im * im), 1e-30)), ln(u)) AS slope FROM c) SELECT round(slope, 6) AS slope, CASE WHEN slope > -0.5 THEN 'none' WHEN slope > -1.5 THEN 'PROJ' ELSE 'COS' END AS method FROM s")
def decay_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dependence.decay_slope(dependence.characteristic(legs(spark, sf_dir), "value", [1.0, 10.0, 100.0]))
    return s.select(F.round("slope", 6).alias("slope"), scalars.decay_method(F.col("slope")).alias("method"))


@query("divergence", "SELECT o_orderkey, round((greatest(a, b, c) - least(a, b, c)) / abs((a + b + c) / 3) * 100, 6) AS pct FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice * 1.1 AS b, o_totalprice + 500 AS c FROM orders)")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(dependence.divergence(p, p * 1.1, p + 500), 6).alias("pct"))
