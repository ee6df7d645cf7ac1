"""Copulas, gates, pricing and verdicts over residuals and uniforms."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import scalars
from tideline.operators import ranges
from tideline.session import shared_dir

FAMILIES = ("gaussian", "t", "clayton", "frank", "gumbel")
#: Bounds of the parameter of each one-parameter family.
BOUNDS = {"gaussian": (-0.999, 0.999), "clayton": (1e-4, 30.0), "frank": (1e-4, 30.0), "gumbel": (1 + 1e-6, 30.0)}
DEGENERATE_PAIRS = 101


# ---- log densities as Columns -------------------------------------------------------------------


def clayton_log_density(u: Column, v: Column, th: Column | float) -> Column:
    th = th if isinstance(th, Column) else F.lit(float(th))
    return F.log1p(th) - (1 + th) * (F.ln(u) + F.ln(v)) - (2 + 1 / th) * F.ln(F.pow(u, -th) + F.pow(v, -th) - 1)


def frank_log_density(u: Column, v: Column, th: Column | float) -> Column:
    th = th if isinstance(th, Column) else F.lit(float(th))
    e = lambda x: F.exp(-th * x)
    d = (1 - F.exp(-th)) - (1 - e(u)) * (1 - e(v))
    return F.ln(th) + F.ln(1 - F.exp(-th)) - th * (u + v) - 2 * F.ln(F.abs(d))


def gumbel_log_density(u: Column, v: Column, th: Column | float) -> Column:
    th = th if isinstance(th, Column) else F.lit(float(th))
    x, y = -F.ln(u), -F.ln(v)
    s = F.pow(x, th) + F.pow(y, th)
    c = F.pow(s, 1 / th)
    return -c + x + y + (th - 1) * (F.ln(x) + F.ln(y)) + (1 / th - 2) * F.ln(s) + F.ln(c + th - 1)


def log_density(family: str, u: Column, v: Column, th: Column | float) -> Column:
    return {"clayton": clayton_log_density, "frank": frank_log_density, "gumbel": gumbel_log_density}[family](u, v, th)


def log_likelihood(sample: DataFrame, family: str, thetas: Sequence[float]) -> DataFrame:
    """theta, ll over a sample (u, v): one pass for a whole grid of parameters."""
    grid = sample.sparkSession.createDataFrame([(float(t),) for t in thetas], "theta double")
    return sample.crossJoin(F.broadcast(grid)).groupBy("theta").agg(F.sum(log_density(family, F.col("u"), F.col("v"), F.col("theta"))).alias("ll"))


# ---- fits ---------------------------------------------------------------------------------------


def _quantile_t(p: np.ndarray, nu: float) -> np.ndarray:
    """Student quantiles by bisection on a cumulative table of the density."""
    x = np.sinh(np.linspace(-18, 18, 60001))
    logc = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    f = np.exp(logc - (nu + 1) / 2 * np.log1p(x * x / nu))
    c = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))])
    return np.interp(p, c / c[-1], x)


#: The rational approximations of Wichura's algorithm AS 241 to the normal quantile, numerators then
#: denominators, for the middle, the shoulders and the tails.
_AS241 = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: str) -> str:
    """The normal quantile of a column in (0, 1), as SQL that any engine with doubles reads."""

    def ratio(k: int, r: str) -> str:
        out = []
        for coefficients in _AS241[k : k + 2]:
            e = "0e0"
            for c in reversed(coefficients):
                e = f"({e} * {r} + {c:.17e})"
            out.append(e)
        return f"{out[0]} / {out[1]}"

    q, far = f"({p} - 5e-1)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    tail = f"CASE WHEN {far} <= 5e0 THEN {ratio(2, f'({far} - 1.6e0)')} ELSE {ratio(4, f'({far} - 5e0)')} END"
    return f"CASE WHEN abs({q}) <= 4.25e-1 THEN {q} * {ratio(0, f'(1.80625e-1 - {q} * {q})')} WHEN {q} < 0e0 THEN -({tail}) ELSE {tail} END"


#: Degrees of freedom that the t family is tried with.
FREEDOMS = (2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 20.0, 40.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _t_quantiles(u: pd.Series) -> pd.Series:
    """A uniform's quantile for each of FREEDOMS."""
    return pd.Series(list(np.stack([_quantile_t(u.to_numpy(float), nu) for nu in FREEDOMS], axis=1)))


#: Densities that a pass works on at a time, so that they stay in a core's cache.
_PASS_NUMBERS = 1 << 15


def _densities(kind: tuple[str, float], th: np.ndarray, u: np.ndarray, v: np.ndarray, tu: np.ndarray | None, tv: np.ndarray | None) -> np.ndarray:
    """The log densities, pairs x parameters, of a kind; 0 where a logarithm has no value, which a sum of Columns leaves out."""
    (family, nu), lu, lv = kind, np.log(u)[:, None], np.log(v)[:, None]
    if family == "clayton":
        arg = np.exp(-th * lu) + np.exp(-th * lv) - 1
        return np.log1p(th) - (1 + th) * (lu + lv) - (2 + 1 / th) * np.log(arg)
    if family == "frank":
        d = np.abs(-np.expm1(-th) - np.expm1(-th * u[:, None]) * np.expm1(-th * v[:, None]))
        return np.where(d > 0, np.log(th) + np.log(-np.expm1(-th)) - th * (u + v)[:, None] - 2 * np.log(np.maximum(d, 1e-300)), 0.0)
    if family == "gumbel":
        lx, ly = np.log(-lu), np.log(-lv)
        s = np.exp(th * lx) + np.exp(th * ly)
        ls = np.log(np.where(s > 0, s, 1.0))
        c = np.exp(ls / th)
        return np.where(s > 0, -c - lu - lv + (th - 1) * (lx + ly) + (1 / th - 2) * ls + np.log(c + th - 1), 0.0)
    g, j = math.lgamma, FREEDOMS.index(nu)
    x, y = tu[:, j, None], tv[:, j, None]
    q = (x * x + y * y - 2 * th * x * y) / (nu * (1 - th * th))
    own = (nu + 1) / 2 * (np.log1p(x * x / nu) + np.log1p(y * y / nu))
    return g((nu + 2) / 2) + g(nu / 2) - 2 * g((nu + 1) / 2) - 0.5 * np.log1p(-th * th) - (nu + 2) / 2 * np.log1p(q) + own


def _scores(sample: DataFrame, kinds: Sequence[tuple[str, float]], tried: Mapping[tuple[str, float], Sequence[float]]) -> dict[tuple[str, float], dict[float, float]]:
    """The log-likelihood of each kind at its parameters: one pass over the sample for all of them; a task sends a sum for each."""
    at = {k: np.array([float(th) for th in tried[kind]]) for k, kind in enumerate(kinds) if len(tried.get(kind, ()))}

    def part(batches):
        total = {k: np.zeros(len(th)) for k, th in at.items()}
        for pdf in batches:
            u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
            tu, tv = (np.array(pdf[c].tolist(), float) if c in pdf else None for c in ("tu", "tv"))
            with np.errstate(all="ignore"):
                for k, th in at.items():
                    step = max(64, _PASS_NUMBERS // len(th))
                    for i in range(0, len(u), step):
                        own = slice(i, i + step)
                        total[k] += _densities(kinds[k], th, u[own], v[own], None if tu is None else tu[own], None if tv is None else tv[own]).sum(axis=0)
        yield pd.DataFrame([(k, j, x) for k, row in total.items() for j, x in enumerate(row)], columns=["k", "j", "ll"])

    out: dict[tuple[str, float], dict[float, float]] = {kind: {} for kind in kinds}
    for r in sample.mapInPandas(part, "k int, j int, ll double").groupBy("k", "j").agg(F.sum("ll").alias("ll")).collect():
        out[kinds[r["k"]]][float(at[r["k"]][r["j"]])] = r["ll"] if r["ll"] is not None and math.isfinite(r["ll"]) else -1e300
    return out


def _gaussian_top(n: int, squares: float, product: float) -> tuple[float, float]:
    """The correlation at which the normal copula's likelihood is highest, by halving where its slope changes sign, and the likelihood."""
    lo, hi = BOUNDS["gaussian"]
    slope = lambda r: n * r * (1 - r * r) + (1 + r * r) * product - r * squares
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    r = (lo + hi) / 2
    return r, -0.5 * n * math.log(1 - r * r) - (r * r * squares - 2 * r * product) / (2 * (1 - r * r))


class _Climb:
    """One family's way to its top: Newton steps from slopes by differences, kept between two ends that shrink."""

    def __init__(self, grid: list[float], scores: dict[float, float]):
        k = max(range(len(grid)), key=lambda i: scores[grid[i]])
        self.bounds, self.low, self.high, self.th = (grid[0], grid[-1]), grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], grid[k]
        self.ll, self.done = scores[self.th], False

    def _step(self) -> float:
        return 1e-4 * max(1.0, abs(self.th))

    def tried(self) -> list[float]:
        """Three points within the bounds around the present one."""
        h = self._step()
        mid = min(max(self.th, self.bounds[0] + h), self.bounds[1] - h)
        return [mid - h, mid, mid + h]

    def take(self, scores: dict[float, float]) -> None:
        (a, m, b), h = self.tried(), self._step()
        slope, bend = (scores[b] - scores[a]) / (2 * h), (scores[a] - 2 * scores[m] + scores[b]) / (h * h)
        slope += bend * (self.th - m)
        best = max((a, m, b), key=scores.get)
        if scores[best] > self.ll:
            self.ll = scores[best]
        self.low, self.high = (self.th, self.high) if slope > 0 else (self.low, self.th)
        to = self.th - slope / bend if bend < 0 else math.nan
        if bend < 0 and to <= self.bounds[0] and self.low == self.bounds[0]:
            to = self.low
        elif bend < 0 and to >= self.bounds[1] and self.high == self.bounds[1]:
            to = self.high
        elif not self.low < to < self.high:
            to = (self.low + self.high) / 2
        self.done = abs(to - self.th) <= 1e-9 * max(1.0, abs(self.th))
        self.th = to


GRID, MOST_STEPS = 25, 40


def fit_menu(sample: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """family, theta, nu, ll, bic over a sample (u, v); bic is k ln n - 2 ll. A sample of so few pairs that no lag fits is `degenerate`.

    The pairs are written once. The normal family needs their sums alone; the others climb together, a grid and then Newton
    steps, one pass over the pairs a step, in which every family's candidates are summed up where the pairs are. The t family is tried with FREEDOMS. Pairs with
    a null, NaN or a value outside (0, 1) take no part.
    """
    spark = sample.sparkSession
    d = sample.select(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).filter("u > 0 AND u < 1 AND v > 0 AND v < 1")
    if "t" in families:
        d = d.withColumns({"tu": _t_quantiles("u"), "tv": _t_quantiles("v")})
    at = f"{shared_dir(spark)}/copula-{uuid.uuid4().hex}"
    d.repartition(3 * spark.sparkContext.defaultParallelism).write.parquet(at)  # a file or two, as ranks leave them, is a task or two a pass
    d = spark.read.parquet(at)
    x, y = F.expr(normal_quantile("u")), F.expr(normal_quantile("v"))
    s = d.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("squares"), F.sum(F.col("x") * F.col("y")).alias("product")).first()
    n, schema = s["n"], "family string, theta double, nu double, ll double, bic double"
    if n <= DEGENERATE_PAIRS:
        return spark.createDataFrame([("degenerate", math.nan, math.nan, math.nan, math.nan)], schema)
    kinds = [("t", nu) for nu in FREEDOMS if "t" in families] + [(f, 0.0) for f in families if f not in ("gaussian", "t")]
    rows = [("gaussian", 0.0, *_gaussian_top(n, s["squares"], s["product"]))] if "gaussian" in families else []
    if kinds:
        grids = {k: [float(g) for g in np.linspace(*(BOUNDS[k[0]] if k[0] != "t" else (-0.99, 0.99)), GRID)] for k in kinds}
        first = _scores(d, kinds, grids)
        climbs = {k: _Climb(grids[k], first[k]) for k in kinds}
        for _ in range(MOST_STEPS):
            if not (going := {k: c for k, c in climbs.items() if not c.done}):
                break
            got = _scores(d, kinds, {k: c.tried() for k, c in going.items()})
            for k, c in going.items():
                c.take(got[k])
        last = _scores(d, kinds, {k: [c.th] for k, c in climbs.items()})
        tops = [(f, nu, c.th, last[f, nu][c.th]) for (f, nu), c in climbs.items()]
        rows += [r for r in tops if r[0] != "t"]
        if ts := [r for r in tops if r[0] == "t"]:
            rows.append(max(ts, key=lambda r: r[3]))
    return spark.createDataFrame([(f, th, nu, ll, (2 if f == "t" else 1) * math.log(n) - 2 * ll) for f, nu, th, ll in rows], schema)


def best_family(menu: DataFrame) -> DataFrame:
    """The family of least criterion; the first in the menu on ties."""
    order = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    return menu.orderBy("bic", order).limit(1)


def sample_copula(family: str, th: float, nu: float, n: int, seed: int) -> np.ndarray:
    """n pairs of uniforms with the copula's dependence."""
    rng = np.random.default_rng(seed)
    if family in ("gaussian", "t"):
        z = rng.normal(size=(n, 2))
        z[:, 1] = th * z[:, 0] + math.sqrt(1 - th * th) * z[:, 1]
        if family == "t":
            z /= np.sqrt(rng.chisquare(nu, n) / nu)[:, None]
            grid = np.linspace(1e-6, 1 - 1e-6, 20001)
            return np.interp(z, _quantile_t(grid, nu), grid)
        return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    w = rng.uniform(1e-12, 1, (n, 2))
    if family == "clayton":
        v = (w[:, 0] ** -th * (w[:, 1] ** (-th / (1 + th)) - 1) + 1) ** (-1 / th)
        return np.stack([w[:, 0], v], 1)
    if family == "frank":
        a = np.exp(-th * w[:, 0])
        v = -np.log1p(w[:, 1] * math.expm1(-th) / (w[:, 1] + (1 - w[:, 1]) * a)) / th
        return np.stack([w[:, 0], v], 1)
    if family == "gumbel":  # a positive stable mixture
        al = 1 / th
        t = rng.uniform(1e-9, math.pi - 1e-9, n)
        e = rng.exponential(size=n)
        s = (np.sin((1 - al) * t) / e) ** ((1 - al) / al) * np.sin(al * t) / np.sin(t) ** (1 / al)
        return np.exp(-((rng.exponential(size=(n, 2)) / s[:, None]) ** al))
    return w  # independence


# ---- gates --------------------------------------------------------------------------------------


def designs(df: DataFrame, key: str, base: Sequence[str], n: int = 64, ratio: float = 0.5, seed: str = "lhs") -> DataFrame:
    """df with i from 0 to n - 1 and x0, x1, ...: a Latin hypercube of n points around each row's own columns `base`.

    Strata and places in them are hashes of seed, dimension, key and i, sorted within the row, so nothing is shuffled.
    Coordinates of a null base are null; rows that repeat a key get the same strata.
    """
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    hash_of = lambda k: lambda i: F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(k)), F.col(key).cast("string"), i.cast("string")))
    hashes = {}
    for k in range(len(base)):
        h = F.transform(numbers, hash_of(k))
        hashes |= {f"_h{k}": h, f"_s{k}": F.array_sort(h)}
    d = df.withColumns(hashes).withColumn("i", F.explode(numbers))
    points = {}
    for k, b in enumerate(base):
        own = F.col(f"_h{k}")[F.col("i")]
        place = F.array_position(F.col(f"_s{k}"), own) - 1 + F.conv(F.substring(own, 1, 12), 16, 10).cast("double") / float(16**12)
        ends = F.col(b) * (1 - ratio), F.col(b) * (1 + ratio)
        points[f"x{k}"] = F.least(*ends) + (F.greatest(*ends) - F.least(*ends)) * place / n
    return d.withColumns(points).drop(*hashes)


def sensitivity(cells: DataFrame, decision: Column, base: bool | Column, by: Sequence[str] = ()) -> DataFrame:
    """One row a key `by`: flips, the number of cells that decide otherwise than base; examples, the first five; fragile."""
    d = cells.withColumn("flip", decision != base)
    ex = F.slice(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("flip"), F.col("i"))))), 1, 5)
    return d.groupBy(*by).agg(F.count_if("flip").alias("flips"), ex.alias("examples")).withColumn("fragile", F.col("flips") > 0)


def self_excitation_gate(eta: Column, floor_met: Column, least: float = 0.2) -> Column:
    return F.coalesce(~F.isnan(eta) & (eta >= least), F.lit(False)) & F.coalesce(floor_met, F.lit(False))


# ---- pricing ------------------------------------------------------------------------------------


def characteristic(sample: DataFrame, value: str, us: Sequence[float]) -> DataFrame:
    """u, re, im: the mean of exp(i u x) over a sample."""
    grid = sample.sparkSession.createDataFrame([(float(u),) for u in us], "u double")
    x = F.col("u") * F.col(value)
    return sample.select(value).crossJoin(F.broadcast(grid)).groupBy("u").agg(F.avg(F.cos(x)).alias("re"), F.avg(F.sin(x)).alias("im"))


def decay_slope(cf: DataFrame) -> DataFrame:
    """One row: slope of ln|phi| on ln u over the positive u of a characteristic function."""
    size = F.greatest(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.lit(1e-30))
    return cf.filter("u > 0").agg(F.regr_slope(F.ln(size), F.ln("u")).alias("slope"))


def _inverse(phi: np.ndarray, du: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(phi)
    q = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(phi))).real * du / (2 * np.pi)
    return (np.arange(n) - n // 2) * (2 * np.pi / (n * du)), q


def invert(cf: Callable[[np.ndarray], np.ndarray], n: int = 2048, reach: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """Grid and density by the inverse transform of a characteristic function on [-reach, reach)."""
    du = 2 * reach / n
    return _inverse(np.asarray(cf((np.arange(n) - n // 2) * du), complex), du)


ORDER = 12


def transform(sample: DataFrame, value: str, n: int = 2048, reach: float = 200.0) -> np.ndarray:
    """The mean of exp(i u x) over every finite value of a sample, at the n equal steps u of [-reach, reach).

    At those u the mean depends on x modulo 2 pi over the step alone. So 4 n cells hold all values, however far they
    lie, and a cell is summed up by the moments of its values about its middle: one aggregate of ORDER + 1 sums, combined before its
    shuffle. A series in u then gives the mean, with an error below 1e-14.
    """
    du, cells = 2 * reach / n, 4 * n
    period = 2 * math.pi / du
    width = period / cells
    x = F.col(value).cast("double")
    d = sample.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    at = F.pmod("_x", F.lit(period))
    d = d.select(at.alias("_p"), F.least(F.floor(at / width), F.lit(cells - 1)).alias("_c")).select("_c", (F.col("_p") - (F.col("_c") + 0.5) * width).alias("_d"))
    got = d.groupBy("_c").agg(*[F.sum(F.pow("_d", F.lit(j))).alias(f"m{j}") for j in range(ORDER + 1)]).toPandas()
    sums = np.zeros((ORDER + 1, cells))
    sums[:, got["_c"].to_numpy(int)] = got[[f"m{j}" for j in range(ORDER + 1)]].to_numpy(float).T
    m = np.arange(n) - n // 2
    u = m * du
    each = np.fft.ifft(sums, axis=1)[:, m % cells] * cells
    series = sum(each[j] * (1j * u) ** j / math.factorial(j) for j in range(ORDER + 1))
    return series * np.exp(0.5j * u * width) / max(float(sums[0].sum()), 1.0)


def _density_rows(spark, phi: np.ndarray, reach: float, attempts: int) -> DataFrame:
    """attempt, n, k, q: a finest transform has every coarser one in it, each second frequency a time."""
    parts = []
    for a in range(attempts):
        own = phi[:: 1 << (attempts - 1 - a)]
        k, q = _inverse(own, 2 * reach / len(own))
        parts.append(pd.DataFrame({"attempt": a, "n": len(own), "k": k, "q": q}))
    return spark.createDataFrame(pd.concat(parts), "attempt int, n int, k double, q double")


def densities(sample: DataFrame, value: str, n: int = 2048, reach: float = 200.0, spread: float = 0.2, attempts: int = 1) -> DataFrame:
    """attempt, n, k, q: the density of all finite values under a normal kernel of deviation `spread`, on n grid points and
    on twice as many a further attempt; 0 spreads nothing. A sample without values has a flat density."""
    most = n << (attempts - 1)
    u = (np.arange(most) - most // 2) * (2 * reach / most)
    return _density_rows(sample.sparkSession, transform(sample, value, most, reach) * np.exp(-0.5 * (spread * u) ** 2), reach, attempts)


def densities_of(spark, cf: Callable[[np.ndarray], np.ndarray], n: int = 2048, reach: float = 200.0, attempts: int = 1) -> DataFrame:
    """The same rows for a characteristic function that is known."""
    most = n << (attempts - 1)
    return _density_rows(spark, np.asarray(cf((np.arange(most) - most // 2) * (2 * reach / most)), complex), reach, attempts)


TOLERANCE = 1e-3


def _tries(density: DataFrame) -> DataFrame:
    """attempt, n, total, negative_mass, most_negative: one row an attempt."""
    lost = F.sum(F.greatest(-F.col("q"), F.lit(0.0)))
    negative = F.coalesce(lost / F.nullif(F.sum(F.abs("q")), F.lit(0.0)), F.lit(0.0))
    return density.groupBy("attempt", "n").agg(F.sum(F.greatest("q", F.lit(0.0))).alias("total"), negative.alias("negative_mass"), F.min("q").alias("most_negative"))


def strip(density: DataFrame, payoff: Callable[[Column], Column], tolerance: float = TOLERANCE) -> DataFrame:
    """attempt, n, strike, price, negative_mass at every grid point of the first attempt that is not too negative; no row where none is."""
    tries = _tries(density).filter(F.col("negative_mass") < tolerance)
    first = tries.agg(F.min_by(F.struct("attempt", "total", "negative_mass"), "attempt").alias("c")).select("c.*")
    d = density.join(F.broadcast(first), "attempt")
    price = payoff(F.col("k")) * F.greatest("q", F.lit(0.0)) / F.greatest("total", F.lit(1e-30))
    return d.select("attempt", "n", F.col("k").alias("strike"), price.alias("price"), "negative_mass")


def strip_state(density: DataFrame, cf: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: degenerate, n, escalated, negative_mass, most_negative of the attempt that holds, or of the last with reason, slope
    and method: how fast the characteristic function cf (u, re, im) decays and what would suit that."""
    t = _tries(density).withColumn("good", F.col("negative_mass") < tolerance)
    # the first good attempt, or the last of all
    pick = t.agg(F.min_by(F.struct("attempt", "n", "negative_mass", "most_negative", "good"), F.when(F.col("good"), F.col("attempt")).otherwise(1000 - F.col("attempt"))).alias("c")).select("c.*")
    bad = ~F.col("good")
    d = pick.crossJoin(decay_slope(cf)).select(
        bad.alias("degenerate"), "n", (F.col("attempt") > 0).alias("escalated"), "negative_mass", "most_negative", F.when(bad, "positivity_fail_after_2_12").alias("reason"), F.when(bad, F.col("slope")).alias("slope"),
    )
    return d.withColumn("method", F.when(F.col("degenerate"), scalars.decay_method(F.col("slope"))))


def quantiles(sample: DataFrame, value: str, points: int = 100_001) -> np.ndarray:
    """The sample's finite values in order, or beyond `points` of them its exact quantiles at so many equal steps.

    Every row counts. Values are ranked in Spark and at most two order statistics a step come to the driver.
    """
    d = sample.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    n = d.count()
    if n <= points:
        return np.array(sorted(r["x"] for r in d.collect()))
    at = np.arange(points) * (n - 1)
    low, part = at // (points - 1), at % (points - 1) / (points - 1)
    high = np.minimum(low + 1, n - 1)
    ranks = sample.sparkSession.createDataFrame(pd.DataFrame({"r": np.union1d(low, high)}), "r long")
    ranked = ranges.ranked(d.select(F.lit(0).alias("g"), "x"), ["g"], "x", None, "r").select("x", (F.col("r") - 1).alias("r"))
    got = ranked.join(F.broadcast(ranks), "r").toPandas().set_index("r")["x"]
    a, b = got.loc[low].to_numpy(), got.loc[high].to_numpy()
    return a + (b - a) * part


def uniforms(spark, n: int, names: Sequence[str], seed: str = "u") -> DataFrame:
    """i and n rows of independent uniforms in [0, 1), by hashes of seed, name and number: the same anywhere."""
    h = lambda name: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("i").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    return spark.range(n).withColumnRenamed("id", "i").select("i", *[h(name).alias(name) for name in names])


def at_quantile(points: DataFrame, u: str, sample: DataFrame, value: str, name: str) -> DataFrame:
    """points with `name`, the sample's quantile at `u` by linear interpolation between its order statistics.

    Values are ranked in ranges and the points meet two ranks each in a join, so neither side is collected.
    Values that are null or not finite take no part; without any, points are left as they are.
    """
    x = F.col(value).cast("double")
    d = sample.select(F.lit(0).alias("_g"), x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    n = d.count()
    if not n:
        return points.withColumn(name, F.col(u))
    ranked = ranges.ranked(d, ["_g"], "_x", None, "_r").select((F.col("_r") - 1).alias("_r"), "_x")
    at = F.col(u) * (n - 1)
    p = points.withColumns({"_low": F.floor(at), "_part": at - F.floor(at)})
    p = p.join(ranked.select(F.col("_r").alias("_low"), F.col("_x").alias("_a")), "_low")
    p = p.withColumn("_high", F.least(F.col("_low") + 1, F.lit(n - 1))).join(ranked.select(F.col("_r").alias("_high"), F.col("_x").alias("_b")), "_high")
    return p.withColumn(name, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).select(*points.columns, name)


def scenarios(spark, fitted: np.ndarray, n: int = 10_000, seed: str = "stress") -> DataFrame:
    """kind, u, v: n pairs of independent and n of comonotone uniforms, and the fitted ones."""
    free = uniforms(spark, n, ("a", "b", "c"), seed)
    out = free.select(F.lit("independence").alias("kind"), F.col("a").alias("u"), F.col("b").alias("v"))
    out = out.unionByName(free.select(F.lit("comonotone").alias("kind"), F.col("c").alias("u"), F.col("c").alias("v")))
    own = spark.createDataFrame(pd.DataFrame({"kind": "fitted", "u": fitted[:, 0], "v": fitted[:, 1]}), "kind string, u double, v double")
    return out.unionByName(own)


def stress(points: DataFrame, x: DataFrame, y: DataFrame, value: str, payoff: Callable[[Column, Column], Column]) -> DataFrame:
    """One row: independence, fitted, comonotone (mean payoffs over the scenarios of each kind when x and y have
    the marginals of two samples), divergence_pct, how far they are apart, and diverges, if by more than 30."""
    met = at_quantile(at_quantile(points, "u", x, value, "x"), "v", y, value, "y")
    pay = payoff(F.col("x"), F.col("y"))
    kinds = ("independence", "fitted", "comonotone")
    s = met.agg(*[F.avg(F.when(F.col("kind") == k, pay)).alias(k) for k in kinds])
    apart = divergence(*[F.col(k) for k in kinds])
    return s.withColumn("divergence_pct", apart).withColumn("diverges", F.coalesce(F.col("divergence_pct") > 30, F.lit(False)))


def divergence(a: Column, b: Column, c: Column) -> Column:
    """(max - min) / |mean| * 100 of three prices; null where one is missing or NaN, 0 where the mean is 0."""
    mean = (a + b + c) / 3
    bad = F.isnan(a) | F.isnan(b) | F.isnan(c)
    return F.when(~bad, F.when(mean == 0, 0.0).otherwise((F.greatest(a, b, c) - F.least(a, b, c)) / F.abs(mean) * 100))
