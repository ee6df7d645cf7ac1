"""Point-process operators: intensities, likelihoods, residuals, fits, bootstrap and profiles.

Evaluation at given parameters is DataFrame work over legs (leg, t); estimation runs as tasks over
parameter grids and replicates. Times are always shifted to the window's start, so no integral is
inflated by the epoch. The kernel is alpha * exp(-beta t): the branching ratio is the spectral radius of
alpha / beta. Events at one time do not excite each other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ranges, sweeps
from tideline.session import shared_dir

DECAYS = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0)
BIN_WIDTHS = (60, 300, 900, 3600)
MAX_ORDER = 10
SWEPT = ("r_0", "r_1", "c_0", "c_1")
#: Events that a step over arrays works on at a time; what a task holds of a process is its times and their excitation alone.
CHUNK = 65_536
#: Events of one process that a task may hold for a fit.
MOST_EVENTS = 2_500_000


@dataclass(frozen=True)
class Params:
    """Baselines (mu0, mu1), excitation alpha[i][j] of leg i by leg j, and decay."""

    mu: tuple[float, float]
    alpha: tuple[tuple[float, float], tuple[float, float]]
    beta: float

    def eta(self) -> float:
        return spectral(np.array(self.alpha) / self.beta)


def spectral(m: np.ndarray) -> float:
    tr, det = float(m[0, 0] + m[1, 1]), float(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])
    d = tr * tr - 4 * det
    return (tr + math.sqrt(d)) / 2 if d >= 0 else math.sqrt(det)


# ---- evaluation in DataFrames -------------------------------------------------------------------


def faded(at: np.ndarray, n: np.ndarray, beta: float, before: float = 0.0) -> np.ndarray:
    """The excitation just before each of the increasing times at, where n events happen each: R <- exp(-beta dt) (R + n).

    `before` is the excitation just before the first of them.
    """
    if not len(at):
        return np.zeros(0)
    out, r = np.empty(len(at)), before
    out[0] = before
    for low in range(0, len(at) - 1, CHUNK):  # lists of a chunk only
        own = []
        for fade, held in zip(np.exp(-beta * np.diff(at[low : low + CHUNK + 1])).tolist(), n[low : low + CHUNK].tolist(), strict=False):
            r = fade * (r + held)
            own.append(r)
        out[low + 1 : low + 1 + len(own)] = own
    return out


def excitation(legs: DataFrame, beta: float, start: float = 0.0, range_rows: int | None = None) -> DataFrame:
    """legs with r_0, r_1: the sums of exp(-beta (t - t')) over all strictly earlier events of each leg; and
    c_0, c_1: how many of those are at or after start.

    Every distinct time is swept once (see sweeps.times()) and goes back to its rows by a join that Spark can split.
    Events at one time do not excite each other. Null times are left out.
    """
    d = legs.filter(F.col("t").isNotNull()).withColumn("_t", F.col("t").cast("double"))
    at, _ = sweeps.times(legs, beta, start, range_rows)
    return d.join(at.select(F.col("t").alias("_t"), *SWEPT), "_t").select(*legs.columns, *SWEPT)


def intensity(events: DataFrame, p: Params) -> DataFrame:
    """events with r_0, r_1 get lam, the intensity of their own leg."""
    of = lambda i: F.lit(p.mu[i]) + p.alpha[i][0] * F.col("r_0") + p.alpha[i][1] * F.col("r_1")
    return events.withColumn("lam", F.when(F.col("leg") == 0, of(0)).otherwise(of(1)))


def integral(history: DataFrame, p: Params, start: float | Column, end: float | Column) -> DataFrame:
    """One row: big_0, big_1, each leg's intensity integrated over [start, end)."""
    a, z = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    low = F.greatest(a, F.col("t"))
    part = F.when(F.col("t") < z, F.exp(-p.beta * (low - F.col("t"))) - F.exp(-p.beta * (z - F.col("t")))).otherwise(0.0)
    s = history.agg(*[F.coalesce(F.sum(F.when(F.col("leg") == k, part)), F.lit(0.0)).alias(f"s{k}") for k in (0, 1)])
    of = lambda i: p.mu[i] * (z - a) + (p.alpha[i][0] * F.col("s0") + p.alpha[i][1] * F.col("s1")) / p.beta
    return s.select(of(0).alias("big_0"), of(1).alias("big_1"))


def log_likelihood(legs: DataFrame, p: Params, end: float, start: float = 0.0) -> DataFrame:
    """One row: ll of the events in [start, end] given all history; -inf if a leg is empty or an intensity is not positive."""
    at, _ = sweeps.times(legs, p.beta)
    at = at.filter((F.col("t") >= start) & (F.col("t") <= end))
    lam = [F.lit(p.mu[i]) + p.alpha[i][0] * F.col("r_0") + p.alpha[i][1] * F.col("r_1") for i in (0, 1)]
    logs = sum((F.when((F.col(f"n_{i}") > 0) & (lam[i] > 0), F.col(f"n_{i}") * F.ln(lam[i])).otherwise(0.0) for i in (0, 1)), F.lit(0.0))
    least = F.least(*[F.min(F.when(F.col(f"n_{i}") > 0, lam[i])) for i in (0, 1)])
    s = at.agg(F.sum(logs).alias("logs"), least.alias("least"), F.sum("n_0").alias("n0"), F.sum("n_1").alias("n1"))
    bad = (F.coalesce("n0", F.lit(0)) == 0) | (F.coalesce("n1", F.lit(0)) == 0) | (F.col("least") <= 0)
    return s.crossJoin(integral(legs, p, start, end)).select(F.when(bad, F.lit(float("-inf"))).otherwise(F.col("logs") - F.col("big_0") - F.col("big_1")).alias("ll"))


def poisson_log_likelihood(legs: DataFrame, mu: Sequence[float], end: float, start: float = 0.0) -> DataFrame:
    """One row: ll = sum over legs of n ln(mu) - mu T."""
    test = legs.filter((F.col("t") >= start) & (F.col("t") <= end))
    n = test.agg(*[F.count_if(F.col("leg") == k).alias(f"n{k}") for k in (0, 1)])
    return n.select(sum((F.col(f"n{k}") * math.log(mu[k]) - mu[k] * (end - start) for k in (0, 1)), F.lit(0.0)).alias("ll"))


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder."""
    at = f"{shared_dir(df.sparkSession)}/fits/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _swept_compensator(legs: DataFrame, p: Params, start: float) -> tuple[DataFrame, sweeps.Leaves]:
    """One row a distinct time from start on: _leaf, t, n_0, n_1 and big_0, big_1, the integrated intensities up to it.

    An earlier event adds what has faded of it since the later of start and itself, so the sums are those at
    start, plus the events since, less the excitation that is left.
    """
    d = legs.select("leg", F.col("t").cast("double").alias("t"))
    old = d.filter(F.col("t") < start).agg(*[F.coalesce(F.sum(F.when(F.col("leg") == k, F.exp(-p.beta * (F.lit(float(start)) - F.col("t"))))), F.lit(0.0)).alias(f"o_{k}") for k in (0, 1)])
    at, leaves = sweeps.times(d, p.beta, start)
    e = at.filter(F.col("t") >= start).crossJoin(F.broadcast(old))
    s = [F.col(f"o_{k}") + F.col(f"c_{k}") - F.col(f"r_{k}") for k in (0, 1)]
    return e.select("_leaf", "t", "n_0", "n_1", *[(p.mu[i] * (F.col("t") - start) + (p.alpha[i][0] * s[0] + p.alpha[i][1] * s[1]) / p.beta).alias(f"big_{i}") for i in (0, 1)]), leaves


def _by_leg(at: DataFrame, *columns: str) -> DataFrame:
    """A row a leg with events of each time: leg, t, n and the leg's own of some pairs of columns."""
    of = lambda k: F.struct(F.lit(k).alias("leg"), F.col(f"n_{k}").alias("n"), *[F.col(f"{c}_{k}").alias(c) for c in columns])
    return at.select("t", F.explode(F.array(of(0), of(1))).alias("x")).filter("x.n > 0").select("x.leg", "t", "x.n", *[f"x.{c}" for c in columns])


def compensator(legs: DataFrame, p: Params, start: float = 0.0) -> DataFrame:
    """leg, t, big: the integrated intensity of its leg from start to each event at or after it.

    History before start counts. Events at the event's own time do not.
    """
    at, _ = _swept_compensator(legs, p, start)
    return _by_leg(at, "big").select("leg", "t", "big", F.explode(F.sequence(F.lit(1), F.col("n")))).select("leg", "t", "big")


def residuals(legs: DataFrame, p: Params, start: float = 0.0) -> DataFrame:
    """leg, event_time, Lambda_at_event, rescaled_dt: gaps of the compensator, null where not positive.

    Gap and event stay on one row; the first gap counts from start. (The reference drops gaps that are
    not positive and pads at the end, which moves later gaps to other events.) The compensator rises, so the last
    one before a leaf is the greatest there.
    """
    at, leaves = _swept_compensator(legs, p, start)
    if not leaves.alone:
        at = stored(at)  # read twice below
    own = [F.when(F.col(f"n_{k}") > 0, F.col(f"big_{k}")) for k in (0, 1)]
    last = at.withColumns({f"last_{k}": F.last(own[k], ignorenulls=True).over(sweeps.earlier("_leaf", order="t")) for k in (0, 1)})
    if not leaves.alone:
        ends = sweeps.before(at.groupBy("_leaf").agg(*[F.max(own[k]).alias(f"end_{k}") for k in (0, 1)]), leaves.root, tops=["end_0", "end_1"])
        last = last.join(ends, "_leaf").withColumns({f"last_{k}": F.coalesce(f"last_{k}", f"end_{k}") for k in (0, 1)})
    gaps = last.withColumns({f"dt_{k}": F.col(f"big_{k}") - F.coalesce(f"last_{k}", F.lit(0.0)) for k in (0, 1)})
    each = _by_leg(gaps, "big", "dt").select("leg", "t", "big", "dt", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return each.select(F.col("leg").cast("byte").alias("leg"), F.col("t").alias("event_time"), F.col("big").alias("Lambda_at_event"), F.when((F.col("i") == 1) & (F.col("dt") > 0), F.col("dt")).alias("rescaled_dt"))


def ks_exponential(res: DataFrame, key: str = "leg", value: str = "rescaled_dt") -> DataFrame:
    """key, n, d: the Kolmogorov-Smirnov distance of positive gaps to the unit exponential."""
    return sweeps.ks_exponential(res, key, value)


def ks_p_value(d: float, n: int) -> float:
    """P(D_n >= d), by the exact matrix power of Marsaglia, Tsang and Wang.

    The matrix grows with n d: far tails of large samples, below 0.0006, take their seven-digit formula,
    samples beyond 100,000 Kolmogorov's limit with Stephens' correction.
    """
    if not 0 < d < 1 or n < 1:
        return 1.0 if d <= 0 else 0.0
    if n > 1000 and d * d * n > 3.76:
        return 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * d * d * n)
    if n > 100_000:
        x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * (i * x) ** 2) for i in range(1, 101))))) if x > 0.2 else 1.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.tri(m, k=1)
    for i in range(m):
        a[i, 0] -= h ** (i + 1)
        a[m - 1, i] -= h ** (m - i)
    a[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    fact = np.array([[math.lgamma(i - j + 2) if i - j + 1 > 0 else 0.0 for j in range(m)] for i in range(m)])
    a = a / np.exp(fact)
    power, scale, base, bscale, e = np.eye(m), 0.0, a, 0.0, n
    while e:
        if e & 1:
            power = power @ base
            scale += bscale
        base, bscale, e = base @ base, 2 * bscale, e >> 1
        for x in (base, power):
            top = np.abs(x).max()
            if top > 1e100:
                x /= top
                if x is base:
                    bscale += math.log(top)
                else:
                    scale += math.log(top)
    s = power[k - 1, k - 1]
    if s <= 0:
        return 1.0
    log = math.log(s) + scale + math.lgamma(n + 1) - n * math.log(n)
    return float(min(1.0, max(0.0, 1 - math.exp(min(0.0, log)))))


# ---- estimation in numpy ------------------------------------------------------------------------


def fold_states(legs: Sequence[np.ndarray], beta: float) -> list[np.ndarray]:
    """For each leg an array (events x 2) of the excitation by legs 0 and 1 just before each event."""
    at = np.unique(np.concatenate(legs))
    places = [np.searchsorted(at, x).astype(np.int32) for x in legs]
    out = [np.empty((len(x), 2)) for x in legs]
    for k in (0, 1):
        r = faded(at, np.bincount(places[k], minlength=len(at)), beta)
        for place, own in zip(places, out, strict=True):
            own[:, k] = r[place]
    return out


def _chunks(n: int):
    return (slice(i, i + CHUNK) for i in range(0, n, CHUNK))


def _mass(legs: Sequence[np.ndarray], beta: float, end: float) -> np.ndarray:
    """What a unit of excitation by each leg adds to an intensity's integral."""
    return np.array([sum(float((1 - np.exp(-beta * (end - x[at]))).sum()) for at in _chunks(len(x))) for x in legs]) / beta


def _parts(states: np.ndarray, mu: float, alpha: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """The least intensity of a leg's events; the sums of its logarithms, of its inverses, and of the states over it."""
    least, logs, inverse, over = math.inf, 0.0, 0.0, np.zeros(2)
    for at in _chunks(len(states)):
        z = states[at]
        lam = mu + z @ alpha
        least = min(least, float(lam.min()))
        if least <= 0:
            return least, -math.inf, math.nan, over
        logs, inverse, over = logs + float(np.log(lam).sum()), inverse + float((1 / lam).sum()), over + (1 / lam) @ z
    return least, logs, inverse, over


#: Events up to which a likelihood is a plain loop, as a process of a few costs an array call thirty times over.
FEW = 64


def _ll_of_few(mu: np.ndarray, alpha: np.ndarray, beta: float, legs: Sequence[np.ndarray], end: float) -> float:
    times = [x.tolist() for x in legs]
    rows, base = np.asarray(alpha).tolist(), np.asarray(mu).tolist()
    exp, log = math.exp, math.log
    mass = [sum(1 - exp(-beta * (end - t)) for t in own) / beta for own in times]
    total = -sum(base[i] * end + rows[i][0] * mass[0] + rows[i][1] * mass[1] for i in (0, 1))
    r, held, last = [0.0, 0.0], [0, 0], None
    for t, k in sorted([(t, 0) for t in times[0]] + [(t, 1) for t in times[1]]):
        if t != last:
            if last is not None:
                fade = exp(-beta * (t - last))
                r = [fade * (r[0] + held[0]), fade * (r[1] + held[1])]
            held, last = [0, 0], t
        held[k] += 1
        lam = base[k] + rows[k][0] * r[0] + rows[k][1] * r[1]
        if lam <= 0:
            return -math.inf
        total += log(lam)
    return total


def ll_of(mu: np.ndarray, alpha: np.ndarray, beta: float, legs: Sequence[np.ndarray], end: float, states: list[np.ndarray] | None = None) -> float:
    """Log-likelihood over [0, end]."""
    if not len(legs[0]) or not len(legs[1]):
        return -math.inf
    if states is None and len(legs[0]) + len(legs[1]) <= FEW and beta > 0 and beta * (max(x.max() for x in legs) - end) < 600:  # the loop's exp() would raise
        return _ll_of_few(mu, alpha, beta, legs, end)
    states = states or fold_states(legs, beta)
    mass = _mass(legs, beta, end)
    total = 0.0
    for i in (0, 1):
        least, logs, *_ = _parts(states[i], mu[i], alpha[i])
        if least <= 0:
            return -math.inf
        total += float(logs - mu[i] * end - alpha[i] @ mass)
    return total


def climb(better, slopes, u: np.ndarray) -> np.ndarray:
    """The u >= 0 that maximises sum(log(z u)) - sum(u), from a positive u: Newton steps on the free part, and
    where none of those rises, a step of expectation-maximisation, which never falls and which also moves
    along what the data say nothing about.

    slopes(u) gives the value at u, the gradient and the sum of the outer products of its rows; better(tries,
    now) the first of tries above now with its value, or None.
    """
    now, g, outer = slopes(u)
    for _ in range(200):
        free = (u > 1e-9) | (g > 0)
        d = np.zeros(len(u))
        d[free] = np.linalg.lstsq(outer[np.ix_(free, free)], g[free], rcond=None)[0]
        found = better([np.maximum(u + d * 0.5**k, 0.0) for k in range(12)], now)
        if found is None or found[0] - now < 1e-9:
            found = better([u * (g + 1)], now)
        if found is None or found[0] - now < 1e-9:
            return u if found is None else found[1]
        u = found[1]
        now, g, outer = slopes(u)
    return u


def climb_array(states: np.ndarray, c: np.ndarray, u: np.ndarray) -> np.ndarray:
    """climb() over the events of a leg, in chunks, with z = (1, states) / c."""

    def value(u: np.ndarray) -> float:
        b = u / c
        return float(_parts(states, b[0], b[1:])[1] - u.sum())

    def slopes(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        g, outer = np.full(3, -1.0), np.zeros((3, 3))
        for at in _chunks(len(states)):
            z = np.column_stack([np.ones(len(states[at])), states[at]]) / c
            w = z / (z @ u)[:, None]
            g, outer = g + w.sum(axis=0), outer + w.T @ w
        return value(u), g, outer

    return climb(lambda tries, now: next(((v, t) for t in tries if (v := value(t)) > now), None), slopes, u)


def climb_swept(rows: DataFrame, leg: int, c: np.ndarray, u: np.ndarray) -> np.ndarray:
    """climb() of a leg over swept times (see swept_table()) with z = (1, r_0, r_1) / c: a pass a step for all its tries."""
    known: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}

    def look(tries: list[np.ndarray]) -> None:
        theta = np.stack([np.stack([t / c] * 2) for t in tries])
        value, grad, outer = leg_sums(rows, theta)
        for j, t in enumerate(tries):
            known[t.tobytes()] = float(value[j, leg] - t.sum()), grad[j, leg] / c - 1, outer[j, leg] / np.outer(c, c)

    def slopes(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if u.tobytes() not in known:
            look([u])
        return known[u.tobytes()]

    def better(tries: list[np.ndarray], now: float) -> tuple[float, np.ndarray] | None:
        known.clear()
        look(tries)
        return next(((known[t.tobytes()][0], t) for t in tries if known[t.tobytes()][0] > now), None)

    return climb(better, slopes, u)


def fit_beta(legs: Sequence[np.ndarray], beta: float, end: float, eta: float | None = None, rounds: int = 400, most: float = 0.999) -> dict:
    """The maximum over baselines and excitation at one decay.

    For a fixed decay the likelihood is concave and falls apart by legs; each is climbed to its top. A top
    with a branching ratio above `most` is left for expectation-maximisation, scaled back onto it after
    every step; with eta, onto eta.
    """
    states = fold_states(legs, beta)
    mass = np.maximum(_mass(legs, beta, end), 1e-300)
    n = np.array([len(legs[0]), len(legs[1])], float)
    mu, alpha = np.maximum(n / end / 2, 1e-12), np.full((2, 2), 0.25 * beta)

    if eta is not None:
        alpha = _onto(alpha, beta, eta)
    last = -math.inf
    if eta is None and n.all():
        c = np.array([end, *mass])
        tops = np.stack([climb_array(states[i], c, np.array([mu[i], *alpha[i]]) * c) / c for i in (0, 1)])
        if spectral(tops[:, 1:] / beta) <= most:
            mu, alpha, rounds = np.maximum(tops[:, 0], 1e-12), np.maximum(tops[:, 1:], 1e-12), 0
    for _ in range(rounds):
        new_mu, new_alpha = np.empty(2), np.empty((2, 2))
        for i in (0, 1):
            _, _, inverse, over = _parts(states[i], mu[i], alpha[i])
            new_mu[i] = mu[i] * inverse / end
            new_alpha[i] = alpha[i] * over / mass
        mu, alpha = np.maximum(new_mu, 1e-12), np.maximum(new_alpha, 1e-12)
        if eta is not None:
            alpha = _onto(alpha, beta, eta)
        elif spectral(alpha / beta) > most:
            alpha = _onto(alpha, beta, most)
        now = ll_of(mu, alpha, beta, legs, end, states)
        if now - last < min(1e-6, 1e-9 * max(1.0, abs(now))):
            break
        last = now
    return _fit_row(mu, alpha, beta, ll_of(mu, alpha, beta, legs, end, states))


def _fit_row(mu: np.ndarray, alpha: np.ndarray, beta: float, ll: float) -> dict:
    rho = spectral(alpha / beta)
    return {"beta": beta, "mu0": mu[0], "mu1": mu[1], "a00": alpha[0, 0], "a01": alpha[0, 1], "a10": alpha[1, 0], "a11": alpha[1, 1], "ll": ll, "aic": 2 * 7 - 2 * ll if math.isfinite(ll) else math.inf, "eta": rho, "boundary": bool(rho < 0.05 or rho > 0.95)}


FIT = "beta double, mu0 double, mu1 double, a00 double, a01 double, a10 double, a11 double, ll double, aic double, eta double, boundary boolean"
FIT_NAMES = [f.split()[0] for f in FIT.split(", ")]


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.sort(pdf.loc[pdf["leg"] == k, "t"].to_numpy(float)) for k in (0, 1)]


def _onto(alpha: np.ndarray, beta: float, limit: float) -> np.ndarray:
    """The excitation scaled to a branching ratio."""
    rho = spectral(alpha / beta)
    return alpha * (limit / rho) if rho > 0 else np.full((2, 2), limit * beta / 2)


def fit_table(legs: DataFrame, beta: float, end: float, most: float = 0.999) -> dict | None:
    """_fit_swept(), or None where a leg is empty."""
    f = _fit_swept(legs, beta, end, most)
    return f if math.isfinite(f["ll"]) else None


def _fit_swept(legs: DataFrame, beta: float, end: float, most: float = 0.999, rounds: int = 400) -> dict:
    """fit_beta() without a constraint for a process that no task should hold: its legs and its swept times are written once
    (see packed()), and each step of the climb, or of expectation-maximisation beyond `most`, is one pass over them."""
    legs = stored(legs.select("leg", F.col("t").cast("double").alias("t")).filter("t IS NOT NULL"))  # read five times below
    part = (1 - F.exp(-beta * (F.lit(float(end)) - F.col("t")))) / beta
    r = legs.agg(*[F.count_if(F.col("leg") == k) for k in (0, 1)], *[F.coalesce(F.sum(F.when(F.col("leg") == k, part)), F.lit(0.0)) for k in (0, 1)]).first()
    rows = packed(_evenly(legs, beta))
    n, c = np.array(r[:2], float), np.array([end, max(r[2], 1e-300), max(r[3], 1e-300)])
    mu, alpha = np.maximum(n / end / 2, 1e-12), np.full((2, 2), 0.25 * beta)

    def sums(mu: np.ndarray, alpha: np.ndarray) -> tuple[float, np.ndarray]:
        theta = np.column_stack([mu, alpha])
        value, grad, _ = leg_sums(rows, theta[None])
        return float(value[0].sum() - (theta @ c).sum()) if n.all() else -math.inf, grad[0]

    if n.all():
        tops = np.stack([climb_swept(rows, k, c, np.array([mu[k], *alpha[k]]) * c) / c for k in (0, 1)])
        if spectral(tops[:, 1:] / beta) <= most:
            mu, alpha, rounds = np.maximum(tops[:, 0], 1e-12), np.maximum(tops[:, 1:], 1e-12), 0
    else:
        rounds = 1  # no step changes what a leg without events says
    last, (now, grad) = -math.inf, sums(mu, alpha)
    for _ in range(rounds):
        mu, alpha = np.maximum(mu * grad[:, 0] / end, 1e-12), np.maximum(alpha * grad[:, 1:] / c[1:], 1e-12)
        if spectral(alpha / beta) > most:
            alpha = _onto(alpha, beta, most)
        now, grad = sums(mu, alpha)
        if now - last < min(1e-6, 1e-9 * max(1.0, abs(now))):
            break
        last = now
    return _fit_row(mu, alpha, beta, now)


def fit_grid(legs: DataFrame, end: float, decays: Sequence[float] = DECAYS, most_events: int = MOST_EVENTS) -> DataFrame:
    """One row a decay with its fit: a task each over the events of one process, or, beyond most_events of them,
    by passes over all tasks, which reach the same top (see _fit_swept())."""
    spark = legs.sparkSession
    if legs.count() > most_events:
        done = [_fit_swept(legs, float(b), end) for b in decays]
        return spark.createDataFrame([tuple(float(f[k]) if k != "boundary" else f[k] for k in FIT_NAMES) for f in done], FIT)
    each = legs.select("leg", "t").crossJoin(F.broadcast(spark.createDataFrame([(float(b),) for b in decays], "g double")))
    return each.groupBy("g").applyInPandas(lambda pdf: pd.DataFrame([fit_beta(_arrays(pdf), float(pdf["g"].iloc[0]), end)]), FIT)


def best(fits: DataFrame) -> DataFrame:
    """The row of least AIC, the smaller decay on ties."""
    return fits.orderBy("aic", "beta").limit(1)


def inar(legs: Sequence[np.ndarray], end: float, width: float, max_order: int = MAX_ORDER, order: int | None = None) -> dict:
    """Bivariate autoregression of bin counts; see inar_of_counts()."""
    edges = np.arange(max(1, math.ceil(end / width)) + 1) * width
    return inar_of_counts(np.stack([np.histogram(x, edges)[0] for x in legs], axis=1).astype(float), width, max_order, order)


def inar_of_counts(y: np.ndarray, width: float, max_order: int = MAX_ORDER, order: int | None = None) -> dict:
    """Bivariate autoregression by least squares: order by AIC, negative coefficients to zero."""
    bins = len(y)
    if y.std(axis=0).min() < 1e-12:
        return {"p": 0, "width": float(width), "coefs": [], "intercept": y.mean(axis=0).tolist(), "aic": math.inf, "bins": bins, "negative": False}
    cap = max(1, min(max_order, bins // 3))

    def fit(p: int, skip: int):
        rows = len(y) - skip
        x = np.hstack([np.ones((rows, 1)), *[y[skip - j : len(y) - j] for j in range(1, p + 1)]])
        b, *_ = np.linalg.lstsq(x, y[skip:], rcond=None)
        e = y[skip:] - x @ b
        det = np.linalg.det(e.T @ e / rows)
        return b, (math.log(det) if det > 0 else -math.inf) + 2 * (4 * p + 2) / rows

    p = order or min(range(1, cap + 1), key=lambda q: fit(q, cap)[1])
    b, aic = fit(p, p)
    a = b[1:].reshape(p, 2, 2).transpose(0, 2, 1)
    return {"p": p, "width": float(width), "coefs": np.maximum(a, 0).tolist(), "intercept": np.maximum(b[0], 0).tolist(), "aic": aic, "bins": bins, "negative": bool((a < 0).any())}


def lag_sums(counts: DataFrame, lags: int) -> DataFrame:
    """g, d, p00, p01, p10, p11: over the bins i of each width g, the sums of y_a(i) y_b(i + d) for d up to `lags`.

    counts has g, i, y_0, y_1 of the bins that hold events; each goes to the lags of its later neighbours by an
    equal join on the bin, so work follows the events and no task holds a width.
    """
    ahead = counts.select("g", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("d"), "i", F.col("y_0").alias("a_0"), F.col("y_1").alias("a_1")).withColumn("i", F.col("i") + F.col("d"))
    return ahead.join(counts, ["g", "i"]).groupBy("g", "d").agg(*[F.sum(F.col(f"a_{a}") * F.col(f"y_{b}")).alias(f"p{a}{b}") for a in (0, 1) for b in (0, 1)])


class _Gram:
    """Sums of products of a width's counts and their lags over the bins from `skip` on, from sums over all bins and its ends."""

    def __init__(self, bins: int, lags: int, total: np.ndarray, sums: dict[int, np.ndarray], ends: dict[int, np.ndarray]):
        self.bins, self.lags, self.total, self.sums, self.ends = bins, lags, total, sums, ends

    def _at(self, i: int) -> np.ndarray:
        return self.ends.get(i, np.zeros(2))

    def product(self, j: int, k: int, skip: int) -> np.ndarray:
        """The 2 x 2 sums of y(t - j) y(t - k)' over skip <= t < bins, for j >= k."""
        d = j - k
        out = self.sums.get(d, np.zeros((2, 2))).copy()
        for i in (*range(0, skip - j), *range(self.bins - j, self.bins - d)):  # what begins before or ends after
            out -= np.outer(self._at(i), self._at(i + d))
        return out

    def single(self, j: int, skip: int) -> np.ndarray:
        out = self.total.copy()
        for i in (*range(0, skip - j), *range(self.bins - j, self.bins)):
            out -= self._at(i)
        return out

    def fit(self, p: int, skip: int) -> tuple[np.ndarray, float]:
        """Coefficients, (1 + 2 p) x 2, and criterion of order p over the bins from skip on."""
        n, size = self.bins - skip, 1 + 2 * p
        g, h = np.zeros((size, size)), np.zeros((size, 2))
        g[0, 0], h[0] = n, self.single(0, skip)
        for j in range(1, p + 1):
            at = slice(2 * j - 1, 2 * j + 1)
            g[0, at] = g[at, 0] = self.single(j, skip)
            h[at] = self.product(j, 0, skip)
            for k in range(1, j + 1):
                m = self.product(j, k, skip)
                g[at, 2 * k - 1 : 2 * k + 1], g[2 * k - 1 : 2 * k + 1, at] = m, m.T
        b, *_ = np.linalg.lstsq(g, h, rcond=None)
        e = self.product(0, 0, skip) - b.T @ h
        det = np.linalg.det((e + e.T) / (2 * n))
        return b, (math.log(det) if det > 0 else -math.inf) + 2 * (4 * p + 2) / n


def inar_grid(legs: DataFrame, end: float, widths: Sequence[int] = BIN_WIDTHS, order: int | None = None, max_order: int = MAX_ORDER) -> DataFrame:
    """width, p, aic, bins, negative, mu0, mu1, intercept, and coefs, the rows of each lag's matrix.

    Bivariate autoregressions of bin counts by least squares, the order by AIC on the same bins for all orders.
    Spark sums the products of counts at each lag once a width; all orders' normal equations are parts of one
    matrix of 23 x 23 made of those sums and of the first and last bins. Negative coefficients go to zero; a leg
    without variation gives order 0. An order beyond a third of the bins is cut to that.
    """
    spark = legs.sparkSession
    widths = [float(w) for w in widths]
    grid = F.broadcast(spark.createDataFrame([(w, max(1, math.ceil(end / w))) for w in widths], "g double, bins long"))
    inside = legs.select("leg", "t").filter((F.col("t") >= 0) & (F.col("t") <= float(end))).crossJoin(grid)
    at = F.least(F.floor(F.col("t") / F.col("g")), F.col("bins") - 1).cast("long")
    counted = inside.groupBy("g", "bins", at.alias("i")).agg(*[F.count_if(F.col("leg") == k).cast("double").alias(f"y_{k}") for k in (0, 1)])
    path = f"{shared_dir(spark)}/fits/{uuid.uuid4().hex}"
    counted.write.parquet(path)  # the bins that hold events, once
    counts = spark.read.parquet(path)
    near = (F.col("i") < 2 * max_order) | (F.col("i") >= F.col("bins") - 2 * max_order)
    ends = {(r["g"], r["i"]): np.array([r["y_0"], r["y_1"]]) for r in counts.filter(near).collect()}  # 40 bins a width at most
    totals = {r["g"]: np.array([r["a"], r["b"]]) for r in counts.groupBy("g").agg(F.sum("y_0").alias("a"), F.sum("y_1").alias("b")).collect()}
    sums: dict[float, dict[int, np.ndarray]] = {w: {} for w in widths}
    for r in lag_sums(counts, max_order).collect():  # 11 rows a width
        # y(i) y(i + d)' has the later bin in its columns; as y(t - j) y(t - k)' with j - k = d
        sums[r["g"]][r["d"]] = np.array([[r["p00"], r["p01"]], [r["p10"], r["p11"]]])
    out = []
    for w in widths:
        bins = max(1, math.ceil(end / w))
        g = _Gram(bins, max_order, totals.get(w, np.zeros(2)), sums[w], {i: v for (x, i), v in ends.items() if x == w})
        mean = g.total / bins
        spread = np.diag(g.sums.get(0, np.zeros((2, 2)))) / bins - mean**2
        if spread.min() < 1e-12:
            f = {"p": 0, "width": w, "coefs": [], "intercept": mean.tolist(), "aic": math.inf, "negative": False}
        else:
            cap = max(1, min(max_order, bins // 3))
            p = min(order, cap) if order else min(range(1, cap + 1), key=lambda q: g.fit(q, cap)[1])
            b, aic = g.fit(p, p)
            a = b[1:].reshape(p, 2, 2).transpose(0, 2, 1)
            f = {"p": p, "width": w, "coefs": np.maximum(a, 0).tolist(), "intercept": np.maximum(b[0], 0).tolist(), "aic": aic, "negative": bool((a < 0).any())}
        m = mean_rate(f)
        out.append((w, int(f["p"]), float(f["aic"]), bins, f["negative"], float(m[0]), float(m[1]), f["intercept"], [r for a in f["coefs"] for r in a]))
    return spark.createDataFrame(out, "width double, p int, aic double, bins int, negative boolean, mu0 double, mu1 double, intercept array<double>, coefs array<array<double>>")


def mean_rate(f: dict) -> np.ndarray:
    """Unconditional event rates of an autoregression, a second each; the intercept's where it has no mean."""
    c = np.array(f["intercept"], float)
    m = np.eye(2) - (np.array(f["coefs"]).sum(axis=0) if f["coefs"] else 0)
    det = float(np.linalg.det(m))
    x = np.linalg.solve(m, c) if abs(det) > 1e-12 else c
    if (x <= 0).any():
        x = c
    return np.maximum(x / f["width"], 1e-12)


def _gaps(rate: float, end: float) -> int:
    """So many exponential gaps reach the end."""
    return int(rate * end + 10 * math.sqrt(rate * end) + 20)


def simulate_poisson(mu: Sequence[float], end: float, seed: int) -> list[np.ndarray]:
    """Event times of two homogeneous legs by exponential gaps."""
    rng, out = np.random.default_rng(seed), []
    for m in mu:
        t = rng.exponential(1 / m, _gaps(m, end))
        np.cumsum(t, out=t)
        out.append(t[: np.searchsorted(t, end)].copy())
    return out


def simulate_hawkes(p: Params, end: float, seed: int) -> list[np.ndarray]:
    """Event times by clusters: immigrants, then children of each event, generation by generation."""
    rng = np.random.default_rng(seed)
    born = [(i, t) for i in (0, 1) for t in rng.uniform(0, end, rng.poisson(p.mu[i] * end))]
    out: list[list[float]] = [[], []]
    while born:
        j, t = born.pop()
        out[j].append(t)
        for i in (0, 1):
            for g in rng.exponential(1 / p.beta, rng.poisson(p.alpha[i][j] / p.beta)):
                if t + g < end:
                    born.append((i, t + g))
    return [np.sort(x) for x in out]


def lr_statistic(legs: Sequence[np.ndarray], beta: float, end: float) -> float | None:
    """2 (LL of the excited model - LL of constant rates); None where a leg has fewer than ten events."""
    if min(len(legs[0]), len(legs[1])) < 10:
        return None
    flat = sum(len(x) * math.log(len(x) / end) - len(x) for x in legs)
    return max(0.0, 2 * (fit_beta(legs, beta, end)["ll"] - flat))


#: Events that a leg's arrays hold at a time while a draw is swept.
_DRAWN = 8192
#: Decay times after which the excitation of constant rates has come to its level.
_HEAD = 10.0
#: Most that the logarithms' series may leave out of a log-likelihood.
_LEFT_OUT = 1e-7
#: Orders of that series, and how many events a leg should have for each to be enough for nearly every draw.
_ORDERS = ((4, 5_000_000), (6, 50_000), (8, 10_000))


class _Arrivals:
    """A leg's times of simulate_poisson(), to the bit, some thousands at a time; rng stands where the leg's gaps begin."""

    def __init__(self, rng: np.random.Generator, rate: float, end: float):
        self.rng, self.rate, self.left = rng, rate, _gaps(rate, end)
        self.held, self.last = np.zeros(0), 0.0

    def until(self, t: float) -> np.ndarray:
        """The times before t that no call has given yet."""
        parts = [self.held]
        while self.left and self.last < t:
            x = self.rng.standard_exponential(min(self.left, _DRAWN))
            x *= 1 / self.rate
            x[0] += self.last
            np.cumsum(x, out=x)
            parts.append(x)
            self.left, self.last = self.left - len(x), float(x[-1])
        x = np.concatenate(parts)
        n = int(np.searchsorted(x, t))
        self.held = x[n:].copy()
        return x[:n]


def _earlier(legs: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
    """For the events of leg i, how many of leg j are strictly earlier: [i][j]."""
    both = np.concatenate(legs)
    order = np.argsort(both, kind="stable")
    at = both[order]
    if (at[1:] == at[:-1]).any():
        return [[np.searchsorted(x, y) for x in legs] for y in legs]
    own = [np.arange(len(x)) for x in legs]
    first = order < len(legs[0])
    return [[own[0], np.flatnonzero(first) - own[0]], [np.flatnonzero(~first) - own[1], own[1]]]


class _Late:
    """What a leg's likelihood needs of events near the level of excitation: their number, the moments of d, the share by
    which each leg's excitation is off its level, up to a total order, and the greatest |d|."""

    def __init__(self, order: int):
        self.order, self.most = order, np.zeros(2)
        self.moments = np.zeros((order + 1, order + 1))
        self.powers = np.ones((2, order + 1, 1))
        ways = np.array([[math.comb(p + q, p) for q in range(order + 1)] for p in range(order + 1)], float)
        j = np.add.outer(np.arange(order + 1), np.arange(order + 1))
        self.series = np.where((j > 0) & (j <= order), -((-1.0) ** j) * ways / np.maximum(j, 1), 0.0)
        self.last = np.where(j == order, ways, 0.0)

    def add(self, d: Sequence[np.ndarray]) -> None:
        n = len(d[0])
        if not n:
            return
        if self.powers.shape[2] < n:
            self.powers = np.ones((2, self.order + 1, n))
        a, b = (self.powers[k, :, :n] for k in (0, 1))
        for k, x in ((0, a), (1, b)):
            x[1] = d[k]
            for p in range(2, self.order + 1):
                np.multiply(x[p - 1], x[1], out=x[p])
            self.most[k] = max(self.most[k], math.sqrt(x[2].max()))
        self.moments += a @ b.T

    def logs(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of log(1 + x d) by its series, and its slopes in x."""
        k = np.arange(self.order + 1)
        v = [x[i] ** k for i in (0, 1)]
        s = [k * x[i] ** np.maximum(k - 1, 0) for i in (0, 1)]
        m = self.series * self.moments
        return float(v[0] @ m @ v[1]), np.array([s[0] @ m @ v[1], v[0] @ m @ s[1]])

    def left_out(self, x: np.ndarray) -> float:
        """A bound of what the series leaves out of the sum at x >= 0."""
        far, k = float(x @ self.most), np.arange(self.order + 1)
        if far >= 1:
            return math.inf
        return far * float((x[0] ** k) @ (self.last * self.moments) @ (x[1] ** k)) / ((self.order + 1) * (1 - far) ** (self.order + 1))


def _top_of_draw(early: np.ndarray, late: _Late, level: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, float]:
    """climb_array()'s top of a leg as (mu, a0, a1), how far it lies above constant rates, and the most that this can be off.

    Early events have their excitation in rows. For the others lam = (mu + a level) (1 + x d), and the even order of the series keeps
    it concave. As the likelihood is concave too, a top where the series leaves nothing out is the top.
    """
    n = len(early) + late.moments[0, 0]
    z = np.column_stack([np.ones(len(early)), early])
    turn = np.array([[1, 0, 0], [level[0], level[0], 0], [level[1], 0, level[1]]])
    m = late.moments
    second = turn @ np.array([[m[0, 0], m[1, 0], m[0, 1]], [m[1, 0], m[2, 0], m[1, 1]], [m[0, 1], m[1, 1], m[0, 2]]]) @ turn.T

    def share(b: np.ndarray) -> tuple[float, np.ndarray]:
        base = float(b[0] + b[1:] @ level)
        return base, b[1:] * level / base

    def value(u: np.ndarray) -> float:
        b = u / c
        lam = z @ b
        if not b.any() or len(lam) and lam.min() <= 0:
            return -math.inf
        base, x = share(b)
        return m[0, 0] * math.log(base * c[0] / n) + late.logs(x)[0] + float(np.log(lam * (c[0] / n)).sum()) - float(u.sum() - n)

    def slopes(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        b = u / c
        base, x = share(b)
        by = late.logs(x)[1]
        rest = (m[0, 0] - x @ by) / base
        w = z / (z @ b)[:, None]
        g = np.array([rest, *(level * (rest + by / base))]) + w.sum(axis=0)
        return value(u), g / c - 1, (second / base**2 + w.T @ w) / np.outer(c, c)

    u = climb(lambda tries, now: next(((v, t) for t in tries if (v := value(t)) > now), None), slopes, n * np.array([0.98, 0.01, 0.01]))
    return u / c, value(u), late.left_out(share(u / c)[1])


def _null_by_moments(mu: Sequence[float], beta: float, end: float, seed: int, order: int) -> float | None:
    """lr_statistic() of a draw of simulate_poisson() that is swept in windows and not held; None where that is not sure to be it.

    Around the level of constant rates, the moments of the excitation say all that a likelihood does: the top's
    intensities vary the less, the more events there are. Events before the level is reached keep their rows.
    """
    skipped = np.random.default_rng(seed)
    for left in range(_gaps(mu[0], end), 0, -CHUNK):
        skipped.standard_exponential(min(left, CHUNK))
    arrivals = [_Arrivals(np.random.default_rng(seed), mu[0], end), _Arrivals(skipped, mu[1], end)]
    level, n, held = np.array(mu) / beta, np.zeros(2, int), np.zeros(2)
    early: list[list[np.ndarray]] = [[], []]
    late = [_Late(order), _Late(order)]
    width = min(sweeps.EXPONENT / beta, 2 * _DRAWN / sum(mu))
    for i in range(math.ceil(end / width)):
        low, high = i * width, min((i + 1) * width, end)
        legs = [a.until(high) for a in arrivals]
        grown = [np.exp(beta * (x - low)) for x in legs]
        run = [np.concatenate([[held[k]], grown[k]]).cumsum() for k in (0, 1)]
        for k, before in enumerate(_earlier(legs)):
            r = [run[j][before[j]] / grown[k] for j in (0, 1)]
            cut = int(np.searchsorted(legs[k], _HEAD / beta))
            if cut:
                early[k].append(np.column_stack(r)[:cut])
            late[k].add([x[cut:] / level[j] - 1 for j, x in enumerate(r)])
            n[k] += len(legs[k])
        held = np.array([x[-1] for x in run]) * math.exp(-beta * (high - low))
    if n.min() < 10:
        return None
    c = np.array([end, *(n - held) / beta])
    tops = [_top_of_draw(np.concatenate(early[k]) if early[k] else np.zeros((0, 2)), late[k], level, c) for k in (0, 1)]
    if sum(t[2] for t in tops) > _LEFT_OUT or spectral(np.stack([t[0][1:] for t in tops]) / beta) > 0.999:
        return None
    return max(0.0, 2 * sum(t[1] for t in tops))


def null_statistic(mu: Sequence[float], beta: float, end: float, seed: int) -> float | None:
    """lr_statistic() of simulate_poisson(); a draw of many events at a high level of excitation, seen over many decay times, is not held."""
    if min(mu) >= beta and beta * end >= 10 * _HEAD:
        for order, events in _ORDERS:
            if min(mu) * end >= events and (found := _null_by_moments(mu, beta, end, seed, order)) is not None:
                return found
    return lr_statistic(simulate_poisson(mu, end, seed), beta, end)


def bootstrap(legs: DataFrame, beta: float, end: float, reps: int, seed: int) -> DataFrame:
    """rep, stat: likelihood-ratio statistics; rep 0 is the observed, the others are drawn from the fitted null.

    Each replicate is fitted in full, so no statistic is negative; degenerate draws are null.
    """
    spark = legs.sparkSession
    n = {r["leg"]: r["n"] for r in legs.groupBy("leg").agg(F.count("*").alias("n")).collect()}
    mu = [max(n.get(k, 0), 1) / end for k in (0, 1)]

    def draw(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["id"], "stat": pd.array([null_statistic(mu, beta, end, seed + int(r)) for r in pdf["id"]], dtype="Float64")})

    null = spark.range(1, reps + 1, 1, max(1, min(reps, spark.sparkContext.defaultParallelism * 8))).mapInPandas(draw, "rep long, stat double")
    if sum(n.values()) > MOST_EVENTS and min(n.get(k, 0) for k in (0, 1)) >= 10:
        flat = sum(n[k] * math.log(n[k] / end) - n[k] for k in (0, 1))
        return spark.createDataFrame([(0, max(0.0, 2 * (_fit_swept(legs, beta, end)["ll"] - flat)))], "rep long, stat double").unionByName(null)
    seen = legs.select("leg", "t", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda pdf: pd.DataFrame({"rep": [0], "stat": pd.array([lr_statistic(_arrays(pdf), beta, end)], dtype="Float64")}), "rep long, stat double")
    return seen.unionByName(null)


def bootstrap_test(draws: DataFrame, alpha: float = 0.01) -> DataFrame:
    """One row: observed, p_value, n_ok, n_failed, rejects."""
    s = draws.agg(F.max(F.when(F.col("rep") == 0, F.col("stat"))).alias("observed"), F.array_compact(F.collect_list(F.when(F.col("rep") > 0, F.col("stat")))).alias("null"), F.count_if(F.col("rep") > 0).alias("reps"))
    p = F.size(F.filter("null", lambda x: x >= F.col("observed"))) / F.nullif(F.size("null"), F.lit(0))
    return s.select("observed", p.alias("p_value"), F.size("null").alias("n_ok"), (F.col("reps") - F.size("null")).alias("n_failed"), (p < alpha).alias("rejects"))


ETA_GRID = (0.0, *np.linspace(1e-3, 0.95, 40).tolist())
#: Step lengths that a pass tries at once: along the Newton direction, then along the gradient over its curvature.
_TRIES = ((1.0, 0.25, 1 / 64), (1.0,))
#: Intensities that a pass works on at a time, so that they stay in a core's cache.
_PASS_NUMBERS = 1 << 16
#: A climb ends where a step gains no more than this in log-likelihood.
SETTLED = 1e-5


_SUMMED = ("n_0", "n_1", "r_0", "r_1")


def packed(rows: DataFrame) -> DataFrame:
    """Swept times for leg_sums(), written once, with a batch's numbers in a row: most of a pass over single ones was their way to the workers."""

    def pack(batches):
        for x in batches:
            if len(x):
                yield pd.DataFrame({c: [x[c].to_numpy(float).tobytes()] for c in _SUMMED})

    return stored(rows.select(*_SUMMED).mapInPandas(pack, ", ".join(f"{c} binary" for c in _SUMMED)))


def _arrays_of(batches):
    """The numbers of swept times in Arrow batches, packed() or not; those of packed ones are not copied."""
    for x in batches:
        if pa.types.is_binary(x.schema.field(0).type):
            for i in range(x.num_rows):
                yield {c: np.frombuffer(x.column(c)[i].as_buffer()) for c in _SUMMED}
        else:
            yield {c: x.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _SUMMED}


def leg_sums(rows: DataFrame, tries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For m tries of both legs' (mu, a0, a1), in an array m x 2 x 3: the sums over swept times (see sweeps.times()) of
    n ln(lam), m x 2; of its slopes, m x 2 x 3; and of the outer products of its slopes, m x 2 x 3 x 3.

    One pass for all tries: each step is a product of some rows with the tries, each task sends twenty sums a try.
    rows may be packed().
    """
    m = len(tries)
    step = max(64, _PASS_NUMBERS // m)

    def part(batches):
        total = np.zeros((m, 2, 10))
        for whole in _arrays_of(batches):
            every = np.column_stack([np.ones(len(whole["r_0"])), whole["r_0"], whole["r_1"]])
            for k in (0, 1):
                held = whole[f"n_{k}"]
                all_z, all_n = every[held > 0], held[held > 0]
                for i in range(0, len(all_n), step):
                    z, n = all_z[i : i + step], all_n[i : i + step]
                    lam = z @ tries[:, k].T
                    pairs = np.column_stack([z[:, i] * z[:, j] for i in range(3) for j in range(i + 1)])
                    if lam.min() > 0:
                        w = n[:, None] / lam
                        total[:, k, 1:4] += w.T @ z
                        w /= lam
                        total[:, k, 4:] += w.T @ pairs
                        total[:, k, 0] += n @ np.log(lam, out=lam)
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        total[:, k, 0] += np.where(lam > 0, n[:, None] * np.log(np.maximum(lam, 1e-300)), -np.inf).sum(axis=0)
                        w = np.where(lam > 0, n[:, None] / lam, 0.0)
                        total[:, k, 1:4] += w.T @ z
                        total[:, k, 4:] += np.where(lam > 0, w / lam, 0.0).T @ pairs
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size, dtype=np.int32), "x": total.ravel()})

    got = rows.select(*_SUMMED).mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(m * 20)
    for r in got:
        total[r["i"]] = r["x"]
    total = total.reshape(m, 2, 10)
    outer = np.zeros((m, 2, 3, 3))
    for c, (i, j) in enumerate((i, j) for i in range(3) for j in range(i + 1)):
        outer[:, :, i, j] = outer[:, :, j, i] = total[:, :, 4 + c]
    return total[:, :, 0], total[:, :, 1:4], outer


class _Free:
    """The unconstrained problem: both legs' rates themselves, none below zero."""

    low, high, reach = np.zeros(6), np.full(6, np.inf), np.full(6, np.inf)

    def theta(self, y: np.ndarray) -> np.ndarray:
        return y.reshape(2, 3)

    def inside(self, y: np.ndarray) -> np.ndarray:
        return np.maximum(y, 0.0)

    def jacobian(self, y: np.ndarray) -> np.ndarray:
        return np.eye(6).reshape(2, 3, 6)


class _OnEta:
    """Rates whose branching ratio is eta, by five numbers: log baselines, two shares and the log of x.

    A matrix with no negative entry has the spectral radius c where it takes some positive (1, x) to c times itself:
    a00 + a01 x = c and a10 + a11 x = c x. s and q are the shares of the first terms, so the constraint holds for
    every choice and what is left is a climb within a box.
    """

    low, high, reach = np.array([-60.0, -60, 0, 0, -20]), np.array([20.0, 20, 1, 1, 20]), np.array([2.0, 2, 1, 1, 2])

    def __init__(self, c: float):
        self.c = c

    def theta(self, y: np.ndarray) -> np.ndarray:
        (a, b), (s, q), x, c = np.exp(y[:2]), y[2:4], math.exp(y[4]), self.c
        return np.array([[a, c * s, c * (1 - s) / x], [b, c * x * q, c * (1 - q)]])

    def inside(self, y: np.ndarray) -> np.ndarray:
        return np.clip(y, self.low, self.high)

    def jacobian(self, y: np.ndarray) -> np.ndarray:
        (a, b), (s, q), x, c = np.exp(y[:2]), y[2:4], math.exp(y[4]), self.c
        return np.array([
            [[a, 0, 0, 0, 0], [0, 0, c, 0, 0], [0, 0, -c / x, 0, -c * (1 - s) / x]],
            [[0, b, 0, 0, 0], [0, 0, 0, c * x, c * x * q], [0, 0, 0, -c, 0]],
        ])


class _NearEdge:
    """The same rates by log baselines, a01, a11 and x itself, which stay plain numbers where x goes to zero and the
    matrix falls apart; there shares of a vanishing term say nothing. With `swap`, the legs' parts are exchanged."""

    reach = np.array([2.0, 2, np.inf, np.inf, np.inf])

    def __init__(self, c: float, swap: bool):
        self.c, self.swap = c, swap
        self.low, self.high = np.array([-60.0, -60, 0, 0, 0]), np.array([20.0, 20, np.inf, c, 1e6])

    def _turned(self, x: np.ndarray) -> np.ndarray:
        return x[::-1][:, [0, 2, 1]] if self.swap else x

    def at(self, theta: np.ndarray, x: float) -> np.ndarray:
        """The numbers of some rates with their x."""
        t = self._turned(theta)
        return np.array([*np.log(t[:, 0]), t[0, 2], t[1, 2], 1 / x if self.swap else x])

    def theta(self, y: np.ndarray) -> np.ndarray:
        (a, b), (p, q, x), c = np.exp(y[:2]), y[2:], self.c
        return self._turned(np.array([[a, max(c - p * x, 0.0), p], [b, (c - q) * x, q]]))

    def inside(self, y: np.ndarray) -> np.ndarray:
        y = np.clip(y, self.low, self.high)
        y[2] = min(y[2], self.c / max(y[4], 1e-300))
        return y

    def jacobian(self, y: np.ndarray) -> np.ndarray:
        (a, b), (p, q, x), c = np.exp(y[:2]), y[2:], self.c
        return self._turned(np.array([
            [[a, 0, 0, 0, 0], [0, 0, -x, 0, -p], [0, 0, 1, 0, 0]],
            [[0, b, 0, 0, 0], [0, 0, 0, -x, c - q], [0, 0, 0, 1, 0]],
        ]))


def climb_all(rows: DataFrame, problems: list, starts: list[np.ndarray], cost: np.ndarray, passes: int = 40) -> list[tuple[float, np.ndarray]]:
    """The best value and point that each problem reaches from its start: one pass over the rows a step, for all of them.

    cost: what a unit of (mu, a0, a1) takes from the log-likelihood. Steps use the outer products for the
    curvature; a pass tries several lengths at once, so it also has the slopes of the point that is taken.
    """
    now: list[tuple[float, np.ndarray]] = [(-math.inf, y) for y in starts]
    slopes: list = [None] * len(problems)
    left, tries = list(range(len(problems))), {i: [y] for i, y in enumerate(starts)}
    for _ in range(passes):
        flat = [(i, y) for i in left for y in tries[i]]
        if not flat:
            break
        theta = np.array([problems[i].theta(y) for i, y in flat])
        value, grad, outer = leg_sums(rows, theta)
        value = value.sum(axis=1) - (theta @ cost).sum(axis=1)
        best: dict[int, int] = {}
        for j, (i, _) in enumerate(flat):
            if i not in best or value[j] > value[best[i]]:
                best[i] = j
        left = []
        for i, j in best.items():
            gain = value[j] - now[i][0]
            if not gain > 0:
                continue
            now[i] = (float(value[j]), flat[j][1])
            jac = problems[i].jacobian(flat[j][1])
            slopes[i] = (np.einsum("kap,ka->p", jac, grad[j] - cost), np.einsum("kap,kab,kbq->pq", jac, outer[j], jac))
            if gain > SETTLED:
                left.append(i)
        tries = {i: _steps(problems[i], now[i][1], *slopes[i]) for i in left}
    return now


def _steps(problem, y: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    free = ~(((y <= problem.low) & (g < 0)) | ((y >= problem.high) & (g > 0)))
    out = []
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    newton, plain = np.zeros(len(y)), np.zeros(len(y))
    if free.any():
        f = np.ix_(free, free)
        newton[free] = np.linalg.lstsq(h[f] / np.outer(scale[free], scale[free]) + 1e-12 * np.eye(int(free.sum())), g[free] / scale[free], rcond=None)[0] / scale[free]
        plain[free] = g[free] / scale[free] ** 2
    for d, lengths in zip((newton, plain), _TRIES, strict=True):
        d = np.clip(d, -problem.reach, problem.reach)
        out += [problem.inside(y + k * d) for k in lengths]
    return out


def swept_table(legs: DataFrame, beta: float) -> DataFrame:
    """The distinct times of both legs with their excitation, written once to the shared folder, evenly over all cores."""
    return stored(_evenly(legs, beta))


def _evenly(legs: DataFrame, beta: float) -> DataFrame:
    swept, leaves = sweeps.times(legs, beta)
    files = max(legs.sparkSession.sparkContext.defaultParallelism, math.ceil(leaves.rows / ranges.RANGE_ROWS))
    return swept.select("t", *_SUMMED).repartition(files, "t")


def _on_etas(rows: DataFrame, radii: list[float], starts: list[np.ndarray], cost: np.ndarray) -> list[float]:
    """The best likelihood on each spectral radius, of two starts each: by shares, then from there by _NearEdge both ways."""
    shares = [_OnEta(c) for c in radii]
    first = climb_all(rows, shares, starts, cost)
    best = [max((2 * i, 2 * i + 1), key=lambda j: first[j][0]) for i in range(len(radii) // 2)]
    edges = [(_NearEdge(radii[j], swap), shares[j].theta(first[j][1]), math.exp(first[j][1][4])) for j in best for swap in (False, True)]
    then = climb_all(rows, [p for p, *_ in edges], [p.inside(p.at(theta, x)) for p, theta, x in edges], cost)
    return [max(first[j][0], then[2 * i][0], then[2 * i + 1][0]) for i, j in enumerate(best)]


def profile(legs: DataFrame, beta: float, end: float, etas: Sequence[float] = ETA_GRID) -> DataFrame:
    """eta, ll: the likelihood maximised at each branching ratio; eta null: without constraint, with its ratio in eta_hat.

    No task holds the process: its swept times are written once, and each step of the climb is one pass over them
    for all ratios together (see climb_all()). A top beyond 0.999 is not stationary; the best of the grid
    stands for it. A process with an empty leg has ll -inf at every ratio.
    """
    spark, rows = legs.sparkSession, swept_table(legs, beta)
    part = (1 - F.exp(-beta * (F.lit(float(end)) - F.col("t")))) / beta
    r = rows.agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)) for k in (0, 1)], *[F.coalesce(F.sum(F.col(f"n_{k}") * part), F.lit(0.0)) for k in (0, 1)]).first()
    n, cost = np.array(r[:2], float), np.array([end, max(r[2], 1e-300), max(r[3], 1e-300)])
    schema = "eta double, ll double, eta_hat double"
    if not n.all():
        return spark.createDataFrame([(float(e), -math.inf, 0.0) for e in etas] + [(None, -math.inf, 0.0)], schema)
    flat = float((n * np.log(n / end) - n).sum())
    (top, y), *_ = climb_all(rows, [_Free()], [np.concatenate([[n[k] / end / 2, 0.25 * beta, 0.25 * beta] for k in (0, 1)])], cost)
    a = y.reshape(2, 3)[:, 1:]
    hat = spectral(a / beta)
    values, vectors = np.linalg.eig(np.maximum(a, 1e-9 * beta))
    v = np.abs(vectors[:, int(np.argmax(values.real))].real)
    x = float(np.clip(v[1] / max(v[0], 1e-12), 1e-6, 1e6))
    share = lambda first, second: float(np.clip(first / max(first + second, 1e-300), 0.01, 0.99))
    near = [share(a[0, 0], a[0, 1] * x), share(a[1, 0], a[1, 1] * x), math.log(x)]
    wanted = [float(e) for e in etas if e > 0]
    rates = lambda e: np.log(n / end * max(0.05, 1 - e))
    starts = [np.array([*rates(e), *tail]) for e in wanted for tail in (near, [0.5, 0.5, 0.0])]
    of = dict(zip(wanted, _on_etas(rows, [e * beta for e in wanted for _ in (0, 1)], starts, cost), strict=True))
    of |= {float(e): flat for e in etas if e <= 0}
    if hat > 0.999:
        hat, top = max(of, key=of.get), max(of.values())
    return spark.createDataFrame([(float(e), of[float(e)], hat) for e in etas] + [(None, top, hat)], schema)


def profile_interval(rows: DataFrame, alpha: float = 0.05, wide: float = 0.4) -> DataFrame:
    """One row: eta_hat, lower, upper, width, too_wide: where 2 (max - ll) stays below the chi-square bound.

    The estimate is a point of the grid too, so the interval holds it; crossings are interpolated between points.
    Where the likelihood never falls below the bound on a side, that end is the grid's.
    """
    bound = NormalDist().inv_cdf(1 - alpha / 2) ** 2
    top = rows.filter("eta IS NULL").select(F.col("ll").alias("top"), "eta_hat")
    d = rows.filter("eta IS NOT NULL").select("eta", "ll").unionByName(top.select(F.col("eta_hat").alias("eta"), F.col("top").alias("ll"))).groupBy("eta").agg(F.max("ll").alias("ll")).crossJoin(F.broadcast(top)).withColumn("d", 2 * (F.greatest("top", "ll") - F.col("ll")) - bound)
    w = Window.partitionBy(F.lit(0)).orderBy("eta")
    e = d.withColumns({"pe": F.lag("eta").over(w), "pd": F.lag("d").over(w)})
    cross = F.col("pe") + (F.col("eta") - F.col("pe")) * F.col("pd") / (F.col("pd") - F.col("d"))
    s = e.agg(
        F.first("eta_hat").alias("eta_hat"),
        F.min(F.when((F.col("pd") > 0) & (F.col("d") <= 0), cross)).alias("down"),
        F.max(F.when((F.col("pd") <= 0) & (F.col("d") > 0), cross)).alias("up"),
        F.min(F.when(F.col("d") <= 0, F.col("eta"))).alias("least"), F.max(F.when(F.col("d") <= 0, F.col("eta"))).alias("most"),
    )
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(0.999), x))
    lower, upper = clamp(F.coalesce("down", "least", "eta_hat")), clamp(F.coalesce("up", "most", "eta_hat"))
    return s.select("eta_hat", lower.alias("lower"), upper.alias("upper"), (upper - lower).alias("width"), ((upper - lower) > wide).alias("too_wide"))
