"""Mixtures of asymmetric Laplace distributions, as column expressions over parameter arrays (mu, b, tau, pi).

Everything here is built from higher-order functions, so it stays in the JVM; sampling, which needs a generator, is in
:func:`sample` as an Arrow pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
_EDGE = 1e-6


def components(mu: str = "mu", b: str = "b", tau: str = "tau", pi: str = "pi") -> Column:
    """The mixture as one array of structs."""
    return F.arrays_zip(F.col(mu).alias("mu"), F.col(b).alias("b"), F.col(tau).alias("tau"), F.col(pi).alias("pi"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def component_cdf(x: Column, c: Column) -> Column:
    z = (x - c["mu"]) / c["b"]
    return F.when(x > c["mu"], 1 - (1 - c["tau"]) * F.exp(-c["tau"] * z)).otherwise(c["tau"] * F.exp((1 - c["tau"]) * z))


def component_pdf(x: Column, c: Column) -> Column:
    z = (x - c["mu"]) / c["b"]
    return c["tau"] * (1 - c["tau"]) / c["b"] * F.exp(F.when(x > c["mu"], -c["tau"] * z).otherwise((1 - c["tau"]) * z))


def component_ppf(q: Column, c: Column) -> Column:
    low = c["mu"] + c["b"] / (1 - c["tau"]) * F.ln(q / c["tau"])
    high = c["mu"] - c["b"] / c["tau"] * F.ln((1 - q) / (1 - c["tau"]))
    return F.when(q <= c["tau"], low).otherwise(high)


def cdf(x: Column, mixture: Column) -> Column:
    return _sum(F.transform(mixture, lambda c: c["pi"] * component_cdf(x, c)))


def pdf(x: Column, mixture: Column) -> Column:
    return _sum(F.transform(mixture, lambda c: c["pi"] * component_pdf(x, c)))


def mean(mixture: Column) -> Column:
    def one(c: Column) -> Column:
        t = F.least(F.greatest(c["tau"], F.lit(_EDGE)), F.lit(1 - _EDGE))
        return c["pi"] * (c["mu"] + c["b"] * (1 - 2 * t) / (t * (1 - t)))

    return _sum(F.transform(mixture, one))


def quantile(q: float, mixture: Column, iterations: int = 10, epsilon: float = 1e-6, confine: float = 0.8) -> Column:
    """Newton's search from the mean of the components' quantiles, held between 0.8 times their least and greatest."""
    p = F.lit(float(q))

    def search(ppfs: Column) -> Column:
        low, high = confine * F.array_min(ppfs), confine * F.array_max(ppfs)

        def step(k: Column, _: Column) -> Column:
            new = k - (cdf(k, mixture) - p) / (pdf(k, mixture) + epsilon)
            return F.least(F.greatest(new, low), high)

        return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), _sum(ppfs) / F.size(ppfs), step)

    return F.get(F.transform(F.array(F.transform(mixture, lambda c: component_ppf(p, c))), search), F.lit(0))


def predictions(mixture: Column) -> Column:
    """Array of the mean and the nine deciles."""
    return F.array(mean(mixture), *[quantile(q, mixture) for q in QUANTILES])


def log_likelihood(y: Column, mixture: Column) -> Column:
    """log sum of the components' densities, with 1e-8 added to the weights, through the greatest term."""
    def one(c: Column) -> Column:
        e = (y - c["mu"]) / c["b"]
        loss = F.ln(c["tau"]) + F.ln(1 - c["tau"]) - F.ln(c["b"]) - F.greatest(c["tau"] * e, (c["tau"] - 1) * e)
        return F.ln(c["pi"] + 1e-8) + loss

    terms = F.transform(mixture, one)
    return F.get(F.transform(F.array(terms), lambda t: F.array_max(t) + F.ln(_sum(F.transform(t, lambda x: F.exp(x - F.array_max(t)))))), F.lit(0))


# --- sampling -------------------------------------------------------------------------------------------------------

NEGATIVE = ("none", "clip", "truncate")


def laplace_inverse(u: np.ndarray, mu: np.ndarray, b: np.ndarray, tau: np.ndarray) -> np.ndarray:
    tau = np.clip(tau, _EDGE, 1 - _EDGE)
    with np.errstate(divide="ignore"):
        return np.where(u < tau, mu + b / (1 - tau) * np.log(u / tau), mu - b / tau * np.log((1 - u) / (1 - tau)))


def draw(rng: np.random.Generator, mu, b, tau, pi, n: int, negative: str = "none", zero: float = 0.0, retries: int = 5) -> np.ndarray:
    """n draws of each row's mixture (arrays rows x components); NaN parameters give NaN draws.

    Draws below ``zero`` are kept, set to it, or drawn again up to ``retries`` times and then set to it.
    """
    if negative not in NEGATIVE:
        raise NotImplementedError(f"negative handling {negative!r}")
    mu, b, tau, pi = (np.asarray(x, float) for x in (mu, b, tau, pi))
    lost = np.isnan(pi).any(axis=1)
    weights = np.where(lost[:, None], 1 / pi.shape[1], pi)
    edges = np.cumsum(weights / weights.sum(axis=1, keepdims=True), axis=1)

    def once(rows: np.ndarray, k: int) -> np.ndarray:
        pick = (rng.random((len(rows), k))[:, :, None] > edges[rows][:, None, :-1]).sum(axis=2)
        at = rows[:, None]
        return laplace_inverse(rng.random((len(rows), k)), mu[at, pick], b[at, pick], tau[at, pick])

    rows = np.arange(len(mu))
    out = once(rows, n)
    if negative == "truncate":
        for _ in range(retries):
            bad = np.flatnonzero((out < zero).any(axis=1))
            if not len(bad):
                break
            out[bad] = np.where(out[bad] < zero, once(bad, n), out[bad])
    if negative != "none":
        out = np.maximum(out, zero)
    out[lost] = np.nan
    return out


def uniform(seed: int, *marks: Column) -> Column:
    """A number between 0 and 1 for each value of the marks: 52 bits of the MD5 hash of seed and marks, so it depends on nothing else."""
    text = F.concat_ws(":", F.lit(str(seed)), *[m.cast("string") for m in marks])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def component_draw(u: Column, v: Column, mixture: Column) -> Column:
    """The draw of a mixture that two uniform numbers make: ``u`` picks the component, ``v`` its value."""

    def value(c: Column) -> Column:
        tau = F.least(F.greatest(c["tau"], F.lit(_EDGE)), F.lit(1 - _EDGE))
        return _let(F.struct(v.alias("v"), c["mu"].alias("mu"), c["b"].alias("b"), tau.alias("tau")), inverse)

    def inverse(x: Column) -> Column:
        v, mu, b, tau = x["v"], x["mu"], x["b"], x["tau"]
        return F.when(v < tau, mu + b / (1 - tau) * F.ln(v / tau)).otherwise(mu - b / tau * F.ln((1 - v) / (1 - tau)))

    def picked(x: Column) -> Column:
        # components whose cumulative weight lies below u are passed over
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        step = lambda a, c: F.struct((a["sum"] + c["pi"]).alias("sum"), (a["n"] + (x > a["sum"] + c["pi"]).cast("int")).alias("n"))
        return F.get(mixture, F.least(F.aggregate(mixture, start, step, lambda a: a["n"]), F.size(mixture) - 1))

    return _let(_let(u * _sum(F.transform(mixture, lambda c: c["pi"])), picked), value)


def sample(
    df: DataFrame, n: int, seed: int = 0, into: str = "samples", negative: str = "none", zero: float = 0.0, retries: int = 5, columns: Sequence[str] = ("mu", "b", "tau", "pi"), keys: Sequence[str] = ()
) -> DataFrame:
    """``df`` with an array of n draws a row, in column expressions.

    A draw depends on the seed, the row's ``keys`` (without any: its parameters) and its number alone, not on how rows are partitioned.  Draws
    below ``zero`` are kept, set to it, or drawn again up to ``retries`` times and then set to it; a row with a missing parameter has NULL draws.
    """
    if negative not in NEGATIVE:
        raise NotImplementedError(f"negative handling {negative!r}")
    mixture = components(*columns)
    mark = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if keys else F.to_json(F.struct(*columns))
    lost = F.exists(mixture, lambda c: F.greatest(*[F.coalesce(F.isnan(c[x]) | c[x].isNull(), F.lit(True)) for x in ("mu", "b", "tau", "pi")]))

    def draws(row: Column) -> Column:
        def once(i: Column, turn: Column) -> Column:
            return component_draw(uniform(seed, row["mark"], i, turn, F.lit("u")), uniform(seed, row["mark"], i, turn, F.lit("v")), row["mixture"])

        def one(i: Column) -> Column:
            first = once(i, F.lit(0))
            if negative == "truncate" and retries:
                first = F.aggregate(F.sequence(F.lit(1), F.lit(retries)), first, lambda x, turn: F.when(x < zero, once(i, turn)).otherwise(x))
            return first if negative == "none" else F.greatest(first, F.lit(zero))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)

    none = F.array_repeat(F.lit(None).cast("double"), n)
    drawn = _let(F.struct(mark.alias("mark"), mixture.alias("mixture")), draws)
    return df.withColumn(into, F.when(F.coalesce(lost, F.lit(True)), none).otherwise(drawn))


#: Heads whose predictions are points of a mixture: drawn, or the mean and the nine deciles.
HEADS = ("cmal", "cmal_deterministic")


def points(df: DataFrame, head: str, n: int, into: str = "samples", columns: Sequence[str] = ("mu", "b", "tau", "pi"), **how) -> DataFrame:
    """``df`` with point predictions as the head gives them; ``how`` goes to :func:`sample`."""
    head = head.lower()
    if head not in HEADS:
        raise NotImplementedError(f"no point predictions for head {head!r}; there are {HEADS}")
    if head == "cmal":
        return sample(df, n, into=into, columns=columns, **how)
    return df.withColumn(into, _let(components(*columns), predictions))


# --- ensembles ------------------------------------------------------------------------------------------------------


def array_percentile(values: Column, q: float) -> Column:
    """Percentile of an array with linear interpolation; NULLs are left out."""
    def of(s: Column) -> Column:
        place = F.lit(q / 100.0) * (F.size(s) - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, a + (b - a) * (place - low))

    return F.get(F.transform(F.array(F.array_sort(F.filter(values, lambda x: x.isNotNull()))), of), F.lit(0))


def reduce_samples(values: Column, how: str = "mean") -> Column:
    """One value of an ensemble: its mean or median."""
    there = F.filter(values, lambda x: x.isNotNull())
    if how == "mean":
        return F.when(F.size(there) > 0, _sum(there) / F.size(there))
    if how == "median":
        return array_percentile(values, 50)
    raise ValueError(f"unknown reduction {how!r}")


PERCENTILES = (5, 10, 25, 50, 75, 90, 95)
#: Interval: its lower and upper percentile.
INTERVALS = {90: (5, 95), 80: (10, 90), 50: (25, 75), 20: (40, 60), 10: (45, 55)}


def percentile_bands(values: Column) -> Column:
    return F.struct(reduce_samples(values).alias("mean"), *[array_percentile(values, p).alias(f"p{p}") for p in PERCENTILES])


def coverage(df: DataFrame, keys: Sequence[str], obs: str = "obs", samples: str = "samples") -> DataFrame:
    """Share of observations strictly inside each central interval."""
    out = df.where(F.col(obs).isNotNull()).select(*keys, obs, *[array_percentile(F.col(samples), p).alias(f"q{p}") for pair in INTERVALS.values() for p in pair])
    inside = lambda lo, hi: F.avg(((F.col(f"q{lo}") < F.col(obs)) & (F.col(obs) < F.col(f"q{hi}"))).cast("double"))
    return out.groupBy(*keys).agg(*[inside(lo, hi).alias(f"inside_{k}") for k, (lo, hi) in INTERVALS.items()])


def reliability(df: DataFrame, keys: Sequence[str] = (), obs: str = "obs", samples: str = "samples", step: int = 5, first: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """For q = 0, step .. 100: the share of observations below the q-th percentile of their ensemble.

    ``first`` takes only as many observed points, the first by ``order`` (a report over a few hundred points, not over a whole run).
    """
    rows = df.where(F.col(obs).isNotNull())
    if first is not None:
        if not order:
            raise ValueError("the first points are the first in some order")
        rows = rows.orderBy(*order).limit(first)
    points = F.array(*[F.struct(F.lit(q).alias("q"), (F.col(obs) < array_percentile(F.col(samples), q)).cast("double").alias("below")) for q in range(0, 101, step)])
    return rows.select(*keys, F.inline(points)).groupBy(*keys, "q").agg(F.avg("below").alias("share"))


def last_step(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last value of arrays over steps: what a report of the last predicted step looks at."""
    return df.withColumns({c: F.element_at(c, -1) for c in columns})
