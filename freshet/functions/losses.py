"""Training losses as aggregates over exploded (sample, step, target) rows; NULL observations are left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.cmal import log_likelihood


def _pairs(pred: Column, obs: Column) -> Column:
    return F.when(obs.isNotNull() & pred.isNotNull(), (pred - obs) * (pred - obs))


def mse(pred: Column, obs: Column) -> Column:
    return 0.5 * F.avg(_pairs(pred, obs))


def rmse(pred: Column, obs: Column) -> Column:
    return F.sqrt(0.5 * F.avg(_pairs(pred, obs)))


def nse(pred: Column, obs: Column, basin_std: Column, eps: float = 0.1) -> Column:
    """Squared errors over (basin deviation + eps) squared, averaged."""
    return F.avg(_pairs(pred, obs) / ((basin_std + eps) * (basin_std + eps)))


def cmal(df: DataFrame, sample: Sequence[str], obs: str, mixture: Column) -> DataFrame:
    """Negative log-likelihood: summed over a sample's steps, averaged over the samples without a NULL observation."""
    per = df.groupBy(*sample).agg(F.sum(log_likelihood(F.col(obs), mixture)).alias("ll"), F.count(F.when(F.col(obs).isNull(), 1)).alias("lost"))
    return per.where("lost = 0").agg((-F.avg("ll")).alias("loss"))


def overlap(hindcast: Column, forecast: Column) -> Column:
    """Regulariser: mean squared difference of the two models over their overlap."""
    return F.avg(_pairs(hindcast, forecast))


LOSSES = {"mse": mse, "rmse": rmse, "nse": nse}
REGULARISERS = {"forecast_overlap": overlap}


def by_name(name: str):
    """A loss or regulariser by its name in a configuration."""
    known = {**LOSSES, "cmalloss": cmal, "cmal": cmal, **REGULARISERS}
    if name.lower() not in known:
        raise NotImplementedError(f"no loss {name!r}; there are {sorted(known)}")
    return known[name.lower()]


def total(df: DataFrame, targets: Sequence[tuple[str, str]], loss: str = "mse", weights: Sequence[float] | None = None, std: Mapping[str, str] | None = None, regularisers: Mapping[str, tuple[float, Column]] | None = None) -> DataFrame:
    """One row: each target's loss (pairs of prediction and observation column), the regularisers and ``total_loss``.

    Weights default to one over the number of targets.
    """
    weights = list(weights) if weights is not None else [1 / len(targets)] * len(targets)
    if len(weights) != len(targets):
        raise ValueError("as many weights as targets are required")
    if loss.lower() not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    parts: dict[str, Column] = {}
    whole = F.lit(0.0)
    for (pred, obs), w in zip(targets, weights, strict=True):
        extra = (F.col((std or {})[obs]),) if loss.lower() == "nse" else ()
        parts[f"loss_{obs}"] = LOSSES[loss.lower()](F.col(pred), F.col(obs), *extra)
        whole = whole + F.lit(float(w)) * parts[f"loss_{obs}"]
    for name, (w, column) in (regularisers or {}).items():
        parts[name] = column
        whole = whole + F.lit(float(w)) * column
    return df.agg(*[c.alias(n) for n, c in parts.items()], whole.alias("total_loss"))
