"""Feature unioning: fill a feature's gaps from another product."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.schema import BASIN, DATE, LEAD


def union_features(
    dynamics: DataFrame, forecasts: DataFrame | None, mapping: Mapping[str, str]
) -> tuple[DataFrame, DataFrame | None]:
    """Fill each feature of ``mapping`` from its mask feature, in either table.

    Same table: coalesce.  A forecast is filled from the observation at its valid date (date + lead time).  An observation is filled
    from the forecast of least lead time that is valid at its date.  Masks are read from the tables as given (no chaining); a feature that
    maps to itself or is absent is passed over, an absent mask is an error.
    """
    obs, fc = set(dynamics.columns), set(forecasts.columns) if forecasts is not None else set()
    same_obs, same_fc, from_obs, from_fc = {}, {}, {}, {}
    for feature, mask in mapping.items():
        if feature == mask or feature not in obs | fc:
            continue
        if mask not in obs | fc:
            raise ValueError(f"no column {mask!r} to fill {feature!r} from")
        if feature in obs:
            (same_obs if mask in obs else from_fc)[feature] = mask
        else:
            (same_fc if mask in fc else from_obs)[feature] = mask
    new_obs = dynamics.withColumns({f: F.coalesce(f, m) for f, m in same_obs.items()})
    if from_fc:
        # the rows of least lead time, moved to their valid dates: one short table for all features
        first = forecasts.agg(F.min(LEAD).alias("__least"))  # a single row
        masks = forecasts.join(F.broadcast(first), F.col(LEAD) == F.col("__least"), "left_semi")
        moved = masks.select(BASIN, F.date_add(DATE, F.col(LEAD)).alias(DATE), *[F.col(m).alias(f"__{m}") for m in dict.fromkeys(from_fc.values())])
        new_obs = new_obs.join(moved, [BASIN, DATE], "left").withColumns({f: F.coalesce(f, f"__{m}") for f, m in from_fc.items()}).select(*dynamics.columns)
    new_fc = forecasts
    if forecasts is not None:
        new_fc = forecasts.withColumns({f: F.coalesce(f, m) for f, m in same_fc.items()})
        if from_obs:
            moved = dynamics.select(BASIN, F.col(DATE).alias("__valid"), *[F.col(m).alias(f"__{m}") for m in dict.fromkeys(from_obs.values())])
            new_fc = (
                new_fc.withColumn("__valid", F.date_add(DATE, F.col(LEAD)))
                .join(moved, [BASIN, "__valid"], "left")
                .withColumns({f: F.coalesce(f, f"__{m}") for f, m in from_obs.items()})
                .select(*forecasts.columns)
            )
    return new_obs, new_fc
