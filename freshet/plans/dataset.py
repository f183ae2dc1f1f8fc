"""From a configuration to samples: load, crop, union, fit and apply the scaler, validate, number.

Every step is a plan; only the scaler (a row a feature) is collected, to become literals.  The date crop is applied before the windows with the halo
they need, and again exactly through the sample-date check, because a filter on the date does not pass below a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import Config
from freshet.operators import align, scaler, sequences, validate
from freshet.operators.union import union_features
from freshet.schema import BASIN, DATE
from freshet.sources import registry


@dataclass
class Prepared:
    dense: DataFrame
    forecasts: DataFrame | None
    scaler: DataFrame
    valid: DataFrame
    samples: DataFrame


def prepare(
    spark: SparkSession, cfg: Config, tables: tuple[DataFrame | None, DataFrame, DataFrame | None] | None = None, which: str = "train", fitted: DataFrame | None = None, work: str | None = None
) -> Prepared:
    """Samples of one period; the scaler is fitted on training data only and must be given otherwise.

    Without ``tables`` the configuration's data set is loaded.  ``work``, a folder that all executors share, takes the cropped and
    filled tables, so that the sources are read once and not again by each step.
    """
    statics, dynamics, forecasts = tables if tables is not None else registry.load(spark, cfg)
    train = which == "train"
    if not train and fitted is None:
        raise ValueError("evaluation needs the scaler of the training run")
    periods = cfg.periods(which)
    halo = (cfg.seq_length, cfg.lead_time)
    dynamics = align.crop(dynamics, periods, *halo)
    if forecasts is not None:
        forecasts = align.lead_slice(align.crop(forecasts, periods, *halo), max(cfg.lead_time, 1))
    if cfg.union_mapping:
        dynamics, forecasts = union_features(dynamics, forecasts, cfg.union_mapping)
    if work is not None:
        dynamics = _staged(spark, dynamics, f"{work}/{which}-dynamics")
        forecasts = _staged(spark, forecasts, f"{work}/{which}-forecasts") if forecasts is not None else None

    has = lambda df, names: [f for f in names if df is not None and f in df.columns]
    static, hind, fore, targets = (cfg.features(x) for x in ("static_attributes", "hindcast_inputs", "forecast_inputs", "target_variables"))
    of_dyn = has(dynamics, [*hind, *targets])
    of_fc = has(forecasts, fore)
    if fitted is None:
        parts = [scaler.fit(dynamics, dict.fromkeys(of_dyn), cfg.custom_normalization, work)]
        if statics is not None and static:
            parts.append(scaler.fit(statics, static, cfg.custom_normalization, work))
        if of_fc:
            parts.append(scaler.fit(forecasts, of_fc, cfg.custom_normalization, work))
        fitted = parts[0]
        for p in parts[1:]:
            fitted = fitted.unionByName(p)
        fitted = scaler.check(fitted)
    known = scaler.parameters(fitted)
    dense = align.densify(scaler.scale(dynamics, known, dict.fromkeys(of_dyn)))
    checks = {"hindcast": has(dense, hind), "targets": targets, "statics": static if statics is not None else []}
    if statics is not None and static:
        dense = align.broadcast_static(dense, scaler.scale(statics, known, static).select(BASIN, *static))
    if of_fc:
        forecasts = scaler.scale(forecasts, known, of_fc)
        dense = dense.join(validate.over_leads(forecasts, of_fc, max(cfg.lead_time, 1)), [BASIN, DATE], "left")
        if cfg.forecast_overlap:
            dense = dense.join(validate.first_lead(forecasts, of_fc), [BASIN, DATE], "left")
        checks["forecast"] = of_fc
    valid = validate.masks(
        dense, train=train, periods=periods, method=cfg.nan_handling_method, lead_time=cfg.lead_time, seq_length=cfg.seq_length,
        predict_last_n=cfg.predict_last_n, overlap=cfg.forecast_overlap, min_lead=1, skip_zero=cfg.allzero_samples_are_invalid, **checks,
    )
    return Prepared(dense, forecasts, fitted, valid, validate.sample_index(valid))


def _staged(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sequences_of(cfg: Config, p: Prepared) -> DataFrame:
    """A row a sample: hindcast and target arrays, and forecast arrays where there are forecasts."""
    hind = [f for f in cfg.features("hindcast_inputs") if f in p.dense.columns]
    targets = cfg.features("target_variables")
    of_targets = (targets, cfg.lead_time - cfg.seq_length + 1, cfg.lead_time, [f"y_{t}" for t in targets])
    out = sequences.frames(p.valid, [(hind, 1 - cfg.seq_length, 0, hind), of_targets], "valid")
    fore = [f for f in cfg.features("forecast_inputs") if p.forecasts is not None and f in p.forecasts.columns]
    if fore:
        out = out.join(sequences.forecast(p.forecasts, fore).select(BASIN, DATE, *[F.col(f).alias(f"x_{f}") for f in fore]), [BASIN, DATE])
    return out
