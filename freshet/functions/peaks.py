"""Peaks of an ordered series, and the metrics built on them, as grouped Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.frequency import SECONDS, factor, parse


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places where a strict rise is followed by a strict fall; of a plateau, its middle (the left of two).  Edges are no peaks."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    change = np.flatnonzero(x[1:] != x[:-1])  # a run of equal values ends at each of these
    start = np.concatenate([[0], change + 1])
    stop = np.concatenate([change, [len(x) - 1]])
    level = x[start]
    high = np.zeros(len(level), bool)
    high[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (start[high] + stop[high]) // 2


def _bases(x: np.ndarray) -> np.ndarray:
    """The lowest value since the last higher one, up to each place itself; one pass with the falling values still in sight."""
    out = np.empty(len(x))
    sight: list[tuple[float, float]] = []  # (value, lowest since the one before)
    for i, v in enumerate(x.tolist()):
        low = v
        while sight and sight[-1][0] <= v:
            low = min(low, sight.pop()[1])
        sight.append((v, low))
        out[i] = low
    return out


def prominences(x: np.ndarray) -> np.ndarray:
    """Height of each place above the higher of the two lowest points reached before a higher value, or the edge, on each side."""
    return x - np.maximum(_bases(x), _bases(x[::-1])[::-1])


def prominence(x: np.ndarray, peak: int) -> float:
    return float(prominences(x)[peak])


def find_peaks(x: np.ndarray, distance: float | None = None, height: float | None = None, least_prominence: float | None = None) -> np.ndarray:
    """Peaks filtered by height, then distance (the highest first; among equals the later), then prominence."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        apart = int(np.ceil(distance))
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                lo, hi = np.searchsorted(peaks, [peaks[i] - apart + 1, peaks[i] + apart])
                keep[lo:hi] = False
                keep[i] = True
        peaks = peaks[keep]
    if least_prominence is not None:
        peaks = peaks[prominences(x)[peaks] >= least_prominence] if len(peaks) else peaks
    return peaks


def _inside(times: np.ndarray, i: int, window: int, step: float) -> bool:
    """The window lies in the series and spans no gap."""
    return i - window >= 0 and i + window < len(times) and int((times[i + window] - times[i - window]) // step) + 1 == 2 * window + 1


def timing(obs: np.ndarray, sim: np.ndarray, times: np.ndarray, step: float, window: int) -> float | None:
    errors = []
    for i in find_peaks(obs, 100, least_prominence=obs.std() if len(obs) else 0.0):
        if not _inside(times, i, window, step):
            continue
        j = i
        if not (sim[i] > sim[i - 1] and sim[i] > sim[i + 1]):
            j = i - window + int(np.argmax(sim[i - window : i + window + 1]))
        errors.append(abs(times[i] - times[j]) / step)
    return float(np.mean(errors)) if errors else None


def missed(obs: np.ndarray, sim: np.ndarray, times: np.ndarray, step: float, window: int, percentile: float = 80) -> float | None:
    if not len(obs):
        return None
    of_obs = find_peaks(obs, 30, height=np.percentile(obs, percentile))
    of_sim = find_peaks(sim, 30, height=np.percentile(sim, percentile))
    if not len(of_obs):
        return 0.0
    n = sum(1 for i in of_obs if _inside(times, i, window, step) and not (np.abs(of_sim - i) <= window).any())
    return n / len(of_obs)


def mape(obs: np.ndarray, sim: np.ndarray) -> float | None:
    peaks = find_peaks(obs, 100, least_prominence=obs.std()) if len(obs) else []
    if not len(peaks):
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        value = float(np.sum(np.abs((sim[peaks] - obs[peaks]) / obs[peaks])) / len(peaks) * 100)
    return value if np.isfinite(value) else None


def peak_metrics(df: DataFrame, keys: Sequence[str], obs: str = "obs", sim: str = "sim", date: str = "date", resolution: str = "1D") -> DataFrame:
    """Peak-Timing, Missed-Peaks and Peak-MAPE of each group; a group is one basin's (and lead time's) series."""
    count, unit = parse(resolution)
    step = float(count * SECONDS[unit])
    half_day = int(factor("12h", resolution)) if factor("12h", resolution) != float("inf") else 0
    of_timing, of_missed = max(half_day, 3), max(half_day, 1)
    pairs = df.where(F.col(obs).isNotNull() & F.col(sim).isNotNull()).select(
        *keys, F.unix_timestamp(F.col(date).cast("timestamp")).alias("__t"), F.col(obs).cast("double").alias("__o"), F.col(sim).cast("double").alias("__s")
    )

    def run(table: pa.Table) -> pa.Table:
        t, o, s = (table.column(c).to_numpy() for c in ("__t", "__o", "__s"))
        order = np.argsort(t, kind="stable")
        t, o, s = t[order].astype(float), o[order], s[order]
        values = (timing(o, s, t, step, of_timing), missed(o, s, t, step, of_missed), mape(o, s))
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), *(pa.array([v], pa.float64()) for v in values)], names=[*keys, "Peak-Timing", "Missed-Peaks", "Peak-MAPE"])

    schema = T.StructType([df.select(*keys).schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("Peak-Timing", "Missed-Peaks", "Peak-MAPE")])
    return pairs.groupBy(*keys).applyInArrow(run, schema)
