"""Data set registry: names to functions that give the three tables of a data set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.config import Config

#: (statics, dynamics, forecasts or None)
Tables = tuple[DataFrame | None, DataFrame, DataFrame | None]
Source = Callable[[SparkSession, Config], Tables]

_SOURCES: dict[str, Source] = {}


def register(name: str, source: Source) -> None:
    if not callable(source):
        raise TypeError("a source is a function of session and configuration")
    _SOURCES[name.lower()] = source


def get(name: str) -> Source:
    _own()
    if name.lower() not in _SOURCES:
        raise NotImplementedError(f"no data set {name!r}; there are {sorted(_SOURCES)}")
    return _SOURCES[name.lower()]


def _own() -> None:
    """The data sets that come with the package register themselves."""
    import freshet.sources.datasets  # noqa: F401


def load(spark: SparkSession, cfg: Config) -> Tables:
    """The tables of the configuration's data set."""
    return get(cfg.dataset)(spark, cfg)


def names() -> list[str]:
    _own()
    return sorted(_SOURCES)
