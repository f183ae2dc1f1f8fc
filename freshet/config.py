"""Run configuration: a YAML file whose keys are typed by their suffix.

``*_dir``, ``*_path``, ``*_file`` and ``*_files`` are paths, ``*_date`` and ``*_dates`` dates written day/month/year (one or a list).  Unknown keys are errors
unless ``dev_mode`` is set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from datetime import date, datetime
from pathlib import Path
from typing import Any

from freshet.schema import flatten, unique

_DATE = "%d/%m/%Y"


@dataclass
class Config:
    experiment_name: str = "run"
    run_dir: Path | None = None
    data_dir: Path | None = None
    statics_data_dir: Path | None = None
    dynamics_data_dir: Path | None = None
    targets_data_dir: Path | None = None
    dataset: str = "tables"
    train_basin_file: Path | None = None
    validation_basin_file: Path | None = None
    test_basin_file: Path | None = None
    train_start_date: Any = None
    train_end_date: Any = None
    validation_start_date: Any = None
    validation_end_date: Any = None
    test_start_date: Any = None
    test_end_date: Any = None
    static_attributes: Any = field(default_factory=list)
    hindcast_inputs: Any = field(default_factory=list)
    forecast_inputs: Any = field(default_factory=list)
    target_variables: Any = field(default_factory=list)
    union_mapping: dict = field(default_factory=dict)
    custom_normalization: dict = field(default_factory=dict)
    seq_length: int = 365
    lead_time: int = 0
    predict_last_n: int = 1
    forecast_overlap: int = 0
    nan_handling_method: str | None = None
    allzero_samples_are_invalid: bool = False
    timestep_counter: bool = False
    clip_targets_to_zero: Any = field(default_factory=list)
    tester_sample_reduction: str = "mean"
    tester_skip_obs_all_nan: bool = False
    metrics: Any = field(default_factory=list)
    validate_n_random_basins: int = 0
    load_as_csv: bool = False
    lazy_load: bool = False
    loss: str = "nse"
    target_loss_weights: list | None = None
    negative_sample_handling: str | None = None
    negative_sample_max_retries: int = 5
    n_samples: int = 100
    n_distributions: int = 3
    inference_mode: bool = True
    batch_size: int = 256
    seed: int = 0
    dev_mode: bool = False
    extra: dict = field(default_factory=dict)

    def features(self, which: str) -> list[str]:
        """Flat, ordered, distinct names of ``static_attributes``, ``hindcast_inputs``, ``forecast_inputs`` or ``target_variables``."""
        return unique(flatten(getattr(self, which)))

    def periods(self, which: str) -> list[tuple[date, date]]:
        start, end = getattr(self, f"{which}_start_date"), getattr(self, f"{which}_end_date")
        starts, ends = (x if isinstance(x, list) else [x] for x in (start, end))
        from freshet.operators.align import check_periods

        return check_periods(starts, ends)


def _typed(key: str, value: Any) -> Any:
    if value is None:
        return None
    if key.endswith(("_dir", "_path", "_file", "_files")):
        return [Path(v) for v in value] if isinstance(value, list) else Path(value)
    if key.endswith(("_date", "_dates")):
        one = lambda v: v if isinstance(v, date) else datetime.strptime(v, _DATE).date()
        return [one(v) for v in value] if isinstance(value, list) else one(value)
    return value


def from_dict(raw: dict) -> Config:
    known = {f.name for f in fields(Config)} - {"extra"}
    unknown = sorted(set(raw) - known)
    if unknown and not raw.get("dev_mode"):
        raise ValueError(f"unknown configuration keys: {unknown}")
    cfg = Config(**{k: _typed(k, v) for k, v in raw.items() if k in known}, extra={k: _typed(k, raw[k]) for k in unknown})
    for name in ("statics_data_dir", "dynamics_data_dir", "targets_data_dir"):
        if getattr(cfg, name) is None:
            setattr(cfg, name, cfg.data_dir)
    cfg.experiment_name = experiment_name(cfg.experiment_name, raw)
    return cfg


def read(path: str | Path) -> Config:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text()) or {})


def to_dict(cfg: Config) -> dict:
    def plain(v: Any) -> Any:
        if isinstance(v, Path):
            return str(v)
        if isinstance(v, date):
            return v.strftime(_DATE)
        return [plain(x) for x in v] if isinstance(v, list) else v

    out = {f.name: plain(getattr(cfg, f.name)) for f in fields(Config) if f.name != "extra"} | {k: plain(v) for k, v in cfg.extra.items()}
    return dict(sorted(out.items()))


def dump(cfg: Config, path: str | Path) -> None:
    """Write a configuration with sorted keys; an existing file is not overwritten."""
    import yaml

    with Path(path).open("x") as f:
        yaml.safe_dump(to_dict(cfg), f)


def experiment_name(template: str, values: dict) -> str:
    """``{key}`` is replaced by its value; what does not suit a folder's name becomes an underscore."""
    filled = re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)
    return re.sub(r"[^\w.\-{}]+", "_", filled)


def substitute(config: Any, values: dict[str, Any]) -> Any:
    """Placeholders (strings equal to a key) in a nested configuration replaced by values."""
    if isinstance(config, dict):
        return {k: substitute(v, values) for k, v in config.items()}
    if isinstance(config, list):
        return [substitute(v, values) for v in config]
    return values.get(config, config) if isinstance(config, str) else config
