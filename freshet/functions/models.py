"""Forward passes of the forecast models in NumPy, run over Arrow batches (inference; training needs an array framework and is not done here).

Weights are a mapping of names to arrays, in the usual layout: a dense layer ``<name>.w`` (out, in) and ``<name>.b``; an LSTM ``<name>.wx`` (4h, in),
``<name>.wh`` (4h, h) and ``<name>.b`` (4h) with gates in the order input, forget, cell, output.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Weights = Mapping[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softplus(x: np.ndarray, beta: float = 1.0) -> np.ndarray:
    return np.logaddexp(0, beta * x) / beta


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


ACTIVATIONS = {"tanh": np.tanh, "sigmoid": sigmoid, "relu": lambda x: np.maximum(x, 0), "linear": lambda x: x, "softplus": softplus}


def dense(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.w"].T + w[f"{name}.b"]


def stack(w: Weights, name: str, x: np.ndarray, activations: Sequence[str]) -> np.ndarray:
    """Dense layers ``name.0``, ``name.1`` .. with an activation each."""
    for i, a in enumerate(activations):
        if a.lower() not in ACTIVATIONS:
            raise NotImplementedError(f"activation {a!r}")
        x = ACTIVATIONS[a.lower()](dense(w, f"{name}.{i}", x))
    return x


def lstm(w: Weights, name: str, x: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Outputs (batch, time, hidden) and the last (h, c); the input's part of all gates is one product over all steps."""
    n = w[f"{name}.wh"].shape[1]
    h, c = state if state is not None else (np.zeros((len(x), n)), np.zeros((len(x), n)))
    gates = x @ w[f"{name}.wx"].T + w[f"{name}.b"]
    out = np.empty((len(x), x.shape[1], n))
    for t in range(x.shape[1]):
        i, f, g, o = np.split(gates[:, t] + h @ w[f"{name}.wh"].T, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


def regression_head(w: Weights, name: str, x: np.ndarray, activation: str = "linear") -> dict[str, np.ndarray]:
    return {"y_hat": ACTIVATIONS[activation](dense(w, name, x))}


def cmal_head(w: Weights, name: str, x: np.ndarray, eps: float = 1e-5) -> dict[str, np.ndarray]:
    """Mixture parameters: location, scale (softplus of slope 2, above zero), asymmetry in (0, 1), weights that sum to one."""
    hidden = np.maximum(dense(w, f"{name}.0", x), 0)
    mu, b, tau, pi = np.split(dense(w, f"{name}.1", hidden), 4, axis=-1)
    return {"mu": mu, "b": softplus(b, 2.0) + eps, "tau": (1 - eps) * sigmoid(tau) + eps, "pi": (1 - eps) * softmax(pi) + eps}


def with_static(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.repeat(s[:, None, :], x.shape[1], axis=1)], axis=-1)


def group_mean(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Mean over groups that leaves out missing ones; NaN where all are missing."""
    x = np.stack(parts)
    there = ~np.isnan(x)
    n = there.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.where(there, x, 0).sum(axis=0) / n, np.nan)


@dataclass(frozen=True)
class MeanEmbedding:
    """Embeds each group of inputs by itself and averages what is there: groups with gaps drop out of the mean.

    Groups in both parts share one embedding, and then must hold the same features.
    """

    hindcast: Mapping[str, Sequence[str]]
    forecast: Mapping[str, Sequence[str]]
    seq_length: int
    lead_time: int
    activations: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"statics": ("tanh",), "hindcast": ("tanh",), "forecast": ("tanh",)})

    def __post_init__(self) -> None:
        wrong = [g for g in self.shared if list(self.hindcast[g]) != list(self.forecast[g])]
        if wrong:
            raise ValueError(f"groups shared by hindcast and forecast with different features: {wrong}")

    @property
    def shared(self) -> list[str]:
        return [g for g in self.hindcast if g in self.forecast]

    def __call__(self, w: Weights, x_s: np.ndarray, x_h: Mapping[str, np.ndarray], x_f: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = stack(w, "statics", x_s, self.activations["statics"])
        length = self.seq_length + self.lead_time

        def embed(group: str, part: str, data: Mapping[str, np.ndarray], features: Sequence[str], name: str) -> np.ndarray:
            x = np.stack([data[f] for f in features], axis=-1)
            out = stack(w, f"{name}.{group}", with_static(x, s), self.activations[part])
            gap = length - out.shape[1]
            return np.concatenate([out, np.full((len(out), gap, out.shape[2]), np.nan)], axis=1) if part == "hindcast" and gap else out

        own_h = [embed(g, "hindcast", x_h, fs, "hindcast") for g, fs in self.hindcast.items() if g not in self.shared]
        own_f = [embed(g, "forecast", x_f, fs, "forecast") for g, fs in self.forecast.items() if g not in self.shared]
        both = [embed(g, "forecast", x_f, self.forecast[g], "shared") for g in self.shared]
        h, _ = lstm(w, "hindcast_lstm", with_static(group_mean(own_h + both), s))
        f, _ = lstm(w, "forecast_lstm", with_static(np.concatenate([group_mean(own_f + both), h], axis=-1), s))
        return cmal_head(w, "head", f)


@dataclass(frozen=True)
class Handoff:
    """One LSTM runs over the past; a small network turns its state into the first state of another, which runs over the forecast."""

    hindcast: Sequence[str]
    forecast: Sequence[str]
    seq_length: int
    lead_time: int
    overlap: int = 0
    activations: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"handoff": ("tanh",)})
    head: str = "regression"

    def _embed(self, w: Weights, name: str, x: np.ndarray) -> np.ndarray:
        return stack(w, name, x, self.activations[name]) if name in self.activations else x

    def _head(self, w: Weights, name: str, x: np.ndarray) -> dict[str, np.ndarray]:
        return regression_head(w, name, x) if self.head == "regression" else cmal_head(w, name, x)

    def __call__(self, w: Weights, x_s: np.ndarray, x_h: Mapping[str, np.ndarray], x_f: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = self._embed(w, "statics", x_s)
        h = with_static(self._embed(w, "hindcast", np.stack([x_h[f] for f in self.hindcast], axis=-1)), s)
        f = with_static(self._embed(w, "forecast", np.stack([x_f[k] for k in self.forecast], axis=-1)), s)
        past = h.shape[1] - self.overlap
        spinup, state = lstm(w, "hindcast_lstm", h[:, :past])
        during, _ = lstm(w, "hindcast_lstm", h[:, past:], state)
        x = stack(w, "handoff", np.concatenate(state, axis=-1), self.activations["handoff"])
        first = np.split(dense(w, "handoff_linear", x), 2, axis=-1)
        ahead, _ = lstm(w, "forecast_lstm", f, (first[0], first[1]))
        parts = [self._head(w, "hindcast_head", spinup), self._head(w, "hindcast_head", during), self._head(w, "forecast_head", ahead)]
        out = {k: np.concatenate([parts[0][k], parts[1][k], parts[2][k][:, ahead.shape[1] - self.lead_time :]], axis=1)[:, -self.seq_length :] for k in parts[0]}
        if self.overlap and self.head == "regression":
            out |= {"y_hindcast_overlap": parts[1]["y_hat"], "y_forecast_overlap": parts[2]["y_hat"][:, : ahead.shape[1] - self.lead_time]}
        return out


MODELS = {"mean_embedding_forecast_lstm": MeanEmbedding, "handoff_forecast_lstm": Handoff}


def get_model(name: str) -> type:
    if name.lower() not in MODELS:
        raise NotImplementedError(f"no model {name!r}")
    return MODELS[name.lower()]


def positional_encoding(length: int, size: int, base: float = 10_000.0) -> np.ndarray:
    """Sines at even and cosines at odd places of each position's vector."""
    rate = np.exp(-np.log(base) * np.arange(0, size, 2) / size)
    angle = np.arange(length)[:, None] * rate
    out = np.zeros((length, size))
    out[:, 0::2] = np.sin(angle)
    out[:, 1::2] = np.cos(angle)[:, : size // 2]
    return out


def to_bytes(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def predict(samples: DataFrame, model, weights: Weights, statics: Sequence[str], hindcast: Mapping[str, str], forecast: Mapping[str, str], keys: Sequence[str] = ("basin", "date"), rows: int = 512) -> DataFrame:
    """Model outputs of each sample as arrays (time x values, flattened) in columns named like the outputs.

    ``hindcast`` and ``forecast`` map the model's features to array columns.  Weights travel once with the function, whatever the number of
    samples; their size is the model's, not the data's.
    """
    blob = to_bytes(weights)
    names = ("y_hat",) if getattr(model, "head", "cmal") == "regression" else ("mu", "b", "tau", "pi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(blob)) as z:
            w = {k: z[k] for k in z.files}

        def array(batch: pa.RecordBatch, c: str) -> np.ndarray:
            return np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), dtype=float)

        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                x_s = np.stack([array(batch, c) for c in statics], axis=-1)
                out = model(w, x_s, {f: array(batch, c) for f, c in hindcast.items()}, {f: array(batch, c) for f, c in forecast.items()})
                cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                for n in names:
                    flat = out[n].reshape(batch.num_rows, -1)
                    offsets = pa.array(np.arange(batch.num_rows + 1) * flat.shape[1], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, *names])

    schema = T.StructType([samples.schema[k] for k in keys] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    used = dict.fromkeys([*keys, *statics, *hindcast.values(), *forecast.values()])
    return samples.select(*used).mapInArrow(run, schema)
