"""Learning rates by epoch, as a training run that keeps to a configuration would set them."""

from __future__ import annotations

from collections.abc import Iterable

#: Least relative gain that counts as one.
GAIN = 1e-4


def learning_rates(strategy: str, initial: float, losses: Iterable[float], factor: float = 0.1, epochs: int = 10) -> list[float]:
    """The rate behind each epoch, given the epochs' losses.

    ``ConstantLR`` keeps it; ``StepLR`` multiplies it by ``factor`` every ``epochs`` epochs; ``ReduceLROnPlateau`` does so when more than ``epochs``
    epochs on end have not brought the loss below the least so far.
    """
    if strategy not in ("ConstantLR", "StepLR", "ReduceLROnPlateau"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rate, least, bad, out = initial, float("inf"), 0, []
    for done, loss in enumerate(losses, 1):
        if strategy == "StepLR" and done % epochs == 0:
            rate *= factor
        if strategy == "ReduceLROnPlateau":
            if loss < least * (1 - GAIN):
                least, bad = loss, 0
            else:
                bad += 1
            if bad > epochs:
                rate, bad = rate * factor, 0
        out.append(rate)
    return out
