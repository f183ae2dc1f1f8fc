"""Algebra of pandas-style frequency strings such as ``1D``, ``3h``, ``W``."""

from __future__ import annotations

import re
from fractions import Fraction

# Seconds of units with a fixed length, and months of calendar units.
SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400, "W": 604800}
MONTHS = {"ME": 1, "QE": 3, "YE": 12}
STARTS = {"MS": 1, "QS": 3, "YS": 12}
_OLD = {"H": "h", "T": "min", "S": "s", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE"}


def parse(freq: str) -> tuple[int, str]:
    """(count, unit); units may carry an anchor (W-SUN, YE-DEC), which is dropped."""
    m = re.fullmatch(r"(-?\d*)([A-Za-z]+)(?:-[A-Z]{3})?", freq.strip())
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    unit = _OLD.get(m[2], m[2])
    if unit not in SECONDS and unit not in MONTHS and unit not in STARTS:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1]) if m[1] not in ("", "-") else (-1 if m[1] == "-" else 1), unit


def factor(low: str, high: str) -> float:
    """How often ``high`` goes into ``low``; ValueError if that depends on the date."""
    (a, u), (b, v) = parse(low), parse(high)
    if a < 0 or b < 0:
        raise NotImplementedError("negative frequencies")
    for table in (SECONDS, MONTHS, STARTS):
        if u in table and v in table:
            x, y = Fraction(a * table[u]), Fraction(b * table[v])
            if not y:
                return 1.0 if not x else float("inf")
            f = x / y
            return int(f) if f.denominator == 1 else float(f)
    raise ValueError(f"frequencies {low!r} and {high!r} cannot be compared")


def compare(a: str, b: str) -> int:
    """1 if ``a`` is the higher frequency (shorter step), -1 if the lower, 0 if equal."""
    f = factor(a, b)
    return 0 if f == 1 else (1 if f < 1 else -1)


def sort(freqs: list[str]) -> list[str]:
    """From the lowest frequency to the highest."""
    import functools

    return sorted(freqs, key=functools.cmp_to_key(compare))


def infer(days: list[int] | None = None, seconds: list[int] | None = None) -> str:
    """Frequency of regular steps (given as ordinals of days, or as epoch seconds), with a leading count; weeks in days."""
    steps = sorted({b - a for a, b in zip(days or seconds or [], (days or seconds or [])[1:], strict=False)})
    if len(steps) != 1:
        raise ValueError("steps are not regular")
    n = steps[0] * (86400 if days else 1)
    for unit in ("D", "h", "min", "s"):
        if n % SECONDS[unit] == 0:
            return f"{n // SECONDS[unit]}{unit}"
    raise AssertionError
