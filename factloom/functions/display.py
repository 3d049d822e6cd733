"""Numbers and dates as a reader sees them; for the few values of a ledger, on the driver."""

from __future__ import annotations

import datetime as dt
import json
import math
from decimal import ROUND_HALF_UP, Decimal

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def fixed(x: float, digits: int) -> str:
    """x with so many decimals, rounded by its exact binary value, trailing zeros dropped."""
    text = format(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def number(x: float | None) -> str:
    """A number in the unit that suits its size."""
    if x is None or not math.isfinite(x):
        return "—"
    a = abs(x)
    for limit, unit, name in ((1e9, 1e9, "B"), (1e6, 1e6, "M"), (1e4, 1e3, "K")):
        if a >= limit:
            return fixed(x / unit, 2 if unit > 1e3 else 1) + name
    if a >= 100:
        return fixed(x, 1)
    if a >= 1 or a == 0:
        return fixed(x, 2)
    return fixed(x, max(2, 2 - math.floor(math.log10(a))))


def percent(x: float) -> str:
    return ("+" if x > 0 else "") + number(x) + "%"


def granularity(days: float) -> str:
    """year beyond 900 days, month beyond 120, else day."""
    return "year" if days > 900 else "month" if days > 120 else "day"


def date(d: dt.date, unit: str) -> str:
    if unit == "year":
        return str(d.year)
    return f"{MONTHS[d.month - 1]} {d.year}" if unit == "month" else f"{MONTHS[d.month - 1]} {d.day}, {d.year}"


def chance(p: float) -> str:
    return "<0.001" if p < 0.001 else fixed(p, 3)


def shortened(s: str, most: int) -> str:
    return s if len(s) <= most else s[: most - 1] + "…"


def half_up(x: float, digits: int) -> float:
    k = 10.0**digits
    return math.floor(x * k + 0.5) / k


def _nice(x: float, limits: tuple[float, float, float]) -> float:
    """1, 2, 5 or 10 times the power of ten below x: the first whose limit x does not exceed."""
    unit = 10.0 ** math.floor(math.log10(x))
    for limit, nice in zip(limits, (1, 2, 5), strict=True):
        if x / unit <= limit:
            return nice * unit
    return 10 * unit


def nice_ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round axis ticks that cover low to high."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return [0.0, 1.0]
    if low == high:
        half = (abs(low) or 1.0) / 2
        low, high = low - half, high + half
    span = _nice(high - low, (1, 2, 5))
    below = math.nextafter
    step = _nice(span / (about - 1), (below(1.5, 0), below(3, 0), below(7, 0)))
    first, last = math.floor(low / step), math.ceil(high / step)
    return [float(f"{i * step:.12g}") for i in range(first, last + 1)]


def canonical_json(value) -> str:
    """JSON with sorted keys, without blanks and without keys whose value is absent."""

    def clean(v):
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
