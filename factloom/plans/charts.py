"""What charts show of facts, as JSON: a few hundred points at most, thinned on Spark."""

from __future__ import annotations

import json

from ..functions.display import nice_ticks

#: Most points of a line and of a scatter chart, and groups of a bar and of a donut chart (fixed values).
LINE_POINTS, SCATTER_POINTS, BARS, SLICES = 120, 200, 8, 5


def _json(chart: dict) -> str:
    """Charts don't show more than nine digits, and sums differ in the last ones with the order of rows."""

    def short(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, dict):
            return {k: short(x) for k, x in v.items()}
        return [short(x) for x in v] if isinstance(v, list) else v

    return json.dumps(short(chart))


def _ticks(values: list[float]) -> list[float]:
    return nice_ticks(min(values), max(values)) if values else []


def line(points: list[dict], slope: float | None = None, intercept: float | None = None, mark: tuple[int, float, str] | None = None) -> str:
    """A line with its trend by point, and with a marked point, which thinning must not smooth away."""
    size = points[0]["size"] if points else 1
    shown = [{"label": p["label"], "value": p["value"]} for p in points]
    out = {"type": "line", "points": shown}
    if mark:
        at = mark[0] // size
        shown[at] = {"label": mark[2], "value": mark[1]}
        out["mark"] = at
    if slope is not None:
        out["trend"] = {"slope": slope * size, "intercept": intercept}
    return _json(out | {"ticks": _ticks([p["value"] for p in shown])})


def parts(kind: str, ranked: list[tuple[str, float]], top: int) -> str:
    """A bar or donut chart: the largest groups and one part for the rest. ranked is sorted."""
    shown = [{"label": k, "value": v} for k, v in ranked[:top]]
    if len(ranked) > top:
        shown.append({"label": f"Other ({len(ranked) - top})", "value": sum(v for _, v in ranked[top:])})
    return _json({"type": kind, "parts": shown, "ticks": _ticks([0.0, *(p["value"] for p in shown)])})


def bars(labels: list[str], values: list[float]) -> str:
    return _json({"type": "bar", "parts": [{"label": a, "value": b} for a, b in zip(labels, values, strict=True)], "ticks": _ticks([0.0, *values])})


def scatter(points: list[list[float]], slope: float, intercept: float) -> str:
    """Evenly thinned pairs, and the line through all of them."""
    ticks = [_ticks([p[k] for p in points]) for k in (0, 1)]
    return _json({"type": "scatter", "points": points, "fit": {"slope": slope, "intercept": intercept}, "xTicks": ticks[0], "yTicks": ticks[1]})
