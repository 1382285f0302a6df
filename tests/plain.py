"""The features, targets and baselines in plain Python, one well at a time."""

from __future__ import annotations

import datetime as dt
import statistics


def shift(m: dt.date, k: int) -> dt.date:
    at = m.year * 12 + m.month - 1 + k
    return dt.date(at // 12, at % 12 + 1, 1)


def gap(later: dt.date, earlier: dt.date) -> int:
    return (later.year - earlier.year) * 12 + later.month - earlier.month


def by_well(rows) -> dict[str, dict[dt.date, float]]:
    out: dict[str, dict[dt.date, float]] = {}
    for well, m, v in rows:
        out.setdefault(well, {})[m] = v
    return out


def features_of(known: dict[dt.date, float], cutoff: dt.date) -> dict:
    past = {m: v for m, v in known.items() if m < cutoff}
    out = {f"oil_prod_m3_lag_{k}m": past.get(shift(cutoff, -k)) for k in (1, 2, 3, 6, 12)}

    def recent(k: int) -> list[tuple[int, float]]:
        return [(-gap(cutoff, m), v) for m, v in sorted(past.items()) if m >= shift(cutoff, -k)]

    for k in (3, 6, 12):
        out[f"oil_prod_m3_roll_mean_{k}m"] = statistics.mean(v for _, v in recent(k)) if recent(k) else None
    for k in (6, 12):
        points = recent(k)
        enough = len(points) > 1
        out[f"oil_prod_m3_roll_std_{k}m"] = statistics.stdev(v for _, v in points) if enough else None
        out[f"oil_prod_m3_trend_{k}m"] = statistics.linear_regression(*zip(*points)).slope if enough else None
    out["months_with_history"] = len(past)
    out["well_age_months"] = gap(cutoff, min(past))
    out["months_since_last_observed"] = gap(cutoff, max(past))
    out["zero_months_12m"] = sum(v == 0 for _, v in recent(12))
    out["last_observed_month"] = max(past)
    return out


def one_step_error(known: dict[dt.date, float], cutoff: dt.date) -> float:
    """Mean absolute change between following observations before the cutoff."""
    values = [v for m, v in sorted(known.items()) if m < cutoff]
    return statistics.mean(abs(b - a) for a, b in zip(values, values[1:]))
