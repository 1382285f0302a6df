"""Hyperbolic decline baseline q(t) = qi / (1 + b di t)^(1/b), fitted per well."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellpanel.functions.columns import month_index, months_between_int
from wellpanel.operators.cutoffs import Cutoffs, cutoff_array

# --- fixed values: bounds of the fit ------------------------------------------

MIN_POSITIVE_MONTHS = 6
B_RANGE = (1e-6, 1.0)
DI_RANGE = (1e-9, 10.0)
QI_MIN = 1e-9

# --- end of fixed values --------------------------------------------------------

_B_GRID = np.array([B_RANGE[0], 0.25, 0.5, 0.75, 1.0])
_LOG_DI_GRID = np.log(np.concatenate([[DI_RANGE[0]], np.logspace(-4, 1, 26)]))
_CELLS = np.array([(b, d) for b in _B_GRID for d in _LOG_DI_GRID])
_LOW = np.array([np.log(QI_MIN), np.log(DI_RANGE[0]), B_RANGE[0]])
_HIGH = np.array([np.inf, np.log(DI_RANGE[1]), B_RANGE[1]])
_STARTS = 3
_STEPS = 40
_IDLE = 8
_WELLS_AT_ONCE = 256


def _grid_shapes(months: int) -> np.ndarray:
    """Decline shape per unit of qi of every grid cell at whole months 0, 1, ...: one row a month of the calendar."""
    t = np.arange(months, dtype=float)[:, None]
    return np.exp(-np.log1p(_CELLS[:, 0] * np.exp(_CELLS[:, 1]) * t) / _CELLS[:, 0])


def _grid_sums(t: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f * q and f * f per well, prefix and grid cell.

    ``t`` counts whole months, so a cell's shape is looked up by month and the sums are products with one small table.
    """
    month, rows = t.astype(np.int64), np.arange(len(t))[:, None]
    shapes = _grid_shapes(int(month.max(initial=0)) + 1)
    squares = shapes * shapes
    fq, ff = (np.zeros((*lengths.shape, len(_CELLS))) for _ in range(2))
    for k in range(lengths.shape[1]):
        used = np.arange(t.shape[1]) < lengths[:, k, None]
        volume, seen = np.zeros((len(t), len(shapes))), np.zeros((len(t), len(shapes)))
        np.add.at(volume, (rows, month), q * used)
        np.add.at(seen, (rows, month), used)
        fq[:, k], ff[:, k] = volume @ shapes, seen @ squares
    return fq, ff


def _starting_points(fq: np.ndarray, ff: np.ndarray, starts: int) -> np.ndarray:
    """The best cells of the (b, di) grid from their sums; qi has a closed form in each."""
    ff = np.maximum(ff, 1e-300)
    best = np.argsort(-fq * fq / ff, axis=1, kind="stable")[:, :starts]
    qi = np.maximum(np.take_along_axis(fq / ff, best, axis=1), QI_MIN)
    return np.stack([np.log(qi), _CELLS[best][..., 1], _CELLS[best][..., 0]], axis=-1)


def _solved(normal: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Solutions of symmetric 3 x 3 systems given as (a, b, c, d, e, f) of [[a, b, c], [b, d, e], [c, e, f]], by cofactors."""
    a, b, c, d, e, f = normal
    x, y, z = pull
    aa, bb, cc = d * f - e * e, c * e - b * f, b * e - c * d
    dd, ee, ff = a * f - c * c, b * c - a * e, a * d - b * b
    whole = a * aa + b * bb + c * cc
    return np.stack([aa * x + bb * y + cc * z, bb * x + dd * y + ee * z, cc * x + ee * y + ff * z], axis=-1) / whole[:, None]


def _descend(at: np.ndarray, t: np.ndarray, q: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounded least squares in (log qi, log di, b) from every start: the best point and its squared error per well.

    Damped Gauss-Newton steps, all wells and starts at once; a step that does not help is taken back and damped more.
    A start that has gained nothing for some steps is done and leaves the rest.
    """
    wells, starts = at.shape[:2]
    owner = np.repeat(np.arange(wells), starts)
    t, q, used = t[owner], q[owner], used[owner]
    at = at.reshape(-1, 3)

    def model(at: np.ndarray) -> tuple[np.ndarray, ...]:
        b, s = at[:, 2, None], np.exp(at[:, 1, None]) * t
        steep = np.log1p(b * s) / b
        y = np.exp(at[:, 0, None] - steep) * used
        r = q * used - y
        return s, steep, y, r, np.einsum("nt,nt->n", r, r)

    found, error, active = at.copy(), np.empty(len(at)), np.arange(len(at))
    s, steep, y, r, sse = model(at)
    damping, idle = np.full(sse.shape, 1e-2), np.zeros(sse.shape, np.int64)
    for _ in range(_STEPS):
        b = at[:, 2, None]
        fall = s / (1.0 + b * s)
        slopes = (y, -y * fall, y * (steep - fall) / b)
        pull = np.stack([np.einsum("nt,nt->n", g, r) for g in slopes], axis=-1)
        # a parameter pushed against its bound is held there while the others move
        free = ~(((at <= _LOW) & (pull < 0)) | ((at >= _HIGH) & (pull > 0)))
        pull = pull * free
        entries = {(i, j): np.einsum("nt,nt->n", slopes[i], slopes[j]) * (free[:, i] & free[:, j]) for i in range(3) for j in range(i, 3)}
        # scaled to a unit diagonal, so that the cofactors neither overflow nor vanish
        scale = np.sqrt(np.maximum(np.stack([entries[i, i] for i in range(3)], axis=-1), 1e-12))
        unit = [entries[i, j] / (scale[:, i] * scale[:, j]) + (damping if i == j else 0.0) for i, j in entries]
        tried = np.clip(at + _solved(np.array(unit), (pull / scale).T) / scale, _LOW, _HIGH)
        s_new, steep_new, y_new, r_new, sse_new = model(tried)
        better = sse_new < sse
        idle = np.where(better & (sse - sse_new > 1e-10 * sse), 0, idle + 1)
        pick = better[:, None]
        at, s, steep = np.where(pick, tried, at), np.where(pick, s_new, s), np.where(pick, steep_new, steep)
        y, r, sse = np.where(pick, y_new, y), np.where(pick, r_new, r), np.where(better, sse_new, sse)
        damping = np.clip(np.where(better, damping / 5, damping * 4), 1e-12, 1e12)
        going = idle < _IDLE
        if not going.all():
            found[active], error[active] = at, sse
            if not going.any():
                break
            active, at, sse, damping, idle = active[going], at[going], sse[going], damping[going], idle[going]
            t, q, used, s, steep, y, r = (v[going] for v in (t, q, used, s, steep, y, r))
    else:
        found[active], error[active] = at, sse
    found, error = found.reshape(wells, starts, 3), error.reshape(wells, starts)
    rows, best = np.arange(wells), error.argmin(axis=1)
    return found[rows, best], error[rows, best]


def fit_prefixes(t: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(qi, di, b, squared error) for every well and every prefix of its series; rows of ``lengths`` ascend.

    Each prefix descends from the best grid cells and from the solution of the prefix before it.  A length of 0 asks
    for nothing and gives NaN.
    """
    fq, ff = _grid_sums(t, q, lengths)
    out = np.full((*lengths.shape, 4), np.nan)
    before = None
    for k in range(lengths.shape[1]):
        rows = np.flatnonzero(lengths[:, k])
        if not len(rows):
            continue
        n = lengths[rows, k]
        starts = _starting_points(fq[rows, k], ff[rows, k], _STARTS if before is None else _STARTS - 1)
        if before is None:
            before = np.full((len(t), 3), np.nan)
        else:
            known = ~np.isnan(before[rows, 0])
            starts = np.concatenate([np.where(known[:, None], before[rows], starts[:, 0])[:, None, :], starts], axis=1)
        wide = int(n.max())
        used = (np.arange(wide) < n[:, None]).astype(float)
        found, sse = _descend(starts, t[rows, :wide], q[rows, :wide], used)
        before[rows] = found
        out[rows, k] = np.column_stack([np.exp(found[:, 0]), np.exp(found[:, 1]), found[:, 2], sse])
    return out


def grid_prefixes(t: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(qi, di, b, squared error, sum of q * q) of the best grid cell, for every well and every prefix of its series.

    Of equal cells the one with the smallest b, then di.  A cell whose shape vanishes over all months is no candidate.
    """
    fq, ff = _grid_sums(t, q, lengths)
    squares = np.concatenate([np.zeros((len(q), 1)), np.cumsum(q * q, axis=1)], axis=1)
    qq = np.take_along_axis(squares, lengths, axis=1)
    errors = np.where(ff > 0, np.maximum(qq[..., None] - fq * fq / ff, 0.0), np.inf)
    best = errors.argmin(axis=2)[..., None]
    cells = _CELLS[best[..., 0]]
    qi, sse = (np.take_along_axis(v, best, axis=2)[..., 0] for v in (fq / ff, errors))
    return np.stack([qi, np.exp(cells[..., 1]), cells[..., 0], sse, qq], axis=-1)


def _padded(series: pd.Series) -> np.ndarray:
    out = np.zeros((len(series), max(len(s) for s in series)))
    for row, values in zip(out, series, strict=True):
        row[: len(values)] = values
    return out


def _batch_function(solve: Callable[..., np.ndarray], values: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of :func:`prefix_inputs` to one row per well and asked cutoff, with the ``values`` that ``solve`` finds."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), _WELLS_AT_ONCE):
                part = pdf.iloc[start : start + _WELLS_AT_ONCE].reset_index(drop=True)
                # cutoffs are a calendar's months; a well that is not asked at one has length 0 there
                days = sorted({a["as_of_date"] for asked in part["asked"] for a in asked})
                place = {day: k for k, day in enumerate(days)}
                lengths = np.zeros((len(part), len(days)), np.int64)
                for row, asked in enumerate(part["asked"]):
                    for a in asked:
                        lengths[row, place[a["as_of_date"]]] = a["positive_months"]
                with np.errstate(all="ignore"):  # a step that overflows is simply not taken
                    found = solve(_padded(part["t"]), _padded(part["q"]), lengths)
                row, k = np.nonzero(lengths)
                out = part.loc[row, ["well_id", "t0_month"]].reset_index(drop=True)
                out["as_of_date"], out["positive_months"] = [days[j] for j in k], lengths[row, k]
                out[values] = found[row, k]
                yield out[["as_of_date", "well_id", "t0_month", "positive_months", *values]]

    return batches


def _offset(month: Column) -> Column:
    """Whole months since the well's first observed one."""
    return (month_index(month) - month_index(F.col("t0_month"))).cast("double")


def _observed(series: DataFrame) -> DataFrame:
    return series.filter(F.col("oil_prod_m3").isNotNull()).select("well_id", "production_month", F.col("oil_prod_m3").cast("double").alias("y"))


def prefix_inputs(series: DataFrame, cutoffs: Cutoffs, wells: DataFrame | None = None) -> DataFrame:
    """One row per well: its producing months as (t, q), and how many of them each asked cutoff sees.

    Cutoffs of a well are prefixes of one series; those with too few producing months are not asked.
    """
    points = _observed(series).groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct("production_month", "y"))).alias("points"))
    days = cutoff_array(series, cutoffs)
    if wells is not None:
        chosen = wells.groupBy("well_id").agg(F.collect_set("as_of_date").alias("chosen"))  # at most a calendar
        points = points.join(chosen, "well_id")
        days = F.filter(days, lambda c: F.array_contains("chosen", c))
    seen = points.withColumn("t0_month", F.element_at("points", 1)["production_month"]).withColumn("used", F.filter("points", lambda p: p["y"] > 0))

    def counted(day: Column) -> Column:
        return F.struct(day.alias("as_of_date"), F.size(F.filter("used", lambda p: p["production_month"] < day)).alias("positive_months"))

    return (
        seen.withColumn("asked", F.filter(F.transform(days, counted), lambda a: a["positive_months"] >= MIN_POSITIVE_MONTHS))
        .filter(F.size("asked") > 0)
        .withColumn("used", F.slice("used", 1, F.array_max(F.transform("asked", lambda a: a["positive_months"]))))
        .select("well_id", "t0_month", "asked", F.transform("used", lambda p: _offset(p["production_month"])).alias("t"), F.transform("used", lambda p: p["y"]).alias("q"))
    )


def decline_inputs(series: DataFrame, cutoffs: Cutoffs, wells: DataFrame | None = None) -> DataFrame:
    """Producing months before each cutoff as (t, q) arrays, one row per (cutoff, well).

    The arrays hold at most one entry per calendar month.  Zeros are not fitted
    but keep their place in ``t``, which counts from the first observed month.
    """
    points = _observed(series).groupBy("well_id").agg(
        F.sort_array(F.collect_list(F.struct("production_month", "y"))).alias("points")
    )
    asked = points.select("*", F.explode(cutoff_array(series, cutoffs)).alias("as_of_date"))
    if wells is not None:
        asked = asked.join(wells.select("as_of_date", "well_id"), ["as_of_date", "well_id"], "left_semi")
    t0 = F.element_at("points", 1)["production_month"]

    return (
        asked.withColumn("t0_month", t0)
        .filter(F.col("t0_month") < F.col("as_of_date"))
        .withColumn(
            "used",
            F.filter("points", lambda p: (p["production_month"] < F.col("as_of_date")) & (p["y"] > 0)),
        )
        .select(
            "as_of_date",
            "well_id",
            "t0_month",
            F.size("used").alias("positive_months"),
            F.transform("used", lambda p: _offset(p["production_month"])).alias("t"),
            F.transform("used", lambda p: p["y"]).alias("q"),
        )
    )


def _fit_tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _solved_prefixes(series: DataFrame, cutoffs: Cutoffs, wells: DataFrame | None, solve: Callable[..., np.ndarray], values: list[str]) -> DataFrame:
    # this costs CPU, not bytes: an explicit count keeps AQE from packing the
    # small rows into a few tasks
    spread = prefix_inputs(series, cutoffs, wells).repartition(_fit_tasks(series), "well_id")
    return spread.mapInPandas(
        _batch_function(solve, values),
        "as_of_date date, well_id string, t0_month date, positive_months int, " + ", ".join(f"{v} double" for v in values),
    )


def fit_declines(series: DataFrame, cutoffs: Cutoffs, wells: DataFrame | None = None) -> DataFrame:
    """Fitted parameters per (cutoff, well); wells with too few producing months are absent.

    ``wells`` restricts the fit to its (as_of_date, well_id) pairs.  All cutoffs of a well are fitted together.
    """
    fits = _solved_prefixes(series, cutoffs, wells, fit_prefixes, ["qi", "di", "b", "sse"])
    usable = ~(F.isnan("qi") | F.isnan("di") | F.isnan("b") | F.col("qi").isin(float("inf")))
    return fits.filter(usable)


def _shape(b: Column, di: Column, t: Column) -> Column:
    return F.exp(-F.log1p(b * di * t) / b)


def grid_fits(series: DataFrame, cutoffs: Cutoffs, wells: DataFrame | None = None) -> DataFrame:
    """The best cell of the full (b, di) grid per (cutoff, well): columns of :func:`fit_declines` and ``squares``, the
    sum of q * q.

    qi has a closed form in each cell, so sums over a well's months decide.  They are taken well by well over the rows
    that the fit reads, so nothing is copied per cell and what is shuffled is one row per well.
    """
    return _solved_prefixes(series, cutoffs, wells, grid_prefixes, ["qi", "di", "b", "sse", "squares"])


def certified(fits: DataFrame, grid: DataFrame) -> DataFrame:
    """Each fit beside the minimum over the whole grid: ``certified`` when it is within its bounds and no worse.

    The allowance is a rounding error of the sums, not a tolerance of the fit.
    """
    inside = (F.col("qi") >= QI_MIN) & F.col("b").between(*B_RANGE) & F.col("di").between(DI_RANGE[0] * (1 - 1e-9), DI_RANGE[1] * (1 + 1e-9))
    no_worse = F.col("sse") <= F.col("grid_sse") + 1e-9 * F.col("squares")
    beside = grid.select("as_of_date", "well_id", F.col("sse").alias("grid_sse"), "squares")
    return fits.join(beside, ["as_of_date", "well_id"], "left").withColumn("certified", F.coalesce(inside & no_worse, F.lit(False)))


def decline_forecast(target_month: str, qi: str = "qi", di: str = "di", b: str = "b") -> Column:
    """Forecast at ``target_month`` from fitted columns, as a built-in expression."""
    t = months_between_int(target_month, "t0_month").cast("double")
    return F.col(qi) * _shape(F.col(b), F.col(di), t)


def decline_mape(test: DataFrame, fits: DataFrame) -> DataFrame:
    """MAPE on positive targets per fitted well; NULL when all targets are zero."""
    target = F.col("oil_prod_m3_target")
    error = F.abs(target - decline_forecast("target_month")) / target
    return (
        test.join(fits, ["as_of_date", "well_id"])
        .groupBy("as_of_date", "well_id")
        .agg((F.avg(F.when(target > 0, error)) * 100.0).alias("arps_mape_nonzero_pct"))
    )
