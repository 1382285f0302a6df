"""The catalogue's queries in plain SQL over the same tables, for comparison.

Relations are written once and pulled in by name; ``ORACLES`` maps a query to
its relations, its body, and the kind of each output column: ``s`` text, ``i``
bigint, ``d`` double at 6 decimals, ``t`` date, ``z`` timestamp.
"""

from __future__ import annotations

import re

_SILVER_TIES = (
    "company_id, company_name, well_alias, oil_prod_m3, gas_prod_mm3, water_prod_m3, resource_type, "
    "formation, field, basin, province"
)
_REGISTRY_TIES = (
    "well_alias, company_id, production_formation, field, basin, province, depth_m, latitude, longitude, "
    "classification, sub_classification, reservoir_type"
)


def _nulls_last(columns: str) -> str:
    return ", ".join(f"{c.strip()} ASC NULLS LAST" for c in columns.split(","))


def _blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


def _measure(c: str) -> str:
    amount = f"cast({_blank(c)} AS decimal(18,6))"
    return f"CASE WHEN {amount} >= 0 THEN {amount} END"


def _key(*columns: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} AS varchar), '_dbt_utils_surrogate_key_null_')" for c in columns)
    return f"md5(concat_ws('-', {parts}))"


def _money(c: str) -> str:
    return f"cast({c} AS decimal(18,2))"


_LAGS = ", ".join(
    f"max(CASE WHEN production_month = as_of_date - INTERVAL {k} MONTH THEN y END) AS oil_prod_m3_lag_{k}m" for k in (1, 2, 3, 6, 12)
)


def _mean(k: int) -> str:
    return f"cast(sum({_units(k, 'u')}) AS double) / 1e6 / count({_units(k, 'u')})"


def _deviation(k: int) -> str:
    n, u = f"count({_units(k, 'u')})", f"sum({_units(k, 'u')})"
    return f"CASE WHEN {n} > 1 THEN sqrt(cast({n} * sum({_units(k, 'u * u')}) - {u} * {u} AS double) / 1e12 / ({n} * ({n} - 1))) END"


def _shape(t: str) -> str:
    """Decline per unit of qi; ln(1 + x) as a series where 1 + x would lose the digits of x."""
    x = f"(b * di * {t})"
    return f"exp(-(CASE WHEN {x} < 1e-4 THEN {x} - {x} * {x} / 2 + {x} * {x} * {x} / 3 ELSE ln(1 + {x}) END) / b)"


def _slope(k: int) -> str:
    n, x = f"count({_units(k, 'u')})", f"sum({_units(k, 'x')})"
    rise = f"cast({n} * sum({_units(k, 'x * u')}) - {x} * sum({_units(k, 'u')}) AS double) / 1e6"
    return f"CASE WHEN {n} > 1 THEN {rise} / ({n} * sum({_units(k, 'x * x')}) - {x} * {x}) END"


def _units(k: int, of: str) -> str:
    """Volumes in whole millionths (u) and months before the cutoff (x), so that all sums are exact."""
    u, x = "cast(y * 1000000 AS hugeint)", "date_diff('month', as_of_date, production_month)"
    value = {"u": u, "x": x, "u * u": f"{u} * {u}", "x * u": f"{x} * {u}", "x * x": f"{x} * {x}"}[of]
    return f"CASE WHEN y IS NOT NULL AND production_month >= as_of_date - INTERVAL {k} MONTH THEN {value} END"


_WINDOWS = ", ".join(
    [
        *[f"{_mean(k)} AS oil_prod_m3_roll_mean_{k}m" for k in (3, 6, 12)],
        *[f"{_deviation(k)} AS oil_prod_m3_roll_std_{k}m" for k in (6, 12)],
        *[f"{_slope(k)} AS oil_prod_m3_trend_{k}m" for k in (6, 12)],
    ]
)

RELATIONS: dict[str, str] = {
    "raw_production": f"""
        SELECT cast(l_suppkey AS varchar) AS idempresa,
          CASE WHEN {_money('l_tax')} = 0.08 AND l_linenumber = 7 THEN ' ' ELSE cast(year(l_shipdate) AS varchar) END AS anio,
          cast(month(l_shipdate) AS varchar) AS mes,
          cast(l_partkey AS varchar) AS idpozo,
          CASE WHEN l_returnflag = 'R' AND l_quantity <= 2 THEN ' '
               WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN '-' || cast({_money('l_quantity')} AS varchar)
               WHEN l_linestatus = 'O' AND {_money('l_discount')} = 0 THEN '0.00'
               ELSE cast({_money('l_quantity')} AS varchar) END AS prod_pet,
          CASE WHEN l_returnflag = 'N' AND {_money('l_tax')} = 0 THEN '' ELSE cast({_money('l_extendedprice')} AS varchar) END AS prod_gas,
          cast(cast({_money('l_discount')} * 100 AS decimal(18,2)) AS varchar) AS prod_agua,
          CASE WHEN l_linenumber = 1 THEN '' WHEN l_returnflag = 'R' THEN s_name || ' SA' ELSE s_name END AS empresa,
          CASE WHEN l_linestatus = 'F' THEN 'W-' || cast(l_partkey AS varchar) ELSE ' ' END AS sigla,
          CASE WHEN l_linestatus = 'O' THEN 'CONVENCIONAL' ELSE 'NO CONVENCIONAL' END AS tipo_de_recurso,
          'FM ' || cast(l_linenumber AS varchar) AS formacion,
          CASE WHEN l_returnflag = 'A' THEN '' ELSE 'FIELD ' || cast(l_linenumber AS varchar) END AS areayacimiento,
          CASE l_returnflag WHEN 'A' THEN 'NEUQUINA' WHEN 'N' THEN 'GOLFO SAN JORGE' ELSE 'AUSTRAL' END AS cuenca,
          CASE WHEN l_linestatus = 'O' THEN 'Chubut' ELSE 'Neuquén' END AS provincia,
          lpad(cast(l_orderkey AS varchar), 12, '0') AS _dlt_load_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "raw_registry": f"""
        SELECT CASE WHEN p_size = 13 THEN ' ' ELSE cast(p_partkey AS varchar) END AS idpozo, '' AS idempresa,
          CASE WHEN p_size > 45 THEN '' ELSE cast(p_size * 100 AS varchar) || '.5' END AS profundidad,
          '-' || cast({_money('p_retailprice')} AS varchar) AS coordenaday, cast(p_size AS varchar) AS coordenadax,
          p_name || ' ' || cast(load AS varchar) AS sigla, p_type AS formprod,
          CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS areayacimiento,
          CASE WHEN p_type = 'PROMO' THEN '' ELSE 'CUENCA ' || p_type END AS cuenca, ' ' AS provincia,
          p_type AS clasificacion, '' AS subclasificacion, p_brand AS tipo_reservorio,
          lpad(cast(load AS varchar), 12, '0') AS _dlt_load_id
        FROM part CROSS JOIN (VALUES (1), (2)) AS l(load)""",
    "typed": f"""
        SELECT idpozo AS well_id, idempresa AS company_id, {_blank('empresa')} AS company_name, {_blank('sigla')} AS well_alias,
          make_date(cast(trim(anio) AS integer), cast(trim(mes) AS integer), 1) AS production_month,
          {_measure('prod_pet')} AS oil_prod_m3, {_measure('prod_gas')} AS gas_prod_mm3, {_measure('prod_agua')} AS water_prod_m3,
          {_blank('tipo_de_recurso')} AS resource_type, {_blank('formacion')} AS formation, {_blank('areayacimiento')} AS field,
          {_blank('cuenca')} AS basin, {_blank('provincia')} AS province, _dlt_load_id AS dlt_load_id
        FROM raw_production WHERE {_blank('anio')} IS NOT NULL AND {_blank('mes')} IS NOT NULL""",
    "silver": f"""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY well_id, production_month
          ORDER BY dlt_load_id DESC NULLS FIRST, {_nulls_last(_SILVER_TIES)}) AS rn FROM typed) WHERE rn = 1""",
    "reg_typed": f"""
        SELECT idpozo AS well_id, {_blank('sigla')} AS well_alias, idempresa AS company_id, {_blank('formprod')} AS production_formation,
          {_blank('areayacimiento')} AS field, {_blank('cuenca')} AS basin, {_blank('provincia')} AS province,
          cast({_blank('profundidad')} AS decimal(18,6)) AS depth_m, cast({_blank('coordenaday')} AS double) AS latitude,
          cast({_blank('coordenadax')} AS double) AS longitude, {_blank('clasificacion')} AS classification,
          {_blank('subclasificacion')} AS sub_classification, {_blank('tipo_reservorio')} AS reservoir_type, _dlt_load_id AS dlt_load_id
        FROM raw_registry WHERE {_blank('idpozo')} IS NOT NULL""",
    "registry": f"""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY well_id
          ORDER BY dlt_load_id DESC NULLS FIRST, {_nulls_last(_REGISTRY_TIES)}) AS rn FROM reg_typed) WHERE rn = 1""",
    "attrs": """
        SELECT * EXCLUDE (rn) FROM (SELECT well_id, well_alias, field, basin, province, formation, resource_type,
          row_number() OVER (PARTITION BY well_id ORDER BY production_month DESC) AS rn FROM silver) WHERE rn = 1""",
    "universe": "SELECT well_id FROM registry UNION SELECT well_id FROM silver",
    "dim_well": f"""
        SELECT {_key('u.well_id')} AS well_key, u.well_id, coalesce(r.well_alias, a.well_alias) AS well_alias,
          coalesce(r.field, a.field) AS field, coalesce(r.basin, a.basin) AS basin, coalesce(r.province, a.province) AS province,
          r.depth_m, r.latitude, r.longitude, r.classification, r.sub_classification, r.reservoir_type, a.formation, a.resource_type
        FROM universe u LEFT JOIN registry r ON u.well_id = r.well_id LEFT JOIN attrs a ON u.well_id = a.well_id""",
    "dim_company": f"""
        SELECT {_key('company_id')} AS company_key, company_id, company_name FROM (SELECT company_id, company_name,
          row_number() OVER (PARTITION BY company_id ORDER BY company_name ASC NULLS LAST) AS rn FROM silver
          WHERE company_id IS NOT NULL) WHERE rn = 1""",
    "dim_date": f"""
        SELECT {_key('production_month')} AS date_key, production_month, year(production_month) AS year,
          month(production_month) AS month, quarter(production_month) AS quarter, strftime(production_month, '%B') AS month_name
        FROM (SELECT DISTINCT production_month FROM silver)""",
    "fact": f"""
        SELECT {_key('well_id', 'production_month')} AS production_key, {_key('well_id')} AS well_key,
          {_key('company_id')} AS company_key, {_key('production_month')} AS date_key, well_id, production_month,
          oil_prod_m3, gas_prod_mm3, water_prod_m3 FROM silver""",
    "monthly_view": """
        SELECT d.production_month, d.year, d.month, d.month_name, w.well_id, w.well_alias, w.field, w.basin, w.province,
          c.company_name, f.oil_prod_m3, f.gas_prod_mm3, f.water_prod_m3
        FROM fact f JOIN dim_well w ON f.well_key = w.well_key JOIN dim_company c ON f.company_key = c.company_key
        JOIN dim_date d ON f.date_key = d.date_key""",
    "by_fluid": """
        SELECT w.well_alias, c.company_name, d.production_month, v.fluid_type, v.volume
        FROM fact f JOIN dim_well w ON f.well_key = w.well_key JOIN dim_company c ON f.company_key = c.company_key
        JOIN dim_date d ON f.date_key = d.date_key,
        LATERAL (SELECT 'Petróleo' AS fluid_type, f.oil_prod_m3 AS volume UNION ALL SELECT 'Gas', f.gas_prod_mm3
                 UNION ALL SELECT 'Agua', f.water_prod_m3) AS v""",
    "cutoffs": "SELECT cast(c AS date) AS as_of_date FROM generate_series(DATE '1999-09-01', DATE '2001-08-01', INTERVAL 1 MONTH) AS g(c)",
    "evaluated": "SELECT as_of_date FROM cutoffs WHERE as_of_date >= DATE '2001-04-01'",
    "history": f"""
        SELECT well_id, as_of_date, {_LAGS}, {_WINDOWS},
          count(*) FILTER (WHERE y = 0 AND production_month >= as_of_date - INTERVAL 12 MONTH) AS zero_months_12m,
          count(*) AS months_with_history, date_diff('month', min(production_month), as_of_date) AS well_age_months,
          date_diff('month', max(production_month), as_of_date) AS months_since_last_observed,
          max(production_month) AS last_observed_month
        FROM (SELECT well_id, production_month, cast(oil_prod_m3 AS double) AS y, as_of_date FROM silver
              JOIN cutoffs ON production_month < as_of_date) GROUP BY well_id, as_of_date""",
    "features": f"""
        SELECT {_key('h.well_id', 'h.as_of_date')} AS feature_key, h.*, w.basin, w.field, w.resource_type
        FROM history h LEFT JOIN dim_well w ON h.well_id = w.well_id""",
    "series": "SELECT well_id, production_month, cast(oil_prod_m3 AS double) AS y FROM silver",
    "horizons": "SELECT unnest([1, 2, 3]) AS horizon",
    "dataset": """
        SELECT f.*, horizon, cast(as_of_date + INTERVAL (horizon - 1) MONTH AS date) AS target_month, t.y AS oil_prod_m3_target,
          n.y AS naive_forecast_m3
        FROM features f CROSS JOIN horizons
        JOIN series t ON t.well_id = f.well_id AND t.production_month = as_of_date + INTERVAL (horizon - 1) MONTH AND t.y IS NOT NULL
        LEFT JOIN series n ON n.well_id = f.well_id AND n.production_month = f.last_observed_month""",
    "predictions": "SELECT *, coalesce(oil_prod_m3_roll_mean_12m, naive_forecast_m3, 0.0) AS prediction_m3 FROM dataset",
    "steps": """
        SELECT well_id, production_month, y, y - lag(y) OVER (PARTITION BY well_id ORDER BY production_month) AS step_m3
        FROM series WHERE y IS NOT NULL""",
    "observed": """
        SELECT as_of_date, o.well_id, count(DISTINCT o.production_month) AS months_observed, avg(abs(o.step_m3)) AS insample_naive_mae_m3
        FROM steps o JOIN evaluated ON o.production_month < as_of_date GROUP BY as_of_date, o.well_id""",
    "scores": """
        SELECT as_of_date, well_id, count(*) AS test_rows, count(naive_forecast_m3) AS scored_rows,
          sum(abs(oil_prod_m3_target - prediction_m3)) FILTER (WHERE naive_forecast_m3 IS NOT NULL) AS abs_error_sum,
          sum(abs(oil_prod_m3_target - naive_forecast_m3)) AS naive_abs_error_sum,
          avg(abs(oil_prod_m3_target - prediction_m3)) FILTER (WHERE naive_forecast_m3 IS NOT NULL) AS model_mae_m3,
          sqrt(avg((oil_prod_m3_target - prediction_m3) * (oil_prod_m3_target - prediction_m3)) FILTER (WHERE naive_forecast_m3 IS NOT NULL)) AS model_rmse_m3,
          avg(abs(oil_prod_m3_target - naive_forecast_m3)) AS naive_mae_m3,
          avg(abs(oil_prod_m3_target - prediction_m3) / nullif(oil_prod_m3_target, 0)) FILTER (WHERE naive_forecast_m3 IS NOT NULL AND oil_prod_m3_target > 0) * 100 AS mape_nonzero_pct
        FROM predictions WHERE as_of_date IN (SELECT as_of_date FROM evaluated) GROUP BY as_of_date, well_id""",
    "scored": """
        SELECT s.*, o.months_observed, o.insample_naive_mae_m3, coalesce(o.months_observed >= 12, false) AS eligible,
          coalesce(o.months_observed >= 12, false) AND s.scored_rows > 0 AS evaluable,
          CASE WHEN o.insample_naive_mae_m3 > 0 THEN s.model_mae_m3 / o.insample_naive_mae_m3 END AS mase
        FROM scores s LEFT JOIN observed o ON s.as_of_date = o.as_of_date AND s.well_id = o.well_id""",
    "coverage": """
        SELECT as_of_date, count(*) AS wells_in_test, count(*) FILTER (WHERE evaluable) AS wells_eligible,
          count(*) FILTER (WHERE NOT eligible) AS wells_excluded_short_history,
          count(*) FILTER (WHERE evaluable AND mase IS NULL) AS wells_mase_undefined,
          sum(abs_error_sum) FILTER (WHERE evaluable) / sum(scored_rows) FILTER (WHERE evaluable) AS model_mae_m3,
          sum(naive_abs_error_sum) FILTER (WHERE evaluable) / sum(scored_rows) FILTER (WHERE evaluable) AS naive_mae_m3,
          quantile_cont(mase, 0.5) FILTER (WHERE evaluable) AS mase_median
        FROM scored GROUP BY as_of_date""",
    "long_values": """
        SELECT as_of_date, m.metric, m.value FROM scored s, LATERAL (SELECT 'mase' AS metric, s.mase AS value
          UNION ALL SELECT 'model_mae_m3', s.model_mae_m3 UNION ALL SELECT 'naive_mae_m3', s.naive_mae_m3
          UNION ALL SELECT 'mape_nonzero_pct', s.mape_nonzero_pct) AS m WHERE evaluable AND m.value IS NOT NULL""",
    "distributions": """
        SELECT as_of_date, metric, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90
        FROM long_values GROUP BY as_of_date, metric""",
    "gates": """
        SELECT as_of_date, 'mase_median' AS gate, mase_median AS value, 1.0 AS threshold, mase_median < 1.0 AS passed, true AS blocking FROM coverage
        UNION ALL SELECT as_of_date, 'mae_vs_naive', model_mae_m3 / naive_mae_m3, 1.0, model_mae_m3 / naive_mae_m3 <= 1.0, true FROM coverage
        UNION ALL SELECT as_of_date, 'mape_vs_arps', arps_mape_gap_pp, 2.0, arps_mape_gap_pp <= 2.0, false FROM decline_summary""",
    "decline_points": """
        SELECT e.as_of_date, s.well_id, t0.m AS t0_month, date_diff('month', t0.m, s.production_month) AS t, y AS q FROM series s
        JOIN (SELECT well_id, min(production_month) AS m FROM series WHERE y IS NOT NULL GROUP BY well_id) t0 ON s.well_id = t0.well_id
        JOIN evaluated e ON s.production_month < e.as_of_date WHERE y > 0""",
    "decline_cells": """
        SELECT b, di FROM (SELECT unnest([1e-6, 0.25, 0.5, 0.75, 1.0]) AS b), (SELECT 1e-9 AS di UNION ALL SELECT pow(10, -4 + k / 5.0) FROM range(26) AS g(k))""",
    "grid_fit": f"""
        SELECT as_of_date, well_id, t0_month, n, best.sse AS sse, best.b AS b, best.di AS di, best.qi AS qi FROM (
          SELECT as_of_date, well_id, t0_month, max(n) AS n, min({{'sse': greatest(qq - fq * fq / ff, 0), 'b': b, 'di': di, 'qi': fq / ff}}) AS best FROM (
            SELECT as_of_date, well_id, t0_month, b, di, count(*) AS n, sum(q * q) AS qq, sum(f * q) AS fq, sum(f * f) AS ff FROM (
              SELECT *, {_shape('t')} AS f FROM decline_points CROSS JOIN decline_cells) GROUP BY ALL) WHERE n >= 6 GROUP BY ALL)""",
    "grid_mape": f"""
        SELECT g.as_of_date, g.well_id, avg(abs(oil_prod_m3_target - qi * {_shape("date_diff('month', t0_month, target_month)")})
          / nullif(oil_prod_m3_target, 0)) FILTER (WHERE oil_prod_m3_target > 0) * 100 AS grid_mape
        FROM grid_fit g JOIN predictions p ON g.as_of_date = p.as_of_date AND g.well_id = p.well_id GROUP BY ALL""",
    "decline_scored": f"""
        SELECT s.*, g.n IS NOT NULL AS arps_fitted, m.grid_mape AS arps_mape_nonzero_pct FROM (SELECT * FROM scored WHERE evaluable) s
        LEFT JOIN grid_fit g ON s.as_of_date = g.as_of_date AND s.well_id = g.well_id
        LEFT JOIN (SELECT g.as_of_date, g.well_id, avg(abs(oil_prod_m3_target - qi * {_shape("date_diff('month', t0_month, target_month)")})
          / nullif(oil_prod_m3_target, 0)) FILTER (WHERE oil_prod_m3_target > 0) * 100 AS grid_mape
          FROM grid_fit g JOIN predictions p ON g.as_of_date = p.as_of_date AND g.well_id = p.well_id WHERE naive_forecast_m3 IS NOT NULL GROUP BY ALL) m
          ON s.as_of_date = m.as_of_date AND s.well_id = m.well_id""",
    "decline_summary": """
        SELECT *, CASE WHEN NOT arps_degraded THEN gap END AS arps_mape_gap_pp FROM (
          SELECT as_of_date, count(*) FILTER (WHERE arps_fitted) AS arps_fitted_wells, count(*) FILTER (WHERE NOT arps_fitted) AS arps_failed_wells,
            count(*) = 0 OR count(*) FILTER (WHERE arps_fitted) < 0.5 * count(*) AS arps_degraded,
            quantile_cont(mape_nonzero_pct, 0.5) FILTER (WHERE mape_nonzero_pct IS NOT NULL AND arps_mape_nonzero_pct IS NOT NULL)
              - quantile_cont(arps_mape_nonzero_pct, 0.5) FILTER (WHERE mape_nonzero_pct IS NOT NULL AND arps_mape_nonzero_pct IS NOT NULL) AS gap
          FROM decline_scored GROUP BY as_of_date)""",
    "decline_distributions": """
        SELECT * FROM distributions UNION ALL SELECT as_of_date, 'arps_mape_nonzero_pct', quantile_cont(arps_mape_nonzero_pct, 0.5),
          quantile_cont(arps_mape_nonzero_pct, 0.75), quantile_cont(arps_mape_nonzero_pct, 0.9)
        FROM decline_scored WHERE arps_mape_nonzero_pct IS NOT NULL GROUP BY as_of_date""",
    "verdicts": """
        SELECT as_of_date, bool_and(NOT blocking OR coalesce(passed, false)) AS gates_passed FROM gates GROUP BY as_of_date""",
    "requests": """
        SELECT cast(o_custkey AS varchar) AS well_id, cast(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH AS date) AS date_start,
          cast(date_trunc('month', o_orderdate) AS date) AS date_end, o_orderkey AS request_id FROM orders""",
    "log": """
        SELECT event_id AS request_id, ts, event_type AS handler, CASE WHEN event_type = 'error' THEN '5xx' ELSE '2xx' END AS status,
          value AS latency, event_type = 'error' AS is_error FROM events""",
}

_SHOW = {
    "s": "cast({c} AS varchar)",
    "i": "cast({c} AS bigint)",
    "d": "round(cast({c} AS double), 6) + 0.0",  # no negative zero
    "t": "strftime(cast({c} AS date), '%Y-%m-%d')",
    "z": "strftime(cast({c} AS timestamp), '%Y-%m-%d %H:%M:%S')",
}


def _needed(body: str, found: list[str]) -> list[str]:
    """Relations named in ``body``, each after the ones it reads."""
    for name, sql in RELATIONS.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
            _needed(sql, found)
            if name not in found:
                found.append(name)
    return found


def statement(body: str, columns: str) -> str:
    """A complete statement: relations, body, and portable output columns."""
    shown = []
    for item in columns.split():
        kind, _, names = item.partition(":")
        shown += [f"{_SHOW[kind].format(c=n)} AS {n}" for n in names.split(",")]
    parts = [f"{name} AS ({RELATIONS[name].strip()})" for name in _needed(body, [])]
    head = "WITH " + ",\n".join([*parts, f"result AS ({body})"])
    return f"{head}\nSELECT {', '.join(shown)} FROM result"


_PRODUCTION = (
    "s:well_id,company_id,company_name,well_alias t:production_month d:oil_prod_m3,gas_prod_mm3,water_prod_m3 "
    "s:resource_type,formation,field,basin,province,dlt_load_id"
)
_REGISTRY = (
    "s:well_id,well_alias,company_id,production_formation,field,basin,province d:depth_m,latitude,longitude "
    "s:classification,sub_classification,reservoir_type,dlt_load_id"
)
_RAW = "s:idempresa,anio,mes,idpozo,prod_pet,prod_gas,prod_agua,empresa,sigla,tipo_de_recurso,formacion,areayacimiento,cuenca,provincia,_dlt_load_id"
_RAW_REG = "s:idpozo,idempresa,profundidad,coordenaday,coordenadax,sigla,formprod,areayacimiento,cuenca,provincia,clasificacion,subclasificacion,tipo_reservorio,_dlt_load_id"
_LAG_NAMES = "oil_prod_m3_lag_1m,oil_prod_m3_lag_2m,oil_prod_m3_lag_3m,oil_prod_m3_lag_6m,oil_prod_m3_lag_12m"
_MEAN_NAMES = "oil_prod_m3_roll_mean_3m,oil_prod_m3_roll_mean_6m,oil_prod_m3_roll_mean_12m"
_STD_NAMES = "oil_prod_m3_roll_std_6m,oil_prod_m3_roll_std_12m"
_TREND_NAMES = "oil_prod_m3_trend_6m,oil_prod_m3_trend_12m"
_SPAN = "i:months_with_history,well_age_months,months_since_last_observed t:last_observed_month"
_FEATURES = (
    f"s:feature_key,well_id t:as_of_date d:{_LAG_NAMES},{_MEAN_NAMES},{_STD_NAMES},{_TREND_NAMES} "
    f"{_SPAN} i:zero_months_12m s:basin,field,resource_type"
)
_TOTALS = "d:total_oil_m3,total_gas_mm3,total_water_m3"
_CHECK = "s:table_name,check_name,dimension,severity i:failing_rows s:passed i:total_rows"


def _profile(relation: str, columns: dict[str, str]) -> str:
    """Profile of each column; ``d`` columns print as decimals."""
    parts = []
    for name, kind in columns.items():
        shown = "cast(cast({}({}) AS decimal(38,6)) AS varchar)" if kind == "d" else "cast({}({}) AS varchar)"
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS row_count, count(*) - count({name}) AS null_count, "
            f"count(DISTINCT {name}) AS distinct_count, {shown.format('min', name)} AS min_value, {shown.format('max', name)} AS max_value FROM {relation}"
        )
    return " UNION ALL ".join(parts)


def _row_check(table: str, relation: str, name: str, dimension: str, fails: str, severity: str = "error") -> str:
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, '{dimension}' AS dimension, '{severity}' AS severity, "
        f"count(*) FILTER (WHERE {fails}) AS failing_rows, count(*) FILTER (WHERE {fails}) = 0 AS passed, count(*) AS total_rows FROM {relation}"
    )


def _share_check(table: str, relation: str, column: str, at_least: float) -> str:
    enough = f"count({column}) >= {at_least} * count(*)"
    return (
        f"SELECT '{table}' AS table_name, 'not_null_share_{column}' AS check_name, 'completeness' AS dimension, 'error' AS severity, "
        f"CASE WHEN {enough} THEN 0 ELSE count(*) - count({column}) END AS failing_rows, {enough} AS passed, count(*) AS total_rows FROM {relation}"
    )


def _unique_check(table: str, relation: str, columns: str) -> str:
    name = "unique_" + columns.replace(", ", "_")
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, 'uniqueness' AS dimension, 'error' AS severity, coalesce(sum(n), 0) AS failing_rows, "
        f"coalesce(sum(n), 0) = 0 AS passed, (SELECT count(*) FROM {relation}) AS total_rows "
        f"FROM (SELECT count(*) AS n FROM {relation} GROUP BY {columns} HAVING count(*) > 1)"
    )


def _recency(day: str) -> str:
    fresh = f"max(production_month) >= DATE '{day}' - INTERVAL 2 MONTH"
    return (
        f"SELECT 'typed_production' AS table_name, 'recency_production_month' AS check_name, 'freshness' AS dimension, 'warn' AS severity, "
        f"CASE WHEN {fresh} THEN 0 ELSE 1 END AS failing_rows, {fresh} AS passed, count(*) AS total_rows FROM silver"
    )


def _evidence(fails: str, name: str, dimension: str) -> str:
    return (
        f"SELECT 'typed_production' AS table_name, '{name}' AS check_name, '{dimension}' AS dimension, 'error' AS severity, "
        f"well_id, production_month FROM silver WHERE {fails}"
    )


def _buckets(select_window: str, group: str) -> str:
    """Bucket counts and the interpolated quantiles of each window."""
    bounds = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
    counts = ", ".join(f"count(*) FILTER (WHERE latency <= {b}) AS le_{i}" for i, b in enumerate(bounds))

    def quantile(q: float) -> str:
        cases = []
        for i, b in enumerate(bounds):
            low, below = (bounds[i - 1], f"le_{i - 1}") if i else (0.0, "0")
            cases.append(
                f"WHEN le_{i} >= requests * cast({q} AS double) THEN {low} + ({b} - {low}) * (requests * cast({q} AS double) - {below}) / nullif(le_{i} - {below}, 0)"
            )
        return f"CASE {' '.join(cases)} ELSE {bounds[-1]} END"

    return (
        f"SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, handler, requests, {quantile(0.5)} AS p50, {quantile(0.95)} AS p95, "
        f"{quantile(0.99)} AS p99 FROM (SELECT {select_window} AS window_start, handler, count(*) AS requests, {counts} FROM log GROUP BY {group})"
    )


def _tumbling(minutes: int = 1) -> str:
    return f"date_trunc('{'minute' if minutes == 1 else 'hour'}', ts)"


def _sliding(length: int, slide: int, keys: str, aggregates: str) -> str:
    """Every slide-aligned window of ``length`` minutes that contains a request."""
    key_list = f", {keys}" if keys else ""
    return (
        f"SELECT window_start, window_start + INTERVAL {length} MINUTE AS window_end{key_list}, {aggregates} FROM (SELECT *, "
        f"time_bucket(INTERVAL {slide} MINUTE, ts) - INTERVAL (unnest(generate_series(0, {length // slide - 1})) * {slide}) MINUTE AS window_start FROM log) "
        f"GROUP BY window_start{key_list}"
    )


_RATE = (
    f"SELECT {_tumbling()} AS window_start, {_tumbling()} + INTERVAL 1 MINUTE AS window_end, handler, count(*) AS requests, "
    f"count(*) / 60.0 AS rate_per_second FROM log GROUP BY {_tumbling()}, handler"
)
_ERRORS = (
    f"SELECT {_tumbling()} AS window_start, {_tumbling()} + INTERVAL 1 MINUTE AS window_end, count(*) AS requests, "
    f"count(*) FILTER (WHERE is_error) AS errors, 100.0 * count(*) FILTER (WHERE is_error) / count(*) AS error_pct FROM log GROUP BY {_tumbling()}"
)


_TYPED_CHECKS = " UNION ALL ".join(
    [
        *[_row_check("typed_production", "silver", f"not_null_{c}", "completeness", f"{c} IS NULL") for c in ("well_id", "company_id", "production_month")],
        _row_check("typed_production", "silver", "accepted_range_production_month", "range", "production_month < DATE '1995-01-01'"),
        *[_share_check("typed_production", "silver", c, 0.9) for c in ("oil_prod_m3", "gas_prod_mm3", "water_prod_m3")],
        *[_row_check("typed_production", "silver", f"accepted_range_{c}", "range", f"{c} < 0") for c in ("oil_prod_m3", "gas_prod_mm3", "water_prod_m3")],
        _unique_check("typed_production", "silver", "well_id, production_month"),
        _recency("2001-12-15"),
    ]
)

_BUILT_FEATURES = "(SELECT * FROM features WHERE as_of_date IN (DATE '2001-04-01', DATE '2001-05-01'))"


def _listed(table: str, relation: str, name: str, failing: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, 'integrity' AS dimension, 'error' AS severity, "
        f"({failing}) AS failing_rows, ({failing}) = 0 AS passed, count(*) AS total_rows FROM {relation}"
    )


def _missing_parent(key: str, parent: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM fact WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {parent} WHERE {where})"


_GATES = " UNION ALL ".join(
    [
        f"SELECT * FROM ({_TYPED_CHECKS})",
        _row_check("typed_registry", "registry", "not_null_well_id", "completeness", "well_id IS NULL"),
        _unique_check("typed_registry", "registry", "well_id"),
        *[
            part
            for table, key, business in (("dim_well", "well_key", "well_id"), ("dim_company", "company_key", "company_id"), ("dim_date", "date_key", "production_month"))
            for part in (
                _row_check(table, table, f"not_null_{key}", "completeness", f"{key} IS NULL"),
                _unique_check(table, table, key),
                _row_check(table, table, f"not_null_{business}", "completeness", f"{business} IS NULL"),
            )
        ],
        _row_check("fact_production", "fact", "not_null_production_key", "completeness", "production_key IS NULL"),
        _unique_check("fact_production", "fact", "production_key"),
        *[
            _listed("fact_production", "fact", f"relationships_{key}", _missing_parent(key, parent))
            for key, parent in (("well_key", "dim_well"), ("company_key", "dim_company"), ("date_key", "dim_date"))
        ],
        *[
            _row_check("well_features", _BUILT_FEATURES, f"not_null_{c}", "completeness", f"{c} IS NULL")
            for c in (
                "feature_key", "well_id", "as_of_date", "months_with_history", "well_age_months", "months_since_last_observed", "zero_months_12m",
                "last_observed_month",
            )
        ],
        _unique_check("well_features", _BUILT_FEATURES, "feature_key"),
        _unique_check("well_features", _BUILT_FEATURES, "well_id, as_of_date"),
        _listed("well_features", _BUILT_FEATURES, "point_in_time", "SELECT 0"),
        _listed("fact_production damaged", "fact", "relationships_well_key", _missing_parent("well_key", "dim_well", "depth_m IS NOT NULL")),
        _listed("well_features damaged", _BUILT_FEATURES, "point_in_time", f"SELECT count(*) FROM {_BUILT_FEATURES} WHERE months_with_history = 12"),
    ]
)

_TOP_TOTALS = (
    "SELECT well_alias, v.fluid_type, v.total_volume FROM (SELECT w.well_alias, sum(oil_prod_m3) AS o, sum(gas_prod_mm3) AS g, sum(water_prod_m3) AS a "
    "FROM fact f JOIN dim_well w ON f.well_key = w.well_key {where} GROUP BY w.well_alias) AS x, LATERAL (SELECT 'Petróleo' AS fluid_type, x.o AS total_volume "
    "UNION ALL SELECT 'Gas', x.g UNION ALL SELECT 'Agua', x.a) AS v"
)
_TOP20 = " ORDER BY total_volume DESC NULLS LAST, well_alias ASC NULLS LAST, fluid_type LIMIT 20"

_SPLIT = (
    "SELECT as_of_date, CASE WHEN as_of_date = DATE '2001-08-01' THEN 'test' WHEN rn <= 4 THEN 'validation' ELSE 'train' END AS split "
    "FROM (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date DESC) AS rn FROM (SELECT DISTINCT as_of_date FROM {source}) WHERE as_of_date <= DATE '2001-08-01')"
)

_DAYS = "(SELECT cast(o_orderdate AS date) AS day, count(*) AS n_orders FROM orders GROUP BY cast(o_orderdate AS date))"

_DECLINE_INPUT = (
    "SELECT e.as_of_date, s.well_id, min(s.production_month) AS t0_month, count(*) FILTER (WHERE y > 0) AS positive_months, "
    "sum(y) FILTER (WHERE y > 0) AS q_sum, sum(date_diff('month', t0.m, s.production_month)) FILTER (WHERE y > 0) AS t_sum "
    "FROM (SELECT * FROM series WHERE y IS NOT NULL) s JOIN (SELECT well_id, min(production_month) AS m FROM series WHERE y IS NOT NULL GROUP BY well_id) t0 "
    "ON s.well_id = t0.well_id JOIN evaluated e ON s.production_month < e.as_of_date GROUP BY e.as_of_date, s.well_id"
)

_BASIC_SUMMARY = "i:wells_in_test,wells_eligible,wells_excluded_short_history,wells_mase_undefined"

ORACLES: dict[str, tuple[str, str]] = {
    "s01_raw_scan": ("SELECT * FROM raw_production", _RAW),
    "s02_header_cleanup": (
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = '') AS empty_cells FROM raw_production" for c in _RAW[2:].split(",")
        ),
        "s:column_name i:empty_cells",
    ),
    "s03_tagged_load": (
        "SELECT 'production_by_well' AS source_name, '2001-11-01' AS partition_key, '000000000042' AS load_id, idempresa, count(*) AS n_rows FROM raw_production GROUP BY idempresa",
        "s:source_name,partition_key,load_id,idempresa i:n_rows",
    ),
    "s04_full_refresh": ("SELECT * FROM raw_registry", _RAW_REG),
    "s06_full_table": ("SELECT * FROM registry", _REGISTRY),
    "s07_replace_periods": (
        "SELECT * FROM silver WHERE production_month < DATE '2001-01-01' OR oil_prod_m3 IS NOT NULL",
        "s:well_id t:production_month d:oil_prod_m3",
    ),
    "s08_upsert_by_key": (
        "SELECT production_key, well_id, production_month, CASE WHEN production_month >= DATE '2001-01-01' THEN oil_prod_m3 * 2 ELSE oil_prod_m3 END AS oil_prod_m3 FROM fact",
        "s:production_key,well_id t:production_month d:oil_prod_m3",
    ),
    "s09_schema_drift": (
        "SELECT well_id, production_month, CASE WHEN production_month >= DATE '2000-01-01' THEN province END AS province FROM silver",
        "s:well_id t:production_month s:province",
    ),
    "s10_range_rebuild": ("SELECT * FROM silver WHERE production_month >= DATE '2000-01-01' AND production_month < DATE '2000-07-01'", _PRODUCTION),
    "s11_logical_view": (
        "SELECT basin, year, sum(oil_prod_m3) AS oil_prod_m3, count(*) AS n_rows FROM monthly_view GROUP BY basin, year",
        "s:basin i:year d:oil_prod_m3 i:n_rows",
    ),
    "s13_training_read": (
        "SELECT as_of_date, count(*) AS n_rows, sum(months_with_history) AS months, (SELECT count(*) FROM fact) AS series_rows FROM features WHERE as_of_date <= DATE '2001-03-01' GROUP BY as_of_date",
        "t:as_of_date i:n_rows d:months i:series_rows",
    ),
    "s14_typed_extract": (
        "SELECT as_of_date, basin, count(*) AS n_rows, sum(oil_prod_m3_lag_1m) AS lag_1m, max(last_observed_month) AS last_observed_month FROM features GROUP BY as_of_date, basin",
        "t:as_of_date s:basin i:n_rows d:lag_1m t:last_observed_month",
    ),
    "p01_type_production": ("SELECT * FROM typed", _PRODUCTION),
    "p02_type_registry": ("SELECT * FROM reg_typed", _REGISTRY),
    "p03_blank_to_null": (
        f"SELECT {_blank('empresa')} AS company_name, {_blank('areayacimiento')} AS field, count(*) AS n_rows, count(*) FILTER (WHERE {_blank('sigla')} IS NULL) AS blank_alias FROM raw_production GROUP BY 1, 2",
        "s:company_name,field i:n_rows,blank_alias",
    ),
    "p04_non_negative": (
        f"SELECT trim(prod_pet) AS reported, {_measure('prod_pet')} AS oil_prod_m3, count(*) AS n_rows FROM raw_production GROUP BY 1, 2",
        "s:reported d:oil_prod_m3 i:n_rows",
    ),
    "p05_period_from_parts": ("SELECT production_month, count(*) AS n_rows FROM typed GROUP BY 1", "t:production_month i:n_rows"),
    "p06_drop_blank_keys": (
        "SELECT count(*) AS kept_declarations, (SELECT count(*) FROM reg_typed) AS kept_registry_rows FROM typed",
        "i:kept_declarations,kept_registry_rows",
    ),
    "p07_point_in_time": ("SELECT * FROM silver WHERE production_month < DATE '2001-08-01'", "s:well_id t:production_month d:oil_prod_m3"),
    "p08_half_open_range": (
        "SELECT * FROM silver WHERE production_month >= DATE '2000-03-01' AND production_month < DATE '2000-06-01'",
        "s:well_id t:production_month d:oil_prod_m3,gas_prod_mm3,water_prod_m3",
    ),
    "p09_production_window": (
        "SELECT r.well_id, request_id, production_month AS date, coalesce(oil_prod_m3, 0.0) AS prod FROM requests r JOIN fact f ON r.well_id = f.well_id AND production_month BETWEEN date_start AND date_end",
        "s:well_id i:request_id t:date d:prod",
    ),
    "p10_optional_filters": (
        "SELECT * FROM by_fluid WHERE well_alias ILIKE '%RED%' AND production_month = DATE '2000-05-01' AND fluid_type = 'Petróleo'",
        "s:well_alias,company_name t:production_month s:fluid_type d:volume",
    ),
    "p11_null_safe_inequality": (
        "SELECT r.well_id, r.field AS registry_field, a.field AS production_field FROM registry r JOIN attrs a ON r.well_id = a.well_id WHERE r.field IS DISTINCT FROM a.field",
        "s:well_id,registry_field,production_field",
    ),
    "p12_tolerance": (
        "SELECT * FROM history WHERE as_of_date = DATE '2001-08-01' AND ((oil_prod_m3_roll_mean_6m IS NULL) <> (oil_prod_m3_roll_mean_12m IS NULL) OR abs(oil_prod_m3_roll_mean_6m - oil_prod_m3_roll_mean_12m) > 1.0)",
        "s:well_id d:oil_prod_m3_roll_mean_6m,oil_prod_m3_roll_mean_12m",
    ),
    "p13_priority_merge": ("SELECT * FROM dim_well", "s:well_id,well_alias,field,basin,province"),
    "p14_contract_order": (
        "SELECT basin, field, count(*) AS n_rows, sum(zero_months_12m) AS zero_months FROM features WHERE as_of_date = DATE '2001-08-01' GROUP BY basin, field",
        "s:basin,field i:n_rows,zero_months",
    ),
    "p15_lenient_coercion": (
        "SELECT idempresa, count(*) FILTER (WHERE try_cast(trim(prod_gas) AS double) IS NULL) AS unreadable, sum(cast(try_cast(trim(prod_gas) AS double) AS decimal(18,2))) AS gas FROM raw_production GROUP BY idempresa",
        "s:idempresa i:unreadable d:gas",
    ),
    "p16_strict_coercion": (
        "SELECT well_id, max(cast(oil_prod_m3 AS double)) AS max_oil, count(oil_prod_m3) AS n_oil FROM silver GROUP BY well_id",
        "s:well_id d:max_oil i:n_oil",
    ),
    "p17_model_input": (
        "SELECT as_of_date, count(*) AS n_rows, coalesce(sum(oil_prod_m3_lag_1m), 0) AS lag_1m, count(*) - count(oil_prod_m3_lag_12m) AS missing_lag_12m, sum(horizon) AS horizons FROM dataset GROUP BY as_of_date",
        "t:as_of_date i:n_rows d:lag_1m,missing_lag_12m,horizons",
    ),
    "p18_known_wells": ("SELECT request_id, well_id FROM requests WHERE well_id IN (SELECT well_id FROM dim_well)", "i:request_id s:well_id"),
    "p19_feature_lookup": (
        "SELECT h.* FROM history h JOIN (SELECT DISTINCT well_id, date_end FROM requests) r ON h.well_id = r.well_id AND h.as_of_date = r.date_end",
        "s:well_id t:as_of_date d:oil_prod_m3_lag_1m i:months_with_history",
    ),
    "j01_fact_to_dimensions": ("SELECT * FROM monthly_view", "s:well_id t:production_month s:company_name,month_name d:oil_prod_m3"),
    "j02_universe_attributes": ("SELECT * FROM dim_well", "s:well_id d:depth_m,latitude s:classification,formation,resource_type"),
    "j03_static_attributes": ("SELECT * FROM features WHERE as_of_date = DATE '2001-08-01'", "s:well_id t:as_of_date s:basin,field,resource_type"),
    "j04_known_at_cutoffs": (
        "SELECT as_of_date, count(*) AS known_rows, sum(oil_prod_m3) AS known_oil_m3 FROM fact JOIN cutoffs ON production_month < as_of_date GROUP BY as_of_date",
        "t:as_of_date i:known_rows d:known_oil_m3",
    ),
    "j05_full_outer_diff": (
        "SELECT coalesce(a.well_id, b.well_id) AS well_id, austral, neuquina FROM (SELECT well_id, count(*) AS austral FROM silver WHERE basin = 'AUSTRAL' GROUP BY 1) a "
        "FULL OUTER JOIN (SELECT well_id, count(*) AS neuquina FROM silver WHERE basin = 'NEUQUINA' GROUP BY 1) b ON a.well_id = b.well_id WHERE austral IS DISTINCT FROM neuquina",
        "s:well_id i:austral,neuquina",
    ),
    "j06_asof_backward": (
        "SELECT request_id, r.well_id, date_end AS as_of_date, y AS naive_forecast_m3 FROM requests r ASOF LEFT JOIN series s ON r.well_id = s.well_id AND r.date_end > s.production_month",
        "i:request_id s:well_id t:as_of_date d:naive_forecast_m3",
    ),
    "j06_asof_skip_nulls": (
        "SELECT request_id, r.well_id, date_end AS as_of_date, y AS last_value_m3 FROM requests r ASOF LEFT JOIN (SELECT * FROM series WHERE y IS NOT NULL) s ON r.well_id = s.well_id AND r.date_end > s.production_month",
        "i:request_id s:well_id t:as_of_date d:last_value_m3",
    ),
    "j07_attach_target": ("SELECT * FROM dataset", "s:well_id t:as_of_date i:horizon t:target_month d:oil_prod_m3_target"),
    "j08_unpivot_fluids": (
        "SELECT well_id, production_month, v.fluid_type, v.volume FROM silver s, LATERAL (SELECT 'Petróleo' AS fluid_type, s.oil_prod_m3 AS volume UNION ALL SELECT 'Gas', s.gas_prod_mm3 UNION ALL SELECT 'Agua', s.water_prod_m3) AS v",
        "s:well_id t:production_month s:fluid_type d:volume",
    ),
    "j09_semi_eligible": (
        "SELECT d.* FROM dataset d WHERE (as_of_date, well_id) IN (SELECT as_of_date, well_id FROM observed WHERE months_observed >= 12)",
        "s:well_id t:as_of_date i:horizon d:oil_prod_m3_target",
    ),
    "j10_orphans": (
        "SELECT well_id, production_month FROM fact WHERE well_key NOT IN (SELECT well_key FROM dim_well WHERE depth_m IS NOT NULL)",
        "s:well_id t:production_month",
    ),
    "j11_horizon_expansion": (
        "SELECT cast(as_of_date + INTERVAL (h - 1) MONTH AS date) AS target_month, h AS horizon, count(*) AS n_rows FROM history, generate_series(1, 12) AS g(h) GROUP BY 1, 2",
        "t:target_month i:horizon,n_rows",
    ),
    "j12_failing_share": (
        "SELECT f.production_month, dimension, failing_rows, total_rows, round(failing_rows * 100.0 / total_rows, 2) AS failing_pct FROM "
        "(SELECT production_month, 'range' AS dimension, count(*) AS failing_rows FROM silver WHERE oil_prod_m3 > 45 GROUP BY 1 UNION ALL "
        "SELECT production_month, 'completeness', count(*) FROM silver WHERE well_alias IS NULL GROUP BY 1) f JOIN "
        "(SELECT production_month, count(*) AS total_rows FROM silver GROUP BY 1) t ON f.production_month = t.production_month",
        "t:production_month s:dimension i:failing_rows,total_rows d:failing_pct",
    ),
    "j13_align_denominators": (
        "SELECT * FROM scored WHERE as_of_date = DATE '2001-08-01'",
        "s:well_id d:model_mae_m3,insample_naive_mae_m3 i:months_observed d:mase",
    ),
    "a01_lifetime_totals": (
        "SELECT well_id, sum(oil_prod_m3) AS total_oil_m3, sum(gas_prod_mm3) AS total_gas_mm3, sum(water_prod_m3) AS total_water_m3 FROM silver GROUP BY well_id",
        f"s:well_id {_TOTALS}",
    ),
    "a02_history_by_fluid": ("SELECT production_month, fluid_type, sum(volume) AS total_volume FROM by_fluid GROUP BY 1, 2", "t:production_month s:fluid_type d:total_volume"),
    "a03_totals_by_alias": (_TOP_TOTALS.format(where=""), "s:well_alias,fluid_type d:total_volume"),
    "a04_lags": ("SELECT * FROM history", f"s:well_id t:as_of_date d:{_LAG_NAMES}"),
    "a05_rolling_means": ("SELECT * FROM history", f"s:well_id t:as_of_date d:{_MEAN_NAMES}"),
    "a06_rolling_stddev": ("SELECT * FROM history", f"s:well_id t:as_of_date d:{_STD_NAMES}"),
    "a07_trend": ("SELECT * FROM history", f"s:well_id t:as_of_date d:{_TREND_NAMES}"),
    "a08_zero_months": ("SELECT * FROM history", "s:well_id t:as_of_date i:zero_months_12m"),
    "a09_history_span": ("SELECT * FROM history", f"s:well_id t:as_of_date {_SPAN}"),
    "a10_default_cutoff": ("SELECT max(production_month) + INTERVAL 1 MONTH AS as_of_date FROM silver", "t:as_of_date"),
    "a11_distinct_months": ("SELECT DISTINCT production_month FROM silver", "t:production_month"),
    "a12_eligible_wells": ("SELECT * FROM observed WHERE months_observed >= 12", "t:as_of_date s:well_id"),
    "a13_one_step_naive_mae": ("SELECT * FROM observed WHERE insample_naive_mae_m3 IS NOT NULL", "t:as_of_date s:well_id d:insample_naive_mae_m3"),
    "a14_per_well_metrics": ("SELECT * FROM scored WHERE scored_rows > 0", "t:as_of_date s:well_id d:model_mae_m3,model_rmse_m3,naive_mae_m3,mape_nonzero_pct,mase"),
    "a15_pooled_metrics": (
        "SELECT avg(abs(oil_prod_m3_target - prediction_m3)) FILTER (WHERE t AND n) AS model_mae_m3, sqrt(avg((oil_prod_m3_target - prediction_m3) ** 2) FILTER (WHERE t AND n)) AS model_rmse_m3, "
        "avg(abs(oil_prod_m3_target - naive_forecast_m3)) FILTER (WHERE t AND n) AS naive_mae_m3, sqrt(avg((oil_prod_m3_target - naive_forecast_m3) ** 2) FILTER (WHERE t AND n)) AS naive_rmse_m3, "
        "count(*) FILTER (WHERE as_of_date < DATE '2001-05-01') AS train_rows, count(*) FILTER (WHERE as_of_date >= DATE '2001-05-01' AND NOT t) AS validation_rows, count(*) FILTER (WHERE t) AS test_rows "
        "FROM (SELECT *, as_of_date = DATE '2001-08-01' AS t, naive_forecast_m3 IS NOT NULL AS n FROM predictions)",
        "d:model_mae_m3,model_rmse_m3,naive_mae_m3,naive_rmse_m3 i:train_rows,validation_rows,test_rows",
    ),
    "a16_quantiles": (
        "SELECT basin, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.75) AS p75, quantile_cont(y, 0.9) AS p90 FROM (SELECT basin, cast(oil_prod_m3 AS double) AS y FROM silver WHERE oil_prod_m3 IS NOT NULL) GROUP BY basin",
        "s:basin d:p50,p75,p90",
    ),
    "a17_portfolio": (
        "SELECT *, model_mae_m3 / naive_mae_m3 AS naive_mae_ratio FROM coverage",
        "t:as_of_date d:mase_median,naive_mae_ratio,model_mae_m3,naive_mae_m3",
    ),
    "a18_coverage": ("SELECT * FROM coverage", f"t:as_of_date {_BASIC_SUMMARY}"),
    "a19_materialisation_metadata": (
        "SELECT c.as_of_date, (SELECT count(*) FROM history h WHERE h.as_of_date = c.as_of_date) AS row_count, min(production_month) AS source_date_start, max(production_month) AS source_date_end "
        "FROM cutoffs c JOIN fact ON production_month < c.as_of_date GROUP BY c.as_of_date",
        "t:as_of_date i:row_count t:source_date_start,source_date_end",
    ),
    "a21_control_totals": (
        "SELECT production_month, count(*) AS n_rows, sum(oil_prod_m3) AS oil_prod_m3 FROM silver WHERE production_month >= DATE '2000-01-01' AND production_month < DATE '2000-04-01' GROUP BY 1",
        "t:production_month i:n_rows d:oil_prod_m3",
    ),
    "a22_duplicates": ("SELECT well_id, production_month, count(*) AS n FROM typed GROUP BY 1, 2 HAVING count(*) > 1", "s:well_id t:production_month i:n"),
    "a23_profile": (
        _profile("silver", {c: "s" for c in ("well_id", "company_id", "company_name", "well_alias", "production_month", "oil_prod_m3", "gas_prod_mm3", "water_prod_m3", "resource_type", "formation", "field", "basin", "province", "dlt_load_id")}),
        "s:column_name i:row_count,null_count,distinct_count s:min_value,max_value",
    ),
    "a23_profile_documents": (
        _profile("documents", {c: "s" for c in ("doc_id", "text", "lang", "source", "n_chars")}),
        "s:column_name i:row_count,null_count,distinct_count s:min_value,max_value",
    ),
    "w01_latest_load": ("SELECT * FROM silver", "s:well_id t:production_month s:dlt_load_id,company_id d:oil_prod_m3,gas_prod_mm3,water_prod_m3"),
    "w02_first_name": ("SELECT * FROM dim_company", "s:company_id,company_name"),
    "w03_latest_attributes": ("SELECT * FROM attrs", "s:well_id,well_alias,field,basin,province,formation,resource_type"),
    "w04_global_rank": (
        "SELECT well_id, total_oil_m3, row_number() OVER (ORDER BY total_oil_m3 DESC NULLS LAST, well_id) AS oil_volume_rank FROM (SELECT well_id, sum(oil_prod_m3) AS total_oil_m3 FROM silver GROUP BY 1)",
        "s:well_id d:total_oil_m3 i:oil_volume_rank",
    ),
    "w05_step_differences": ("SELECT * FROM steps", "s:well_id t:production_month d:y,step_m3"),
    "w06_recent_peak": (
        "SELECT well_id, max(y) AS recent_peak_m3, count(*) AS producing_months FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY production_month DESC) AS rn FROM series WHERE y > 0) WHERE rn <= 12 GROUP BY well_id",
        "s:well_id d:recent_peak_m3 i:producing_months",
    ),
    "w07_validation_cutoffs": (_SPLIT.format(source="history"), "t:as_of_date s:split"),
    "t01_production_order": ("SELECT * FROM by_fluid WHERE fluid_type = 'Gas'", "s:well_alias,company_name t:production_month s:fluid_type d:volume"),
    "t02_top_by_fluid": (_TOP_TOTALS.format(where="") + _TOP20, "s:well_alias,fluid_type d:total_volume"),
    "t03_evidence_sample": (
        "SELECT well_id, production_month, 'accepted_range_oil_prod_m3' AS check_name FROM silver WHERE oil_prod_m3 > 45 AND production_month = DATE '2000-05-01' ORDER BY well_id LIMIT 50",
        "s:well_id t:production_month s:check_name",
    ),
    "t04_dataset_order": ("SELECT * FROM dataset", "t:as_of_date s:well_id i:horizon d:oil_prod_m3_target"),
    "u01_well_universe": ("SELECT * FROM universe", "s:well_id"),
    "u02_union_of_horizons": (
        "SELECT well_id, as_of_date, horizon, cast(as_of_date + INTERVAL (horizon - 1) MONTH AS date) AS target_month FROM history CROSS JOIN horizons",
        "s:well_id t:as_of_date i:horizon t:target_month",
    ),
    "x01_text_functions": (
        f"SELECT {_blank('idpozo')} AS well_id, coalesce({_blank('cuenca')}, {_blank('provincia')}, '-') AS place, CASE WHEN trim(profundidad) = '' THEN 0.0 ELSE cast({_blank('profundidad')} AS double) END AS depth FROM raw_registry",
        "s:well_id,place d:depth",
    ),
    "x02_surrogate_key": (
        f"SELECT well_id, production_month, {_key('well_id', 'production_month')} AS production_key, {_key('well_alias')} AS alias_key FROM silver",
        "s:well_id t:production_month s:production_key,alias_key",
    ),
    "x03_month_arithmetic": (
        f"SELECT day, n_orders, date_trunc('month', day) AS month, date_trunc('month', day) - INTERVAL 1 MONTH AS month_before, date_trunc('month', day) + INTERVAL 12 MONTH AS year_after FROM {_DAYS}",
        "t:day i:n_orders t:month,month_before,year_after",
    ),
    "x04_date_parts": (f"SELECT day, year(day) AS y, month(day) AS m, quarter(day) AS q FROM {_DAYS}", "t:day i:y,m,q"),
    "x05_month_name": ("SELECT * FROM dim_date", "t:production_month s:month_name"),
    "x06_whole_months": ("SELECT well_id, date_diff('month', min(production_month), max(production_month)) AS months FROM silver GROUP BY 1", "s:well_id i:months"),
    "x07_month_index": (f"SELECT day, year(day) * 12 + month(day) AS month_index FROM {_DAYS}", "t:day d:month_index"),
    "x08_month_offset": (
        f"SELECT day, date_trunc('month', day) + INTERVAL 1 MONTH AS plus_1, date_trunc('month', day) + INTERVAL 5 MONTH AS plus_5, date_trunc('month', day) + INTERVAL 12 MONTH AS plus_12 FROM {_DAYS}",
        "t:day,plus_1,plus_5,plus_12",
    ),
    "x09_numeric_functions": (
        "SELECT well_id, sqrt(avg(power(y - 10, 2))) AS rms, max(abs(y - 10)) AS widest, round(avg(y), 2) AS mean_2 FROM series GROUP BY well_id",
        "s:well_id d:rms,widest,mean_2",
    ),
    "x10_ilike": ("SELECT * FROM registry WHERE well_alias ILIKE '%RED%'", "s:well_id,well_alias"),
    "x11_definition_hash": (
        "SELECT as_of_date, count(*) AS n_rows, sha256(cast(as_of_date AS varchar) || '|features-1') AS feature_version FROM history GROUP BY as_of_date",
        "t:as_of_date i:n_rows s:feature_version",
    ),
    "q01_schema_contract": ("SELECT * FROM silver", _PRODUCTION),
    "q02_not_null": ("SELECT * FROM silver WHERE well_alias IS NULL", "s:well_id t:production_month"),
    "q03_unique": ("SELECT well_id, count(*) AS n FROM reg_typed GROUP BY 1 HAVING count(*) > 1", "s:well_id i:n"),
    "q04_unique_combination": ("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "i:l_orderkey,l_linenumber,n"),
    "q05_accepted_range": ("SELECT * FROM silver WHERE oil_prod_m3 < 2 OR oil_prod_m3 > 45", "s:well_id t:production_month d:oil_prod_m3"),
    "q06_not_null_share": (
        " UNION ALL ".join(_share_check("typed_production", "silver", c, 0.95) for c in ("oil_prod_m3", "gas_prod_mm3", "water_prod_m3", "well_alias", "field")),
        _CHECK,
    ),
    "q07_recency": (" UNION ALL ".join([_recency("2001-12-15"), _recency("2002-06-15")]), _CHECK),
    "q08_relationships": (
        " UNION ALL ".join(
            f"SELECT 'labels' AS table_name, 'relationships_doc_id' AS check_name, 'integrity' AS dimension, 'error' AS severity, count(*) FILTER (WHERE NOT found) AS failing_rows, "
            f"count(*) FILTER (WHERE NOT found) = 0 AS passed, count(*) AS total_rows FROM (SELECT doc_id IN (SELECT doc_id FROM documents WHERE {cond}) AS found FROM labels)"
            for cond in ("true", "lang = 'en'")
        ),
        _CHECK,
    ),
    "q09_point_in_time_audit": (
        "SELECT well_id, as_of_date, months_since_last_observed >= 12 AS missing_in_store, false AS missing_in_fact FROM features WHERE as_of_date IN (SELECT as_of_date FROM evaluated) "
        "AND (months_since_last_observed >= 12 OR (basin = 'AUSTRAL' AND oil_prod_m3_lag_1m IS NOT NULL))",
        "s:well_id t:as_of_date s:missing_in_store,missing_in_fact",
    ),
    "q10_feature_contract": ("SELECT as_of_date, count(*) AS n_rows FROM history GROUP BY 1", "t:as_of_date i:n_rows"),
    "q11_failing_rows": (
        " UNION ALL ".join([_evidence("oil_prod_m3 > 45", "accepted_range_oil_prod_m3", "range"), _evidence("field IS NULL", "not_null_field", "completeness")]),
        "s:table_name,check_name,dimension,severity,well_id t:production_month",
    ),
    "q12_blocking_gate": ("SELECT production_month, count(*) AS n_rows FROM fact GROUP BY 1", "t:production_month i:n_rows"),
    "q13_failed_checks": (
        "SELECT * FROM ("
        + " UNION ALL ".join(
            [
                _TYPED_CHECKS,
                _recency("2003-01-01"),
                _row_check("typed_production", "silver", "accepted_range_oil_prod_m3", "range", "oil_prod_m3 < 0 OR oil_prod_m3 > 45"),
                _row_check("typed_production", "silver", "not_null_well_alias", "completeness", "well_alias IS NULL"),
                _unique_check("typed_production", "silver", "well_id"),
            ]
        )
        + ") WHERE NOT passed",
        "s:table_name,check_name,severity",
    ),
    "q14_fitness": (
        "SELECT production_month, n AS failing_rows, total AS total_rows, CASE WHEN n = 0 THEN 'fit' WHEN n * 100.0 < total THEN 'fit_with_remark' ELSE 'unfit' END AS fitness "
        "FROM (SELECT production_month, count(*) FILTER (WHERE oil_prod_m3 > 49) AS n, count(*) AS total FROM silver GROUP BY 1)",
        "t:production_month i:failing_rows,total_rows s:fitness",
    ),
    "q14_fitness_unfit": (
        "WITH m AS (SELECT *, count(*) OVER (PARTITION BY well_id, resource_type, formation, company_id) AS again FROM silver), "
        "c AS (SELECT production_month, count(*) AS total, count(*) FILTER (WHERE oil_prod_m3 > 49) AS r, "
        "count(*) FILTER (WHERE company_name IS NULL) + count(*) FILTER (WHERE again > 1) AS other FROM m GROUP BY 1) "
        "SELECT production_month, r + other AS failing_rows, total AS total_rows, "
        "CASE WHEN r + other = 0 THEN 'fit' WHEN other = 0 AND r * 100.0 < total THEN 'fit_with_remark' ELSE 'unfit' END AS fitness FROM c",
        "t:production_month i:failing_rows,total_rows s:fitness",
    ),
    "q_text_tables": (
        " UNION ALL ".join(
            [
                _row_check("documents", "documents", "not_null_doc_id", "completeness", "doc_id IS NULL"),
                _row_check("documents", "documents", "not_null_text", "completeness", "text IS NULL"),
                _unique_check("documents", "documents", "doc_id"),
                _row_check("documents", "documents", "accepted_range_n_chars", "range", "n_chars < 1"),
                _share_check("documents", "documents", "lang", 0.9),
                _row_check("conversations", "conversations", "not_null_text", "completeness", "text IS NULL"),
                _unique_check("conversations", "conversations", "conv_id, turn"),
                _row_check("conversations", "conversations", "accepted_range_turn", "range", "turn < 0"),
            ]
        ),
        _CHECK,
    ),
    "f01_typed_production": ("SELECT * FROM silver", _PRODUCTION),
    "f02_typed_registry": ("SELECT * FROM registry", _REGISTRY),
    "f03_dim_well": (
        "SELECT * FROM dim_well",
        "s:well_key,well_id,well_alias,field,basin,province d:depth_m,latitude,longitude s:classification,sub_classification,reservoir_type,formation,resource_type",
    ),
    "f04_dim_company": ("SELECT * FROM dim_company", "s:company_key,company_id,company_name"),
    "f05_dim_date": ("SELECT * FROM dim_date", "s:date_key t:production_month i:year,month,quarter s:month_name"),
    "f06_fact_production": ("SELECT * FROM fact", "s:production_key,well_key,company_key,date_key,well_id t:production_month d:oil_prod_m3,gas_prod_mm3,water_prod_m3"),
    "f07_monthly_production": (
        "SELECT * FROM monthly_view",
        "t:production_month i:year,month s:month_name,well_id,well_alias,field,basin,province,company_name d:oil_prod_m3,gas_prod_mm3,water_prod_m3",
    ),
    "f08_top_wells": (
        "SELECT w.well_id, w.well_alias, w.field, w.basin, w.province, t.total_oil_m3, t.total_gas_mm3, t.total_water_m3, row_number() OVER (ORDER BY t.total_oil_m3 DESC NULLS LAST, w.well_id) AS oil_volume_rank "
        "FROM (SELECT well_key, sum(oil_prod_m3) AS total_oil_m3, sum(gas_prod_mm3) AS total_gas_mm3, sum(water_prod_m3) AS total_water_m3 FROM fact GROUP BY 1) t JOIN dim_well w ON t.well_key = w.well_key",
        f"s:well_id,well_alias,field,basin,province {_TOTALS} i:oil_volume_rank",
    ),
    "f09_production_by_fluid": ("SELECT * FROM by_fluid", "s:well_alias,company_name t:production_month s:fluid_type d:volume"),
    "f09_history_since": (
        "SELECT production_month, fluid_type, sum(volume) AS total_volume FROM by_fluid WHERE production_month >= DATE '2000-01-01' AND fluid_type = 'Agua' GROUP BY 1, 2",
        "t:production_month s:fluid_type d:total_volume",
    ),
    "f09_top_named": (_TOP_TOTALS.format(where="WHERE w.well_alias ILIKE '%ring%'") + _TOP20, "s:well_alias,fluid_type d:total_volume"),
    "f10_well_features": ("SELECT * FROM features", _FEATURES),
    "f11_training_dataset": (
        "SELECT * FROM dataset",
        "s:well_id t:as_of_date i:horizon t:target_month d:oil_prod_m3_target,naive_forecast_m3,oil_prod_m3_lag_1m s:basin",
    ),
    "f12_temporal_split": (
        "SELECT d.well_id, d.as_of_date, d.horizon, s.split FROM dataset d JOIN (" + _SPLIT.format(source="dataset") + ") s ON d.as_of_date = s.as_of_date",
        "s:well_id t:as_of_date i:horizon s:split",
    ),
    "f12_purged_split": (
        "SELECT s.split, d.as_of_date, count(*) AS n_rows, max(target_month) AS last_target FROM dataset d JOIN (" + _SPLIT.format(source="dataset")
        + ") s ON d.as_of_date = s.as_of_date WHERE s.split <> 'train' OR target_month < DATE '2001-08-01' GROUP BY 1, 2",
        "s:split t:as_of_date i:n_rows t:last_target",
    ),
    "f13_scored_rows": (
        "SELECT as_of_date, horizon, count(*) AS n_rows, count(*) AS n_scored FROM dataset WHERE as_of_date = DATE '2001-08-01' GROUP BY 1, 2",
        "t:as_of_date i:horizon,n_rows,n_scored",
    ),
    "f14_forecast_frame": (
        "WITH asked AS (SELECT DISTINCT well_id, date_end AS as_of_date, date_end + INTERVAL 1 MONTH AS cutoff FROM requests), "
        "known AS (SELECT a.*, f.well_id IS NOT NULL AS found FROM asked a LEFT JOIN features f ON f.well_id = a.well_id AND f.as_of_date = a.cutoff) "
        "SELECT well_id, as_of_date, h AS horizon, cutoff + INTERVAL (h - 1) MONTH AS month, h > 3 AS extrapolated, 'ok' AS status "
        "FROM known, (SELECT unnest(range(1, 7)) AS h) WHERE found "
        "UNION ALL SELECT well_id, as_of_date, NULL, NULL, NULL, 'missing' FROM known WHERE NOT found",
        "s:well_id t:as_of_date i:horizon t:month s:extrapolated,status",
    ),
    "f13_scored_by_nodes": (
        "SELECT horizon, count(*) AS n_rows, count(*) AS n_agreeing FROM dataset WHERE as_of_date = DATE '2001-08-01' GROUP BY 1", "i:horizon,n_rows,n_agreeing",
    ),
    "f14_forecast_by_nodes": (
        "WITH asked AS (SELECT DISTINCT well_id, date_end + INTERVAL 1 MONTH AS as_of_date FROM requests) "
        "SELECT h AS horizon, count(*) AS n_rows, count(*) AS n_agreeing FROM asked JOIN features USING (well_id, as_of_date), (SELECT unnest(range(1, 7)) AS h) GROUP BY 1",
        "i:horizon,n_rows,n_agreeing",
    ),
    "f15_persistence": (
        "SELECT h.well_id, h.as_of_date, s.y AS naive_forecast_m3 FROM history h LEFT JOIN series s ON s.well_id = h.well_id AND s.production_month = h.last_observed_month",
        "s:well_id t:as_of_date d:naive_forecast_m3",
    ),
    "f16_decline_inputs": (_DECLINE_INPUT, "t:as_of_date s:well_id t:t0_month i:positive_months d:t_sum,q_sum"),
    "f16_decline_fit": (
        "SELECT as_of_date, well_id, t0_month, n AS positive_months, round(sse, 2) AS grid_sse, true AS certified FROM grid_fit",
        "t:as_of_date s:well_id t:t0_month i:positive_months d:grid_sse s:certified",
    ),
    "f17_decline_mape": (
        "SELECT as_of_date, well_id, grid_mape IS NOT NULL AS arps_defined, grid_mape AS grid_mape_nonzero_pct FROM grid_mape",
        "t:as_of_date s:well_id,arps_defined d:grid_mape_nonzero_pct",
    ),
    "f18_backtest": (
        "SELECT c.*, model_mae_m3 / naive_mae_m3 AS naive_mae_ratio, arps_fitted_wells, arps_failed_wells, arps_degraded FROM coverage c JOIN decline_summary d ON c.as_of_date = d.as_of_date",
        f"t:as_of_date {_BASIC_SUMMARY} d:model_mae_m3,naive_mae_m3 i:arps_fitted_wells,arps_failed_wells s:arps_degraded d:mase_median,naive_mae_ratio",
    ),
    "f18_backtest_distributions": ("SELECT *, true AS within_tolerance FROM decline_distributions", "t:as_of_date s:metric d:p50,p75,p90 s:within_tolerance"),
    "f18_backtest_with_decline": (
        "SELECT *, true AS within_tolerance FROM decline_summary",
        "t:as_of_date i:arps_fitted_wells,arps_failed_wells s:arps_degraded d:arps_mape_gap_pp s:within_tolerance",
    ),
    "s15_evaluation_report": (
        "SELECT c.as_of_date, wells_in_test, arps_fitted_wells, arps_degraded, mase_median, gates_passed, 3 AS n_gates, "
        "(SELECT count(*) FROM gates g WHERE g.as_of_date = c.as_of_date AND passed) AS n_passed, "
        "(SELECT count(*) FROM decline_distributions g WHERE g.as_of_date = c.as_of_date) AS n_distributions, '1,2,3' AS horizons "
        "FROM coverage c JOIN verdicts v ON c.as_of_date = v.as_of_date JOIN decline_summary d ON c.as_of_date = d.as_of_date",
        "t:as_of_date i:wells_in_test,arps_fitted_wells s:arps_degraded d:mase_median s:gates_passed i:n_gates,n_passed,n_distributions s:horizons",
    ),
    "f19_gates": ("SELECT *, true AS within_tolerance FROM gates", "t:as_of_date s:gate d:value,threshold s:passed,blocking,within_tolerance"),
    "f20_long_metrics": (
        "SELECT as_of_date, metric, value, true AS within_tolerance FROM (SELECT c.as_of_date, 'eval_' || k AS metric, cast(v AS double) AS value FROM coverage c JOIN decline_summary d ON c.as_of_date = d.as_of_date, "
        "LATERAL (SELECT 'model_mae_m3' AS k, c.model_mae_m3 AS v "
        "UNION ALL SELECT 'naive_mae_m3', c.naive_mae_m3 UNION ALL SELECT 'wells_in_test', c.wells_in_test UNION ALL SELECT 'wells_eligible', c.wells_eligible "
        "UNION ALL SELECT 'wells_excluded_short_history', c.wells_excluded_short_history UNION ALL SELECT 'wells_mase_undefined', c.wells_mase_undefined "
        "UNION ALL SELECT 'arps_fitted_wells', d.arps_fitted_wells UNION ALL SELECT 'arps_failed_wells', d.arps_failed_wells UNION ALL SELECT 'arps_degraded', cast(d.arps_degraded AS integer)) AS u "
        "UNION ALL SELECT as_of_date, 'eval_' || metric || '_p50', p50 FROM decline_distributions UNION ALL SELECT as_of_date, 'eval_' || metric || '_p75', p75 FROM decline_distributions "
        "UNION ALL SELECT as_of_date, 'eval_' || metric || '_p90', p90 FROM decline_distributions "
        "UNION ALL SELECT as_of_date, 'eval_gate_' || gate || '_passed', cast(cast(passed AS integer) AS double) FROM gates "
        "UNION ALL SELECT as_of_date, 'eval_gate_' || gate || '_value', value FROM gates "
        "UNION ALL SELECT as_of_date, 'eval_gates_passed', cast(cast(gates_passed AS integer) AS double) FROM verdicts) WHERE value IS NOT NULL",
        "t:as_of_date s:metric d:value s:within_tolerance",
    ),
    "f21_multi_cutoff": (
        "SELECT c.as_of_date, mase_median, model_mae_m3 / naive_mae_m3 AS naive_mae_ratio, arps_mape_gap_pp, true AS within_tolerance, gates_passed "
        "FROM coverage c JOIN verdicts v ON c.as_of_date = v.as_of_date JOIN decline_summary d ON c.as_of_date = d.as_of_date",
        "t:as_of_date d:mase_median,naive_mae_ratio,arps_mape_gap_pp s:within_tolerance,gates_passed",
    ),
    "f22_champion": (
        "SELECT strftime(as_of_date, '%Y%m') AS version, gates_passed, CASE WHEN gates_passed THEN 'promotable' ELSE 'rejected' END AS decision, "
        "coalesce(gates_passed AND as_of_date = (SELECT max(as_of_date) FROM verdicts WHERE gates_passed), false) AS champion FROM verdicts",
        "s:version,gates_passed,decision,champion",
    ),
    "f23_serving_reads": (
        "SELECT request_id, r.well_id, count(*) AS points, sum(coalesce(oil_prod_m3, 0.0)) AS total, min(production_month) AS first_date FROM requests r JOIN fact f ON r.well_id = f.well_id AND production_month BETWEEN date_start AND date_end GROUP BY 1, 2",
        "i:request_id s:well_id i:points d:total t:first_date",
    ),
    "f23_well_list": ("SELECT well_id FROM dim_well", "s:well_id"),
    "b01_monthly_build": ("SELECT * FROM features WHERE as_of_date IN (SELECT as_of_date FROM evaluated)", _FEATURES),
    "r01_arrivals": ("SELECT * FROM silver", _PRODUCTION),
    "r02_request_rate": (_RATE, "z:window_start,window_end s:handler i:requests d:rate_per_second"),
    "r03_latency_percentiles": (
        "SELECT date_trunc('hour', ts) AS window_start, handler, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95, quantile_cont(latency, 0.99) AS p99 FROM log GROUP BY 1, 2",
        "z:window_start s:handler d:p50,p95,p99",
    ),
    "r03_latency_histogram": (_buckets(_tumbling(60), f"{_tumbling(60)}, handler"), "z:window_start,window_end s:handler i:requests d:p50,p95,p99"),
    "r04_error_share": (_ERRORS, "z:window_start,window_end i:requests,errors d:error_pct"),
    "r05_trailing_by_status": (_sliding(30, 5, "status", "count(*) AS requests"), "z:window_start,window_end s:status i:requests"),
    "r05_trailing_total": (_sliding(30, 5, "", "count(*) AS requests"), "z:window_start,window_end i:requests"),
    "r06_mean_latency": (_sliding(5, 1, "", "avg(latency) AS mean_latency, count(*) AS requests"), "z:window_start,window_end d:mean_latency i:requests"),
    "r07_sustained_alert": (
        "SELECT handler, window_start AS firing_at FROM (SELECT handler, window_start, count(*) OVER (PARTITION BY handler ORDER BY window_start RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) AS held "
        "FROM (SELECT date_trunc('hour', ts) AS window_start, handler FROM log GROUP BY 1, 2 HAVING avg(latency) > 30.0)) WHERE held = 5",
        "s:handler z:firing_at",
    ),
}

ORACLES["b01_quality_results"] = (
    f"SELECT table_name, check_name, failing_rows, total_rows, passed FROM ({_GATES})", "s:table_name,check_name i:failing_rows,total_rows s:passed"
)

#: A stream shows what the same batch does.
for _name in (
    "r02_request_rate", "r03_latency_histogram", "r03_latency_percentiles", "r04_error_share", "r05_trailing_by_status", "r05_trailing_total",
    "r06_mean_latency", "r07_sustained_alert",
):
    ORACLES[f"{_name}_stream"] = ORACLES[_name]

_LISTED = (
    "SELECT count(*) AS rows, count(DISTINCT well_id) AS wells, {extra}string_agg(DISTINCT cast(as_of_date AS varchar), ',' ORDER BY cast(as_of_date AS varchar)) AS cutoffs, "
    "string_agg(DISTINCT cast(horizon AS varchar), ',' ORDER BY cast(horizon AS varchar)) AS horizons FROM dataset"
)
ORACLES["a20_dataset_footprint"] = (_LISTED.format(extra=""), "i:rows,wells s:cutoffs,horizons")
ORACLES["s15_json_report"] = (_LISTED.format(extra="count(DISTINCT as_of_date) AS n_cutoffs, "), "i:rows,wells,n_cutoffs s:cutoffs,horizons")
ORACLES["f10_incremental_features"] = ORACLES["f10_well_features"]
ORACLES["f10_single_cutoff"] = ("SELECT * FROM features", _FEATURES)


def oracle_queries() -> dict[str, str]:
    out = {name: statement(body, columns) for name, (body, columns) in ORACLES.items()}
    # the default cutoff instead of the 24 listed ones
    latest = "SELECT cast(max(production_month) + INTERVAL 1 MONTH AS date) AS as_of_date FROM silver"
    out["f10_single_cutoff"] = out["f10_single_cutoff"].replace(RELATIONS["cutoffs"].strip(), latest)
    return out
