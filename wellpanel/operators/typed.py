"""Raw text snapshots -> typed, deduplicated tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.functions.columns import blank_to_null, month_from_parts, non_negative
from wellpanel.operators.latest import latest_per_key, newest_load_first
from wellpanel.schema import MEASURE, PRODUCTION_SCHEMA
from wellpanel.sources.tables import month_range

# --- fixed values: names of the published snapshots --------------------------

PRODUCTION_TEXT = {
    "company_name": "empresa",
    "well_alias": "sigla",
    "resource_type": "tipo_de_recurso",
    "formation": "formacion",
    "field": "areayacimiento",
    "basin": "cuenca",
    "province": "provincia",
}
PRODUCTION_MEASURES = {
    "oil_prod_m3": "prod_pet",
    "gas_prod_mm3": "prod_gas",
    "water_prod_m3": "prod_agua",
}
REGISTRY_TEXT = {
    "well_alias": "sigla",
    "production_formation": "formprod",
    "field": "areayacimiento",
    "basin": "cuenca",
    "province": "provincia",
    "classification": "clasificacion",
    "sub_classification": "subclasificacion",
    "reservoir_type": "tipo_reservorio",
}
REGISTRY_COLUMNS = (
    "well_id", "well_alias", "company_id", "production_formation", "field", "basin", "province",
    "depth_m", "latitude", "longitude", "classification", "sub_classification", "reservoir_type",
    "dlt_load_id",
)

# --- end of fixed values ------------------------------------------------------


def type_production(raw: DataFrame) -> DataFrame:
    """Rename, type and clean the production snapshot; rows without a period are dropped."""
    dated = raw.filter(blank_to_null("anio").isNotNull() & blank_to_null("mes").isNotNull())
    columns = {
        "well_id": F.col("idpozo").cast("string"),
        "company_id": F.col("idempresa").cast("string"),
        "production_month": month_from_parts(F.trim("anio"), F.trim("mes")),
        "dlt_load_id": F.col("_dlt_load_id").cast("string"),
        **{new: blank_to_null(old) for new, old in PRODUCTION_TEXT.items()},
        **{new: non_negative(old) for new, old in PRODUCTION_MEASURES.items()},
    }
    return dated.select(*[columns[name].alias(name) for name in PRODUCTION_SCHEMA.fieldNames()])


def _raw_range(raw: DataFrame, start: dt.date | str | None, end: dt.date | str | None) -> DataFrame:
    """Raw rows whose text months lie in the range.

    Says nothing new beside the exact filter on the typed month, but it speaks of ``anio`` and ``mes``
    alone, so a raw table partitioned by them is read only where the range lies.
    """
    month = F.try_to_number(F.trim("anio"), F.lit("9999")) * 12 + F.try_to_number(F.trim("mes"), F.lit("99"))
    for bound, keep in ((start, lambda at: month >= at), (end, lambda at: month <= at)):
        if bound is not None:
            day = dt.date.fromisoformat(str(bound)[:10])
            raw = raw.filter(keep(day.year * 12 + day.month))
    return raw


def typed_production(
    raw: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """One row per (well, month), the newest load wins; optionally only ``[start, end)``."""
    rows = month_range(type_production(_raw_range(raw, start, end)), start, end)
    keys = ["well_id", "production_month"]
    ties = [c for c in PRODUCTION_SCHEMA.fieldNames() if c not in (*keys, "dlt_load_id")]
    return latest_per_key(rows, keys, newest_load_first("dlt_load_id", ties))


def type_registry(raw: DataFrame) -> DataFrame:
    """Rename, type and clean the registry; rows without a well id are dropped."""
    columns = {
        "well_id": F.col("idpozo").cast("string"),
        "company_id": F.col("idempresa").cast("string"),
        "depth_m": blank_to_null("profundidad").cast(MEASURE),
        "latitude": blank_to_null("coordenaday").cast("double"),
        "longitude": blank_to_null("coordenadax").cast("double"),
        "dlt_load_id": F.col("_dlt_load_id").cast("string"),
        **{new: blank_to_null(old) for new, old in REGISTRY_TEXT.items()},
    }
    known = raw.filter(blank_to_null("idpozo").isNotNull())
    return known.select(*[columns[name].alias(name) for name in REGISTRY_COLUMNS])


def typed_registry(raw: DataFrame) -> DataFrame:
    """Current registry: one row per well, the newest load wins."""
    ties = [c for c in REGISTRY_COLUMNS if c not in ("well_id", "dlt_load_id")]
    return latest_per_key(type_registry(raw), ["well_id"], newest_load_first("dlt_load_id", ties))
