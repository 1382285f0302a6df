"""Column contracts of the panel tables."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURE = T.DecimalType(18, 6)

# --- fixed values: names and types other jobs rely on -----------------------

MEASURES = ("oil_prod_m3", "gas_prod_mm3", "water_prod_m3")

PRODUCTION_SCHEMA = T.StructType(
    [
        T.StructField("well_id", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("well_alias", T.StringType()),
        T.StructField("production_month", T.DateType()),
        T.StructField("oil_prod_m3", MEASURE),
        T.StructField("gas_prod_mm3", MEASURE),
        T.StructField("water_prod_m3", MEASURE),
        T.StructField("resource_type", T.StringType()),
        T.StructField("formation", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("basin", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("dlt_load_id", T.StringType()),
    ]
)

FLUID_LABELS = {
    "oil_prod_m3": "Petróleo",
    "gas_prod_mm3": "Gas",
    "water_prod_m3": "Agua",
}

LAG_MONTHS = (1, 2, 3, 6, 12)
MEAN_MONTHS = (3, 6, 12)
STD_MONTHS = (6, 12)
TREND_MONTHS = (6, 12)

NUMERIC, DATE, TEXT = "numeric", "date", "text"

KEY_COLUMNS = {"well_id": TEXT, "as_of_date": DATE}

# --- end of fixed values ----------------------------------------------------

LAG_COLUMNS = tuple(f"oil_prod_m3_lag_{k}m" for k in LAG_MONTHS)
MEAN_COLUMNS = tuple(f"oil_prod_m3_roll_mean_{k}m" for k in MEAN_MONTHS)
STD_COLUMNS = tuple(f"oil_prod_m3_roll_std_{k}m" for k in STD_MONTHS)
TREND_COLUMNS = tuple(f"oil_prod_m3_trend_{k}m" for k in TREND_MONTHS)

VOLUME_FEATURES = LAG_COLUMNS + MEAN_COLUMNS + STD_COLUMNS + TREND_COLUMNS
COUNT_FEATURES = (
    "months_with_history",
    "well_age_months",
    "months_since_last_observed",
    "zero_months_12m",
)
STATIC_FEATURES = ("basin", "field", "resource_type")

#: Column -> kind, in the order models and readers expect.
FEATURE_CONTRACT = {
    **KEY_COLUMNS,
    **{c: NUMERIC for c in VOLUME_FEATURES + COUNT_FEATURES},
    "last_observed_month": DATE,
    **{c: TEXT for c in STATIC_FEATURES},
}

NUMERIC_FEATURES = VOLUME_FEATURES + COUNT_FEATURES

SPARK_TYPES = {NUMERIC: T.DoubleType(), DATE: T.DateType(), TEXT: T.StringType()}


def kind_of(data_type: T.DataType) -> str | None:
    """Contract kind of a Spark type, or ``None`` when it has none."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(data_type, T.StringType):
        return TEXT
    return None
