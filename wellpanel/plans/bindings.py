"""How generic commerce tables stand in for the published snapshots.

``lineitem`` plays the monthly declarations (well = part, company = supplier),
``part`` the registry and ``events`` the request log.  Blanks, negatives, zeros
and re-declarations follow from attribute values of the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def raw_production(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """All-text declarations, one row per line item."""
    li = lineitem.join(
        supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey"
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    quantity = _money("l_quantity").cast("string")
    undated = (_money("l_tax") == F.lit("0.08").cast("decimal(18,2)")) & (F.col("l_linenumber") == 7)
    well = F.col("l_partkey").cast("string")
    return li.select(
        F.col("l_suppkey").cast("string").alias("idempresa"),
        F.when(undated, " ").otherwise(F.year("l_shipdate").cast("string")).alias("anio"),
        F.month("l_shipdate").cast("string").alias("mes"),
        well.alias("idpozo"),
        F.when((flag == "R") & (F.col("l_quantity") <= 2), " ")
        .when((flag == "A") & (F.col("l_quantity") >= 49), F.concat(F.lit("-"), quantity))
        .when((status == "O") & (_money("l_discount") == 0), F.lit("0.00"))
        .otherwise(quantity)
        .alias("prod_pet"),
        F.when((flag == "N") & (_money("l_tax") == 0), "")
        .otherwise(_money("l_extendedprice").cast("string"))
        .alias("prod_gas"),
        (_money("l_discount") * 100).cast("decimal(18,2)").cast("string").alias("prod_agua"),
        F.when(F.col("l_linenumber") == 1, "")
        .when(flag == "R", F.concat("s_name", F.lit(" SA")))
        .otherwise(F.col("s_name"))
        .alias("empresa"),
        F.when(status == "F", F.concat(F.lit("W-"), well)).otherwise(F.lit(" ")).alias("sigla"),
        F.when(status == "O", "CONVENCIONAL").otherwise(F.lit("NO CONVENCIONAL")).alias("tipo_de_recurso"),
        F.concat(F.lit("FM "), F.col("l_linenumber").cast("string")).alias("formacion"),
        F.when(flag == "A", "").otherwise(F.concat(F.lit("FIELD "), F.col("l_linenumber").cast("string"))).alias("areayacimiento"),
        F.when(flag == "A", "NEUQUINA").when(flag == "N", "GOLFO SAN JORGE").otherwise(F.lit("AUSTRAL")).alias("cuenca"),
        F.when(status == "O", "Chubut").otherwise(F.lit("Neuquén")).alias("provincia"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("_dlt_load_id"),
    )


def raw_registry(part: DataFrame) -> DataFrame:
    """All-text registry: two loads per part, some without an id."""
    loads = part.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("load"))
    size = F.col("p_size")
    price = _money("p_retailprice").cast("string")
    return loads.select(
        F.when(size == 13, " ").otherwise(F.col("p_partkey").cast("string")).alias("idpozo"),
        F.lit("").alias("idempresa"),
        F.when(size > 45, "").otherwise(F.concat((size * 100).cast("string"), F.lit(".5"))).alias("profundidad"),
        F.concat(F.lit("-"), price).alias("coordenaday"),
        size.cast("string").alias("coordenadax"),
        F.concat("p_name", F.lit(" "), F.col("load").cast("string")).alias("sigla"),
        F.col("p_type").alias("formprod"),
        F.when(size > 10, F.col("p_brand")).otherwise(F.lit("")).alias("areayacimiento"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.concat(F.lit("CUENCA "), "p_type")).alias("cuenca"),
        F.lit(" ").alias("provincia"),
        F.col("p_type").alias("clasificacion"),
        F.lit("").alias("subclasificacion"),
        F.col("p_brand").alias("tipo_reservorio"),
        F.lpad(F.col("load").cast("string"), 12, "0").alias("_dlt_load_id"),
    )


def request_log(events: DataFrame) -> DataFrame:
    """Events as a request log with zoned timestamps, which watermarks require."""
    is_error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("handler"),
        F.when(is_error, "5xx").otherwise(F.lit("2xx")).alias("status"),
        F.col("value").alias("latency"),
        is_error.alias("is_error"),
    )
