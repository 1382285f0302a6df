"""Tables staged in the shared folder, so that a lost executor costs a task and not the lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.session import staging_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back with its schema."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that helper columns clash with no name and odd names need no quoting.

    ``select("row.*")`` brings them back under their names and in their order.
    """
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def fold(doc_id, folds: int):
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls into fold 0 of "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def hash_sample(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    """All of ``df`` if it has at most ``rows`` rows, else about so many (never twice as many), chosen by a hash of ``key``.

    A threshold on the hash, not a sort: no task or driver sees the candidates of all partitions.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 31)) < int((1 << 31) * rows / n)).limit(2 * rows)
