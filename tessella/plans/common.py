"""What the registered queries share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Rounded to 6 places, without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + 0.0


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A small fixed table; the same VALUES text serves the oracle."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")
