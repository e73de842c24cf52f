"""Versions of one published table, read together in its newest form.

Each version is a folder of its own and stays as it was written. Reading them
together widens older types and fills in the columns that a version didn't have
yet, so no stored file is ever rewritten.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which stored types may be read as which others without loss.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",),
}


def publish_version(df: DataFrame, path: str, version: int) -> None:
    """Write a version; one that is there already is an error."""
    df.write.mode("error").parquet(f"{path}/version={version}")


def read_versions(spark: SparkSession, path: str, versions: list[int], columns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``version`` and ``columns`` (name: type, default) of all ``versions`` in one scan.

    Where a version has a column its values stand, nulls among them, in the wider
    type; where it hasn't, the default does. A stored type that can't be widened, and a
    missing column without default, are errors that name version and column. Other
    stored columns are left out.
    """
    lacking: dict[str, list[int]] = {name: [] for name in columns}
    for version in versions:
        have = {name.lower(): kind for name, kind in spark.read.parquet(f"{path}/version={version}").dtypes}
        for name, (kind, default) in columns.items():
            stored = have.get(name.lower())
            if stored is None:
                if default is None:
                    raise ValueError(f"version {version} has no {name}, and there is no default")
                lacking[name].append(version)
            elif stored != kind and kind not in WIDER.get(stored, ()):
                raise ValueError(f"version {version} has {name} as {stored}, which isn't narrower than {kind}")
    schema = ", ".join(f"`{name}` {kind}" for name, (kind, _) in columns.items())
    folders = [f"{path}/version={v}" for v in versions]
    rows = spark.read.option("basePath", path).schema(f"{schema}, version int").parquet(*folders)
    filled = {name: F.when(F.col("version").isin(lacking[name]), default.cast(kind)).otherwise(F.col(name)) for name, (kind, default) in columns.items() if lacking[name]}
    return rows.withColumns(filled).select("version", *columns)
