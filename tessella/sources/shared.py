"""Intermediate tables in the folder that the driver and all executors share.

``materialise`` cuts lineage by writing Parquet: lost executors cost nothing,
because the files are not theirs. ``spark.checkpoint.dir`` names the folder.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster
    gets one below its warehouse, which its executors share.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _OWN:
            if spark.sparkContext.master.startswith("local["):
                _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
            else:
                _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessella"
        base = _OWN[app]
    return f"{base.rstrip('/')}/tessella-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it read back; its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_paths = [path]
    return out


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads ``tables``; they go with it when it is discarded."""
    df._tessella_paths = [path for table in tables for path in getattr(table, "_tessella_paths", ())]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in getattr(df, "_tessella_paths", ()):
            where, store = _hadoop(spark, path)
            store.delete(where, True)
        df._tessella_paths = []


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, of whatever store it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a manifest or a pointer; one of that name is replaced."""
    where, store = _hadoop(spark, path)
    stream = store.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if there is none."""
    where, store = _hadoop(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, in one step where the store can, over an older one of the target's name."""
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs.Options, "Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    one, two = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.rename(one, two, options)
