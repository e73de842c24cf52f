import pytest
from pyspark.sql import functions as F

from tessella.sources.versions import publish_version, read_versions


def test_versions_are_read_together(spark, tmp_path):
    path = str(tmp_path / "t")
    publish_version(spark.createDataFrame([(1, 0.5, "extra")], "a int, b float, z string"), path, 1)
    publish_version(spark.createDataFrame([(2**40, 0.1, None)], "A bigint, b double, c string"), path, 2)
    columns = {"a": ("bigint", None), "b": ("double", None), "c": ("string", F.lit("new"))}
    assert sorted(map(tuple, read_versions(spark, path, [1, 2], columns).collect())) == [(1, 1, 0.5, "new"), (2, 2**40, 0.1, None)]
    assert read_versions(spark, path, [1], columns).columns == ["version", "a", "b", "c"]
    with pytest.raises(ValueError, match="version 2 has a as bigint"):
        read_versions(spark, path, [1, 2], {"a": ("int", None)})
    with pytest.raises(ValueError, match="version 1 has no c"):
        read_versions(spark, path, [1, 2], {"c": ("string", None)})
    with pytest.raises(Exception, match="exists"):
        publish_version(spark.range(1), path, 1)
