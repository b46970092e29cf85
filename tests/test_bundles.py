"""Result bundles appear as a whole."""

import pytest
from pyspark.sql import functions as F

from nightgrid.sources import bundles


def tables(spark, n):
    return {"a": spark.range(n).withColumn("x", F.array(F.col("id") * 1.5)).repartition(3), "b": spark.createDataFrame([(1, None)], "k int, s string"), "none": spark.range(0)}


def test_a_bundle_comes_back(spark, tmp_path):
    path = str(tmp_path)
    assert bundles.load_bundle(spark, path) is None and bundles.versions(path) == []
    assert bundles.save_bundle(spark, path, tables(spark, 5), {"run": 1}) == 1
    got, meta = bundles.load_bundle(spark, path)
    assert meta == {"run": 1} and set(got) == {"a", "b", "none"}
    assert sorted((r["id"], r["x"]) for r in got["a"].collect()) == [(i, [i * 1.5]) for i in range(5)]
    assert got["b"].collect()[0]["s"] is None and got["none"].count() == 0 and got["none"].columns == ["id"]
    assert bundles.manifest(path)["tables"]["a"]["rows"] == 5


def test_a_failed_write_leaves_the_bundle_before_it(spark, tmp_path):
    path = str(tmp_path)
    bundles.save_bundle(spark, path, tables(spark, 4))
    bad = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.array(F.lit(0.0))).cast("array<double>"))
    with pytest.raises(Exception, match="stop"):
        bundles.save_bundle(spark, path, {"b": spark.range(9), "a": bad})
    got, _ = bundles.load_bundle(spark, path)
    assert bundles.versions(path) == [1] and got["a"].count() == 4 and got["b"].count() == 1
    assert bundles.save_bundle(spark, path, tables(spark, 6)) == 2 and bundles.load_bundle(spark, path)[0]["a"].count() == 6
    assert bundles.load_bundle(spark, path, 1)[0]["a"].count() == 4 and bundles.load_bundle(spark, path, 7) is None


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = f"file://{tmp_path}"
    for n in (3, 4, 5):
        bundles.save_bundle(spark, path, tables(spark, n))
    assert bundles.vacuum(path, keep=1) == ["manifests/1.json", "manifests/2.json"]  # the files may still be read
    gone = bundles.vacuum(path, keep=1, settled=0)
    assert gone and all(g.startswith("data/") for g in gone) and bundles.vacuum(path, settled=0) == []
    assert bundles.load_bundle(spark, path)[0]["a"].count() == 5 and bundles.versions(path) == [3]
