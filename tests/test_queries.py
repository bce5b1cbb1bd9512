"""Every query against its SQL twin."""

import pytest
from pyspark.sql import functions as F

from treelake import catalog

from .compare import assert_same, connect

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1505
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_many_new_directories(spark, tmp_path):
    """op_mkdir_sub_create lists all new directories, also those with numbers beyond a million."""
    for name in ("region", "nation", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    many = spark.range(0, 100_010, 1, 4).select(F.col("id").alias("c_custkey"), F.lit(3).cast(customer.schema["c_nationkey"].dataType).alias("c_nationkey"))
    many.write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog.QUERIES["op_mkdir_sub_create"](spark, str(tmp_path)).count() == 100_010 + 20
