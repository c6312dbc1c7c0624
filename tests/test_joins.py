import pytest
from pyspark.sql import functions as F

from seasonstar.operators.joins import dim_join, fits_broadcast


@pytest.fixture(scope="module")
def sides(spark):
    # One key holds most rows; one key is unknown; one is NULL.
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit("hot"))
        .when(F.col("id") < 2900, F.concat(F.lit("k"), F.col("id") % 50))
        .when(F.col("id") < 2950, F.lit("unknown"))
        .alias("key"),
        "id",
    )
    dim = spark.range(50).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("code")
    )
    return rows, dim.union(spark.createDataFrame([("hot", 99)], "key string, code bigint"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_beyond_the_bound_equals_broadcast_join(spark, sides, how):
    rows, dim = sides
    small = dim_join(rows, dim, ["key"], how)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = dim_join(rows, dim, ["key"], how, max_rows=10)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert small.exceptAll(large.select(*small.columns)).isEmpty()
        assert large.select(*small.columns).exceptAll(small).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()


def test_a_hot_key_of_equal_rows_is_split(spark, sides):
    """Every row is the same; adaptive execution still deals them to several tasks."""
    _, dim = sides
    rows = spark.range(0, 60000, 1, 20).select(F.lit("hot").alias("key"), F.lit("x" * 50).alias("v"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = dim_join(rows, dim, ["key"], max_rows=10)
        tasks = joined.select(F.spark_partition_id().alias("p")).rdd.map(lambda r: r.p)
        assert len(set(tasks.collect())) > 4
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_a_repeated_key_is_refused(spark, sides):
    rows, dim = sides
    twice = dim.unionAll(dim.limit(1))
    with pytest.raises(ValueError, match="repeat"):
        dim_join(rows, twice, ["key"])
    assert dim_join(rows, twice, ["key"], unique=False).count() > dim_join(rows, dim, ["key"]).count()
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "key string, code bigint")
    assert dim_join(rows, dim.unionAll(nulls), ["key"]).count() == dim_join(rows, dim, ["key"]).count()


def test_size_check_counts_rows_and_bytes(spark):
    frame = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert fits_broadcast(frame)
    assert not fits_broadcast(frame, max_rows=9)
    assert not fits_broadcast(frame, max_bytes=9999)
    assert fits_broadcast(frame.limit(0))


def test_right_join_is_refused(sides):
    with pytest.raises(ValueError):
        dim_join(*sides, ["key"], "right")
