from pyspark.sql import functions as F

from railyard.operators.joins import left_join_spread_nulls


def test_null_keys_spread_and_result_unchanged(spark):
    left = spark.range(4000).select(F.col("id").alias("tid"),
                                    F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(50).select(F.col("id").alias("rid"), (F.col("id") * 10).alias("v"))
    prev = {k: spark.conf.get(k) for k in ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = left.join(right, left.k == right.rid, "left")
        spread = left_join_spread_nulls(left, right, "k", "rid", F.col("tid"))
        assert "SortMergeJoin" in spread._jdf.queryExecution().executedPlan().toString()

        def null_parts(df):
            return df.filter("k IS NULL").select(F.spark_partition_id()).distinct().count()

        assert null_parts(plain) == 1
        assert null_parts(spread) > 4
        cols = ["tid", "k", "rid", "v"]
        assert sorted(tuple(r) for r in plain.select(cols).collect()) == \
            sorted(tuple(r) for r in spread.select(cols).collect())
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
