"""Rules in a few groups are placed by ranges, not group by group in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from siltstone.operators import rules


def test_places_of_a_few_groups(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 > 0, "most").otherwise(F.when(F.col("id") > 0, "few")).alias("group"), (F.col("id") * 7919 % 5000).alias("by"), (F.col("id") % 3).alias("grade"))
    order = [F.desc("grade"), F.col("by")]
    found = rules.placed(rows, ["group"], order)
    assert found.columns == ["id", "group", "by", "grade", "place"] and found.count() == 5000
    expected = rows.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    assert not found.exceptAll(expected.withColumn("place", F.col("place").cast("long"))).count()
    assert found.select(F.spark_partition_id()).where(F.col("group") == "most").distinct().count() > 1
