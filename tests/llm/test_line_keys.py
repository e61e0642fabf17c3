"""Keys of the line join: one row each from a table, not one wide expression per line."""
from nocturne.llm import line_dedup
from pyspark.sql import functions as F


def test_keys_are_one_short_expression(spark):
    lines = spark.createDataFrame([(1, 5, "x" * 40)], "id long, sign long, line string").withColumn("n", F.length("line"))
    probes = line_dedup._keyed(lines, 3, 32, probe=True)
    assert probes._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    index = {r["key"] for r in line_dedup._keyed(lines, 3, 32, probe=False).collect()}
    assert len(index) == 4 and index <= {r["key"] for r in probes.collect()}
