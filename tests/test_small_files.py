"""Folders of many small files: written one per row, listed and read once, by few tasks."""
import pytest
from pyspark.sql import functions as F

from nocturne.plans import storage
from nocturne.session import shared_dir
from nocturne.sources import recordings


@pytest.fixture
def folder(spark):
    rows = spark.range(120).select((F.col("id") % 3).cast("string").alias("kind"), F.col("id").alias("vec"), F.concat(F.lit("misc,C3-M2\né,"), F.col("id").cast("string")).alias("value"))
    path = shared_dir(spark)
    storage.write_files(rows, ["kind", "vec"], path)
    return rows, path


def test_written_files_are_those_of_sparks_writer(spark, folder):
    rows, path = folder
    theirs = shared_dir(spark)
    rows.select(F.col("kind"), F.col("vec").cast("string"), "value").write.partitionBy("kind", "vec").text(theirs)
    told = lambda p: {(r.kind, r.vec, r.value) for r in spark.read.text(p, wholetext=True).collect()}
    assert told(path) == told(theirs) and len(told(path)) == 120
    assert spark.read.text(path, wholetext=True, recursiveFileLookup=True).count() == 120  # one file per row, none left over


def test_files_are_scanned_once_by_few_tasks(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # Spark alone: a task for each file
    try:
        files = recordings._whole_files(spark, folder[1], "*.txt")
        plan = files._jdf.queryExecution().executedPlan().toString()
        scanned = files.select(F.spark_partition_id()).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert scanned == 120 and plan.count("FileScan") == 1 and "Coalesce" in plan


def test_segments_are_read_once_for_counts_and_rows(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"S1_p{i}_Stagen{i}.csv").write_text("misc,C3-M2\nx,1\n")
    used, _ = recordings.scan_segment_files(spark, str(tmp_path))
    assert "InMemoryTableScan" in used._jdf.queryExecution().executedPlan().toString() and used.count() == 4


def test_names_with_spaces_and_commas(spark, tmp_path):
    for name, content in (("a, b c_stage.txt", "1\n"), ("d,é_stage.txt", ""), ("e%2C f_stage.txt", "2\n")):
        (tmp_path / name).write_text(content)
    out, report = recordings.scan_stage_text(spark, str(tmp_path))
    assert out.count() == 2 and tuple(report.first()) == (2, 1)
