"""Queries that write under the shared folder, on a master whose name isn't local and with a file: checkpoint folder."""
import __spark_entry__ as entry
import compare
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s2_write_table_round_trip", "s11_check_existing_store", "s12_predictions_round_trip", "a6_correlation_spearman_lineitem"])
def test_queries_on_a_cluster_with_a_file_folder(spark, tmp_path, monkeypatch, name):
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", f"file://{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: conf)
    assert compare.check(spark, compare.connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""
    assert any(p.name.startswith("work-") for p in tmp_path.iterdir())
