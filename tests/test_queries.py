"""Every query runs; those with an SQL twin give the same rows."""
import duckdb
import pytest

import __spark_entry__ as entry
from compare import check, connect

SF = "/root/testdata/sf0.001"
TRAINING = entry._training()[0]  # tested in their own folder
QUERIES = {k: v for k, v in entry.queries().items() if k not in TRAINING}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in TRAINING}
# Queries whose answer depends on hashed draws or fitted models.
ROWS_ONLY = {
    "t12_augment_epochs", "g9_export_features_all", "m7_bootstrap_mean_ci", "m8_bootstrap_auc_diff", "l4_fit_random_forest", "l5_fit_boosted_trees",
    "l5_fit_boosted_trees_multiclass", "l6_fit_kernel_margin", "l8_run_subject_cv", "l9_nested_grid_search", "l10_run_cross_dataset",
    "l11_run_multitarget_cv", "l11_run_multitarget_cross", "l12_feature_importance",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_random_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, QUERIES[name], SQL.get(name), SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", ["s9_epochs_from_samples", "s9_epochs_from_samples_channels"])
def test_epochs_of_a_short_recording(spark, tmp_path, name):
    """A recording of 3 vectors fills its first epochs only; those without samples are in neither result."""
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 43").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert check(spark, con, QUERIES[name], SQL[name], str(tmp_path)) == ""
