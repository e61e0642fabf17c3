"""Boosted trees are fitted by as many tasks as their rows need, however many files or partitions these came from."""
import pytest
from nocturne.operators import models


@pytest.mark.parametrize("rows_a_task,tasks", [(30_000, 1), (100, 3)])
def test_tasks_of_a_boosted_fit_follow_its_rows(spark, monkeypatch, rows_a_task, tasks):
    seen, made = [], models._classifier

    def watched(*args):
        one = made(*args)
        fit = one.fit
        one.fit = lambda data: seen.append((data.rdd.getNumPartitions(), data.count())) or fit(data)
        return one

    monkeypatch.setattr(models, "_classifier", watched)
    monkeypatch.setattr(models, "BOOSTED_A_TASK", rows_a_task)
    df = spark.range(0, 300, 1, 16).selectExpr("id", "double(id % 10) AS a", "double(id % 7) AS b", "string(int(id % 10 > 4)) AS y")
    m = models.fit_model(df, ["a", "b"], "y", "boosted_trees", {"n_estimators": 3, "max_depth": 2}, task="binary")
    assert seen == [(tasks, 300)]
    assert models.predict(m, df, "y", keep=["id", "y"]).filter("y_pred <> y").count() == 0
