"""A forest in pieces: the driver holds some of its trees at a time, results are those of one forest."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from nocturne.operators import forest, models


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    return spark.createDataFrame([(i, *map(float, v), "abc"[int(v[0] > 0) + int(v[1] > 1)]) for i, v in enumerate(x)], "id long, f0 double, f1 double, f2 double, y string")


def test_forest_in_pieces(spark, noisy, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "ROW_TREES", 3000)  # 5 trees a piece
    features, params = ["f0", "f1", "f2"], {"n_estimators": 22, "class_weight": "balanced"}
    m = models.fit_model(noisy, features, "y", "random_forest", params)
    assert m.model.trees == [5, 5, 5, 5, 2] and sum(m.model.featureImportances.toArray()) == pytest.approx(1)
    assert np.argmin(m.model.featureImportances.toArray()) == 2
    top = models.feature_importance(spark, m, 3).collect()
    assert [r.feature for r in top][2] == "f2"
    pieces = [RandomForestClassificationModel.load(p) for p in m.model.paths]
    assert [p.getNumTrees for p in pieces] == m.model.trees and len({p.toDebugString[60:] for p in pieces}) == 5
    got = models.predict(m, noisy, "y", keep=["id", "y"])
    assert got.count() == 600 and got.filter(F.col("y") == F.col("y_pred")).count() >= 590

    data = models._vectors(noisy, features, {})
    whole = m.model.transform(data).select("id", "rawPrediction", "prediction").orderBy("id").collect()
    votes = sum(np.array([r.rawPrediction.toArray() for r in p.transform(data).select("id", "rawPrediction").orderBy("id").collect()]) for p in pieces)
    assert np.allclose([r.rawPrediction.toArray() for r in whole], votes, atol=1e-9) and all(r.prediction == np.argmax(r.rawPrediction.toArray()) for r in whole)

    row = models.save_models(spark, {("random_forest", "final"): m}, str(tmp_path / "m"), experiment="e", dataset="d", mode="cv").first()
    again = models.predict(models.load_model(row), noisy, keep=["id"]).select("id", F.col("y_pred").alias("b"))
    assert got.join(again, "id").filter(F.col("y_pred") == F.col("b")).count() == 600


def test_forest_of_one_piece_is_a_plain_model(noisy):
    m = models.fit_model(noisy, ["f0", "f1", "f2"], "y", "random_forest", {"n_estimators": 4, "max_depth": 3})
    assert isinstance(m.model, RandomForestClassificationModel) and m.model.getNumTrees == 4
