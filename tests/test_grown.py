"""Forests grown inside tasks: the driver holds no tree but its nodes of very many rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.operators import forest, grown, models

NAMES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    return spark.createDataFrame([(i, *map(float, v), "abc"[int(v[0] > 0) + int(v[1] > 1)]) for i, v in enumerate(x)], "id long, f0 double, f1 double, f2 double, y string")


def brute(x, y, w, classes):
    """The best first cut over all features."""
    gini = lambda m: m.sum() - (m * m).sum() / max(m.sum(), 1e-300)
    mass = lambda keep: np.bincount(y[keep], w[keep], classes)
    cuts = [(gini(mass(slice(None))) - gini(mass(x[:, f] <= c)) - gini(mass(x[:, f] > c)), f, c) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1]]
    return max(cuts)


def test_a_tree_cuts_where_gini_falls_most():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(0, 9, (60, 3)).astype(np.uint8)
        y, w = rng.integers(0, 3, 60), rng.integers(1, 4, 60).astype(float)
        t = grown.grow(x, y, w, 3, 30, 1, 3, rng)
        gain, f, c = brute(x, y, w, 3)
        root = (x[:, t["feature"][0]] <= t["cut"][0])
        own = brute(np.where(root, 0, 1)[:, None], y, w, 3)[0]
        assert own == pytest.approx(gain)
        leaf = grown.walk(x, t["feature"], t["cut"], t["child"], np.zeros(60, np.int64))
        for i in np.unique(leaf):  # a leaf holds its rows' weights, and one class unless no feature tells them apart
            held = leaf == i
            assert np.allclose(t["votes"][i], np.bincount(y[held], w[held], 3))
            assert len(set(y[held])) == 1 or len({tuple(r) for r in x[held]}) == 1 or t["feature"][i] < 0
        shallow = grown.grow(x, y, w, 3, 2, 5, 3, rng)
        at = grown.walk(x, shallow["feature"], shallow["cut"], shallow["child"], np.zeros(60, np.int64))
        assert len(set(at)) <= 4 and np.bincount(at)[np.unique(at)].min() >= 5


@pytest.mark.parametrize("local", [100_000, 200])  # all of a tree in a task; upper nodes split over tasks
def test_grown_forest(spark, noisy, tmp_path, monkeypatch, local):
    monkeypatch.setattr(grown, "LOCAL_ROWS", local)
    fits = []
    monkeypatch.setattr(forest, "RandomForestClassifier", lambda **k: fits.append(k))
    m = models.fit_model(noisy, NAMES, "y", "random_forest", {"n_estimators": 22, "class_weight": "balanced"})
    assert not fits and isinstance(m.model, grown.GrownForest) and m.model.getNumTrees == 22
    trees = spark.read.schema(grown.TREES).parquet(m.model.path)
    assert trees.select("tree").distinct().count() == 22
    assert (len(m.model.top.feature) > 22) == (local == 200)
    if local == 200:  # no group of a bag is above the bound
        assert trees.select(F.size("feature")).agg(F.max("size(feature)")).first()[0] <= 2 * local
    assert sum(m.model.importances) == pytest.approx(1) and np.argmin(m.model.importances) == 2
    assert models.feature_importance(spark, m, 3).collect()[2]["feature"] == "f2"
    got = models.predict(m, noisy, "y", keep=["id", "y"])
    assert got.count() == 1500 and got.filter(F.col("y") == F.col("y_pred")).count() >= 1485
    fresh = np.random.default_rng(6).normal(size=(400, 3))
    unseen = spark.createDataFrame([(*map(float, v), "abc"[int(v[0] > 0) + int(v[1] > 1)]) for v in fresh], "f0 double, f1 double, f2 double, y string")
    assert models.predict(m, unseen, "y").filter("y = y_pred").count() >= 376
    raw = m.model.transform(models._vectors(noisy, NAMES, {})).select("rawPrediction", "probability", "prediction").collect()
    assert all(r.rawPrediction.toArray().sum() == pytest.approx(22) and r.probability.toArray().sum() == pytest.approx(1) and r.prediction == np.argmax(r.rawPrediction.toArray()) for r in raw)
    row = models.save_models(spark, {("random_forest", "final"): m}, str(tmp_path / "m"), experiment="e", dataset="d", mode="cv").first()
    again = models.predict(models.load_model(row), noisy, keep=["id"]).select("id", F.col("y_pred").alias("b"))
    assert got.join(again, "id").filter(F.col("y_pred") == F.col("b")).count() == 1500


def test_rows_of_a_prediction_come_in_lots(noisy, monkeypatch):
    m = models.fit_model(noisy.filter("id < 1100"), NAMES, "y", "random_forest", {"n_estimators": 5})
    whole = {r.id: r.y_pred for r in models.predict(m, noisy, keep=["id"]).collect()}
    monkeypatch.setattr(grown, "LOCAL_ROWS", 1)
    m.model.rows = 100
    assert {r.id: r.y_pred for r in models.predict(m, noisy, keep=["id"]).collect()} == whole


def test_bags_are_the_draws_of_spark(spark):
    """The driver's nodes and the tasks' trees go by the same bags: numpy's hash is Spark's."""
    rows = spark.range(-3, 500).select((F.col("id") * 1_234_567_891_011).alias("row"))
    told = rows.select("row", F.array(*[grown._draw(F.col("row"), F.lit(t), 42) for t in range(7)]).alias("k")).toPandas()
    assert (grown.bags(told["row"].to_numpy(), 7, 42) == np.stack(told["k"].to_numpy())).all()


def test_cuts_of_both_kinds_agree():
    """A level's cuts are the same from histograms as from sorted rows, with integer weights to the last bit."""
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 32, (3_000, 6)).astype(np.uint8), rng.integers(0, 3, 3_000), rng.integers(1, 4, 3_000).astype(float)
    made = []
    dense, sparse = grown._dense, grown._sparse
    for least in (1, 5):
        for one in (dense, sparse):
            grown._dense = grown._sparse = one
            try:
                made.append(grown.grow(x, y, w, 3, 30, least, 3, np.random.default_rng(1)))
            finally:
                grown._dense, grown._sparse = dense, sparse
    for a, b in (made[:2], made[2:]):
        assert all((a[k] == b[k]).all() for k in a)
