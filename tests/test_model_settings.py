"""The model queries fit at the default settings: no smaller models."""
import pytest

from nocturne.operators import models
from nocturne.plans import modelling

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def frame(spark):
    return modelling.features(spark, SF)


@pytest.mark.parametrize("query", ["l4", "l5", "l5b", "l6", "l8", "l8b", "l8c", "l9", "l10", "l11", "l11b", "l12", "l12c", "l13"])
def test_first_fit_has_default_settings(spark, frame, monkeypatch, query):
    def fit(train, features, target, name, params=None, **kw):
        assert {**models.DEFAULTS[name], **(params or {}), "class_weight": None} == models.DEFAULTS[name]
        assert len(features) == 24
        raise Stop

    monkeypatch.setattr(models, "fit_model", fit)
    monkeypatch.setattr(modelling, "features", lambda spark, sf: frame)
    with pytest.raises(Stop):
        getattr(modelling, query)(spark, SF)
