"""Crowded cells of the neighbour search are split by point too."""
import numpy as np
from pyspark.sql import functions as F

from nocturne.operators import neighbors


def test_a_crowded_cell_is_searched_in_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 40, (400, 2)).astype(float), axis=0)
    points = spark.createDataFrame([("a", list(map(float, v)), 1) for v in x], "cls string, v array<double>, times long")
    sizes, search = spark.sparkContext.accumulator(0), neighbors._search
    seen = spark.sparkContext.accumulator(0)

    def watched(k):
        run = search(k)

        def inner(queries, points):
            if len(points) > 120 and len(queries):
                sizes.add(1)
            seen.add(1)
            return run(queries, points)

        return inner

    monkeypatch.setattr(neighbors, "_search", watched)
    far = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 1:4]
    want = {tuple(v): d for v, d in zip(x, far)}
    for cell_points in (1000, 100):
        got = neighbors.nearest(points.select("cls", "v"), points, 3, cell_points=cell_points, rows_per_task=60).select("v", F.transform("near", lambda n: n["d"]).alias("d")).collect()
        assert len(got) == len(x) and all(np.allclose(sorted(r.d)[:3], want[tuple(r.v)]) for r in got)
    assert seen.value > 0 and sizes.value == 0
