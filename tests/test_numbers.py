"""Numeric operators against plain NumPy on small inputs."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nocturne.functions import arrays, signal
from nocturne.operators import balance, metrics, models, neighbors, profile, reduction, reporting

FS = 100.0


@pytest.fixture(scope="module")
def waves(spark):
    """Epochs of several lengths, with missing, constant, tied and non-finite samples."""
    rng = np.random.default_rng(3)
    epochs = [rng.normal(size=n).round(1 if n == 350 else 6).tolist() for n in (1, 2, 3, 4, 9, 50, 350, 350, 400, 1000, 1001)]
    epochs += [[2.5] * 40, [], None, [1.0, float("nan"), float("inf"), -2.0, 3.0, 0.0, -1.0, 2.0]]
    return spark.createDataFrame(list(enumerate(epochs)), "id int, signal array<double>").cache()


def clean(x):
    x = np.asarray([] if x is None else x, dtype=float)
    return x[np.isfinite(x)]


def by_hand(x):
    """The features of one epoch, term by term."""
    n = len(x)
    f = {"mean": x.mean(), "std": x.std(), "var": x.var(), "rms": math.sqrt((x**2).mean())}
    f["zero_crossing_rate"] = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / (n - 1) if n > 1 else 0.0
    k = min(max(8, round(FS * 4)), n)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k) if k > 1 else np.ones(1)
    segments = [x[i : i + k] for i in range(0, n - k + 1, k - k // 2)]
    power = np.mean([np.abs(np.fft.fft((s - s.mean()) * w)[: k // 2 + 1]) ** 2 for s in segments], axis=0) / (FS * (w**2).sum())
    for i in range(len(power)):
        if i and not (k % 2 == 0 and i == k // 2):
            power[i] *= 2
    freq = np.arange(len(power)) * FS / k

    def band(lo, hi):
        p = power[(freq >= lo) & (freq < hi)]
        return float(((p[1:] + p[:-1]) / 2).sum() * FS / k) if len(p) else 0.0

    total = band(0.5, 30)
    for b, (lo, hi) in signal.BANDS.items():
        f[f"bandpower_{b}"] = band(lo, hi)
        f[f"rel_power_{b}"] = band(lo, hi) / total if total > 0 else 0.0
    f["theta_alpha_ratio"] = band(4, 8) / band(8, 12) if band(8, 12) > 0 else 0.0
    share = power / power.sum() if power.sum() > 0 else power
    pos = share[share > 0]
    f["spectral_entropy"] = -(pos * np.log2(pos)).sum() / np.log2(len(pos)) if len(pos) > 1 else 0.0
    for q in (50, 95):
        f[f"sef{q}"] = freq[np.argmax(np.cumsum(share) >= q / 100)] if power.sum() > 0 else 0.0
    dx, ddx = np.diff(x), np.diff(x, 2)
    v = [a.var() if len(a) else 0.0 for a in (x, dx, ddx)]
    f["hjorth_activity"] = v[0]
    f["hjorth_mobility"] = math.sqrt(v[1] / v[0]) if v[0] > 0 and v[1] > 0 else 0.0
    f["hjorth_complexity"] = math.sqrt(v[2] / v[1]) / f["hjorth_mobility"] if f["hjorth_mobility"] > 0 and v[2] > 0 else 0.0
    s = x[:: math.ceil(n / 120)]

    def matches(m):
        t = [s[i : i + m] for i in range(len(s) - m + 1)]
        return sum(np.abs(a - b).max() <= 0.2 * s.std() for i, a in enumerate(t) for b in t[i + 1 :])

    ok = len(s) > 3 and s.std() > 0 and matches(2) > 0 and matches(3) > 0
    f["sample_entropy"] = -math.log(matches(3) / matches(2)) if ok else 0.0
    p = x[:: math.ceil(n / 300)]
    codes = [tuple(np.argsort(p[i : i + 3], kind="stable")) for i in range(len(p) - 2)]
    freqs = np.array([codes.count(c) for c in set(codes)]) / len(codes) if len(codes) > 1 else np.ones(1)
    f["permutation_entropy"] = float(-(freqs * np.log2(freqs)).sum() / math.log2(6))
    m2, m3, m4 = (((x - x.mean()) ** i).mean() for i in (2, 3, 4))
    g1, g2 = (m3 / m2**1.5, m4 / m2**2 - 3) if m2 > 0 else (0.0, 0.0)
    f["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 0 else g1
    f["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 and m2 > 0 else g2
    return f


@pytest.mark.parametrize("normalize", [False, True])
def test_features(waves, normalize):
    for row in signal.export_features(waves, "signal", FS, normalize=normalize).collect():
        x = clean(row["signal"])
        got = {c[4:]: row[c] for c in row.asDict() if c.startswith("eeg_")}
        assert len(got) == 24
        if not len(x):
            assert set(got.values()) == {None}
            continue
        if normalize:
            x = (x - x.mean()) / (x.std() or 1.0)
        want = by_hand(x)
        assert set(want) == set(got)
        for c, v in want.items():
            assert got[c] == pytest.approx(v, rel=1e-7, abs=1e-9), (row["id"], c)


def test_expressions_agree_with_the_batch(waves):
    full = signal.export_features(waves, "signal", FS).filter("eeg_mean is not null")
    x = F.col("x")
    d = full.withColumn("x", arrays.finite(F.col("signal")))
    d = d.withColumns({"m": arrays.moments(x), "h": signal.hjorth(x), "p": signal.psd(x, FS), "se": signal.sample_entropy(x)})
    skew, kurt = signal.shape(F.col("m"))
    pairs = {
        "mean": F.col("m.mu"), "var": F.col("m.m2"), "zero_crossing_rate": signal.crossings(x), "hjorth_mobility": F.col("h.mobility"),
        "hjorth_complexity": F.col("h.complexity"), "permutation_entropy": signal.permutation_entropy(x), "skewness": skew, "kurtosis": kurt,
        "sample_entropy": F.col("se"), "spectral_entropy": signal.spectral_entropy(F.col("p")),
    }
    for r in d.select("id", *[F.struct(F.col(f"eeg_{n}").alias("a"), c.alias("b")).alias(n) for n, c in pairs.items()]).collect():
        for n in pairs:
            assert r[n]["a"] == pytest.approx(r[n]["b"], rel=1e-9, abs=1e-9), (r["id"], n)


def test_epoch_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "signal array<float>")
    cut = lambda a, b, n: [r[0] for r in df.select(arrays.cut_epoch(F.col("signal"), F.lit(2.0), F.lit(a), F.lit(b), n)).collect()]
    assert cut(0.5, 1.5, 4) == [[2.0, 3.0, 3.0, 3.0], [0.0] * 4]
    assert cut(0.0, 2.0, 3)[0] == [1.0, 2.0, 3.0] and cut(9.0, 10.0, 2)[0] == [0.0, 0.0]
    assert cut(0.25, 1.25, 2)[0] == [1.0, 2.0]  # half samples round to even
    z = df.select(arrays.normalize(F.col("signal").cast("array<double>"))).first()[0]
    assert z == pytest.approx([-1.341640786, -0.447213595, 0.447213595, 1.341640786])


@pytest.mark.parametrize("n,orig,target", [(64, 64, 100), (65, 64, 32), (64, 64, 32), (10, 10, 15), (7, 7, 14)])
def test_resample(spark, n, orig, target):
    t = np.arange(n) / orig
    x = 1 + np.sin(2 * np.pi * t * orig / n)  # one period fits the window, so resampling is exact
    df = spark.createDataFrame([(x.tolist(),)], "signal array<double>")
    got = df.select(arrays.resample(F.col("signal"), orig, target, "double")).first()[0]
    m = round(n * target / orig)
    assert got == pytest.approx((1 + np.sin(2 * np.pi * np.arange(m) / m)).tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        arrays.resample(F.col("signal"), 0, 1)


def test_augment(spark):
    df = spark.range(50).select("id", F.array_repeat(F.lit(1.0), 40).alias("signal")).repartition(5)
    run = lambda **k: {r[0]: np.array(r[1]) for r in df.select("id", arrays.augment(F.col("signal"), F.col("id"), **k)).collect()}
    noisy = run(noise_std=0.5)
    assert abs(np.std(np.concatenate(list(noisy.values()))) - 0.5) < 0.03
    assert all(0.5 <= v[0] <= 2.0 and np.ptp(v) == 0 for v in run(scale=(0.5, 2.0)).values())
    assert all((v == 0).sum() == 4 for v in run(mask_fraction=0.1, mask_count=1).values())
    kept = sum(np.allclose(v, 1) for v in run(band_fraction=1.0, band_prob=0.5).values())
    assert 10 < kept < 40
    again = run(noise_std=0.5)
    assert all((again[k] == noisy[k]).all() for k in noisy)


@pytest.mark.parametrize("cell_points", [10_000, 40, 7])
def test_neighbours_are_exact(spark, cell_points):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(size=(200, 3)), rng.normal(3, 0.1, (100, 3)), np.repeat([[9.0, 9.0, 9.0]], 30, axis=0)])
    rows = [("a", v.tolist()) for v in a] + [("b", v.tolist()) for v in rng.normal(size=(50, 3))]
    df = spark.createDataFrame(rows, "cls string, v array<double>")
    points = neighbors.merged_points(df, "cls", "v")
    out = neighbors.nearest(points.select("cls", "v"), points, 4, cell_points=cell_points, rows_per_task=13).collect()
    assert len(out) == points.count()
    groups = {c: np.array([v for k, v in rows if k == c]) for c in ("a", "b")}
    for r in out:
        d = np.sort(np.sqrt(((groups[r["cls"]] - np.array(r["v"])) ** 2).sum(axis=1)))[1:5]  # the first is the point itself
        got = [x["d"] for x in r["near"] for _ in range(x["times"])][:4]
        assert got == pytest.approx(d.tolist(), abs=1e-12)


def test_smote_points_lie_between_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(5, 1, (20, 2))])
    rows = [(float(a), float(b), "m" if i < 60 else "s") for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    out = balance.smote(df, "y", k=3, cell_points=6)
    assert balance.counts_of(out, "y") == {"m": 60, "s": 60}
    made = [(r["a"], r["b"]) for r in out.exceptAll(df).collect()]
    own = x[60:]
    d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1)[:, 1:4]
    for p in made:
        gaps = [np.linalg.norm(own[i] - p) + np.linalg.norm(own[j] - p) - d[i, j] for i in range(20) for j in near[i]]
        assert min(gaps) < 1e-9


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (0, 1, 0.4), (1, 1, 0.8), (1, 0, 0.4)], "y_true int, y_pred int, s double")
    m = metrics.binary_metrics(df, [], score="s").first()
    assert m["accuracy"] == pytest.approx(0.6) and (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 1, 1, 2)
    assert m["auc_roc"] == pytest.approx(5.5 / 6)
    assert metrics.binary_metrics(df.filter("y_true = 1"), [], score="s").first()["auc_roc"] is None
    assert metrics.roc_points(df.filter("y_true = 1"), [], score="s").isEmpty()


def test_multiclass_metrics(spark):
    df = spark.createDataFrame([("W", "W"), ("N1", "W"), ("N2", "N2"), ("N2", "X")], "y_true string, y_pred string")
    m = metrics.multiclass_metrics(df, [], labels=["W", "REM"]).first()
    assert m["accuracy"] == 0.5 and m["macro_f1"] == pytest.approx((2 / 3 + 0 + 2 / 3 + 0) / 4)
    assert m["per_class_f1_w"] == pytest.approx(2 / 3) and m["per_class_f1_rem"] == 0.0
    assert m["cohen_kappa"] == pytest.approx((0.5 - 4 / 16) / (1 - 4 / 16))
    one = metrics.multiclass_metrics(df.filter("y_true = 'W'"), []).first()
    assert one["cohen_kappa"] is None and one["accuracy"] == 1.0


@pytest.mark.parametrize("b,c", [(0, 0), (5, 5), (1, 8), (300, 340), (10, 100_000), (4_000_000, 4_001_000)])
def test_mcnemar_p(b, c):
    n, k = b + c, min(b, c)
    if n < 2000:
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n and b != c else 1.0
        assert metrics._binomial_tail(b, c) == pytest.approx(want, rel=1e-9)
    else:
        z = (abs(b - c) - 1) / math.sqrt(n)
        assert metrics._binomial_tail(b, c) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-2, abs=1e-12)


def test_bootstrap_mean(spark):
    rows = [("a", i, v) for i, v in enumerate([0.7, 0.8, 0.9, 0.75, 0.85])] + [("b", 0, 0.5)]
    df = spark.createDataFrame(rows, "model string, fold int, v double")
    out = {r["model"]: r for r in reporting.bootstrap_mean_ci(df, ["model"], "v", ["fold"], n_boot=2000).collect()}
    rng = np.random.default_rng(0)
    ref = np.percentile(rng.choice([0.7, 0.8, 0.9, 0.75, 0.85], (20_000, 5)).mean(axis=1), [2.5, 97.5])
    assert out["a"]["mean"] == pytest.approx(0.8) and [out["a"]["lo"], out["a"]["hi"]] == pytest.approx(ref.tolist(), abs=0.01)
    assert (out["b"]["lo"], out["b"]["hi"]) == (0.5, 0.5)


def test_bootstrap_auc_difference(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.4).astype(int)
    a, b = (y + rng.normal(size=600)).round(2), np.where(rng.random(600) < 0.4, 0.0, (y + rng.normal(0, 2, 600)).round(1))
    df = spark.createDataFrame([(int(p), float(q), float(r)) for p, q, r in zip(y, a, b)], "y int, a double, b double")
    small = reporting.bootstrap_auc_diff(df, "y", "a", "b", n_boot=300, block_rows=60).first()
    whole = reporting.bootstrap_auc_diff(df, "y", "a", "b", n_boot=300).first()
    assert tuple(small) == pytest.approx(tuple(whole), abs=1e-12)  # blocks change nothing, ties included

    def auc(t, s):
        d = s[t == 1][:, None] - s[t == 0][None]
        return (d > 0).mean() + (d == 0).mean() / 2

    assert whole["auc_diff"] == pytest.approx(auc(y, a) - auc(y, b))
    ref = []
    for _ in range(300):
        i = rng.integers(0, 600, 600)
        ref.append(auc(y[i], a[i]) - auc(y[i], b[i]))
    assert [whole["lo"], whole["hi"]] == pytest.approx(np.percentile(ref, [2.5, 97.5]).tolist(), abs=0.03)


def test_pca_and_lda(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) + np.eye(3, 4)[g] * 3 + 100
    df = spark.createDataFrame([(*map(float, r), f"c{k}") for r, k in zip(x, g)], "a double, b double, c double, d double, y string")
    out, share = reduction.pca(df, "y", 0.9)
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    k = int(np.searchsorted(np.cumsum(value / value.sum()), 0.9)) + 1
    assert share == pytest.approx((value / value.sum())[:k].tolist()) and out.columns == [*[f"pca_{i + 1}" for i in range(k)], "y"]
    s = np.array([[r[f"pca_{i + 1}"] for i in range(k)] for r in out.collect()])
    assert np.cov(s.T) == pytest.approx(np.diag(value[:k]), abs=1e-6) and s.mean(axis=0) == pytest.approx(np.zeros(k), abs=1e-6)
    lda = reduction.lda(df, "y").collect()
    z, lab = np.array([[r["lda_1"], r["lda_2"]] for r in lda]), np.array([r["y"] for r in lda])
    inner = sum(((z[lab == c] - z[lab == c].mean(axis=0)).T @ (z[lab == c] - z[lab == c].mean(axis=0)) for c in set(lab)), np.zeros((2, 2))) / (120 - 3)
    assert inner == pytest.approx(np.eye(2), abs=1e-8)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(12):
        for i in range(20):
            k = (s + i) % 3
            rows.append((s, f"c{k}", float(k == 0), *map(float, rng.normal(np.eye(3)[k] * 4, 1)), None if i == 0 else float(i)))
    return spark.createDataFrame(rows, "subject int, y string, hit double, f0 double, f1 double, f2 double, f3 double")


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "kernel_margin"])
def test_models_learn(blobs, name):
    params = {"random_forest": {"n_estimators": 10, "max_depth": 5}, "boosted_trees": {"n_estimators": 5}, "kernel_margin": {"max_iter": 20}}[name]
    train, test = blobs.filter("subject < 9"), blobs.filter("subject >= 9")
    for target, task in (("y", "multiclass"), ("hit", "binary")):
        m = models.fit_model(train, ["f0", "f1", "f2", "f3"], target, name, {**params, "class_weight": "balanced"}, task=task)
        p = models.predict(m, test, target)
        assert p.filter(F.col(target).cast("string") == F.col("y_pred")).count() / p.count() > 0.85
        assert (p.filter("y_score is not null").count() > 0) == (task == "binary")
    with pytest.raises(ValueError):
        models.predict(m, test.withColumn("hit", F.lit(7.0)), "hit")
    with pytest.raises(ValueError):
        models.fit_model(train.filter("y = 'c1'"), ["f0"], "y", name)


def test_search_and_resume(spark, blobs):
    search = models.Search({"random_forest": {"max_depth": [1, 5], "n_estimators": [5]}}, "accuracy", inner_splits=2)
    run = models.run_subject_cv(blobs, "subject", "y", ["f0", "f1", "f2"], {"random_forest": {}}, k=2, search=search, refit=False, done={("random_forest", 0)})
    assert [r["fold_id"] for r in run.metrics.collect()] == [1] and len(run.tuning) == 1
    assert '"max_depth": 5' in run.best_params(spark).first()["params"]
    assert models.grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    with pytest.raises(ValueError):
        models.scoring_for("binary", "macro_f1")
    assert models.scoring_for("binary", "macro_f1", fallback=True) == "auc_roc"


def test_train_resampling(blobs):
    few = blobs.filter("y <> 'c0' or subject < 4")
    m = models.fit_model(few, ["f0", "f1", "f2"], "y", "random_forest", {"n_estimators": 3, "max_depth": 3}, resampling={"reference": "c1", "offset": 10, "labels": ["c0"], "k": 3})
    assert m.labels == ["c0", "c1", "c2"]


def test_spearman_with_ties_and_holes(spark):
    """Every pair beside pandas: shared and different holes, heavy ties, a constant and an empty column."""
    rnd = np.random.default_rng(11)
    n = 600
    frame = pd.DataFrame({"a": rnd.normal(size=n), "b": rnd.integers(0, 4, n).astype(float), "hot": np.where(rnd.random(n) < 0.9, 1.0, rnd.random(n)), "c": rnd.normal(size=n), "d": rnd.integers(0, 50, n).astype(float), "one": 3.0, "none": np.nan})
    frame["e"] = -frame["a"] + rnd.normal(size=n)
    frame.loc[rnd.random(n) < 0.3, "c"] = np.nan
    frame.loc[rnd.random(n) < 0.5, "d"] = np.nan
    got = {(r.column_a, r.column_b): r.r for r in profile.correlation_spearman(spark.createDataFrame(frame).repartition(6)).collect()}
    assert len(got) == 8 * 7 // 2
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna()
        want = both[a].rank().corr(both[b].rank()) if len(both) > 1 else np.nan
        assert (r is None and np.isnan(want)) or r == pytest.approx(want, abs=1e-9), (a, b)
