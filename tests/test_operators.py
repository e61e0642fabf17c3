"""Small tables with literal expectations, and the errors operators must raise."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nocturne import session
from nocturne.functions import labels, text
from nocturne.operators import balance, chain, cleaning, encoding, filters, folds, joins, profile, reduction, scaling, schema, timeseries
from nocturne.operators.cleaning import CleaningOptions, clean
from nocturne.sources import epoch_store, recordings, tables


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_clean_whole_sequence(spark):
    df = frame(spark, [(30.0, "Lima"), (30.0, " lima "), (None, None), (None, "Cusco")], "`Edad ` double, Ciudad string")
    out, log = clean(df)
    assert out.columns == ["edad", "ciudad"]
    assert sorted(map(tuple, out.collect())) == [(30.0, "cusco"), (30.0, "lima")]
    got = {(r["metric"], r["detail"]): r["value"] for r in log.collect()}
    assert got[("input_rows", "")] == "4" and got[("output_rows", "")] == "2"
    assert got[("removed_empty_rows", "")] == "1" and got[("removed_duplicates", "")] == "1"


def test_clean_winsorize_keeps_target(spark):
    rows = [(1.0, "a"), (2.0, "b"), (3.0, "a"), (4.0, "b"), (5.0, "a"), (100.0, "b")]
    out, log = clean(frame(spark, rows, "feature double, sleep_stage string"), CleaningOptions(target="sleep_stage", winsorize=True))
    assert max(column(out, "feature")) == pytest.approx(8.5)
    assert ("winsorized_high", "1", "feature") in [tuple(r) for r in log.collect()]


def test_clean_sparse_column_and_null_target(spark):
    df = frame(spark, [(1.0, None, "a"), (2.0, None, "b"), (3.0, 9.0, None)], "ok double, mostly_missing double, label string")
    out, _ = clean(df, CleaningOptions(target="label", drop_missing_pct=50.0, drop_target_missing=True))
    assert out.columns == ["ok", "label"] and out.count() == 2
    with pytest.raises(ValueError):
        schema.drop_high_missing(df, 120)
    with pytest.raises(ValueError):
        clean(df, CleaningOptions(target="absent"))


def test_clean_takes_raw_names(spark):
    df = frame(spark, [("a", 1, 5), ("a", 2, 6), ("b", 3, 7)], "`Subject Id` string, `Row No` int, Value int")
    out, _ = clean(df, CleaningOptions(target="Value", dedupe_subset=["Subject Id"], order=["Row No"]))
    assert sorted(column(out, "value")) == [5, 7]
    with pytest.raises(ValueError):
        clean(df, CleaningOptions(dedupe_subset=["other"], order=["Row No"]))


def test_rename_collision(spark):
    with pytest.raises(ValueError):
        schema.rename_snake(frame(spark, [(1, 2)], "`A b` int, `a_b` int"))


def test_deduplicate_subset_keeps_first(spark):
    df = frame(spark, [("s", 1, 10), ("s", 1, 20), ("t", 1, 30), (None, 1, 40), (None, 1, 50)], "subject string, window int, value int")
    assert sorted(column(filters.deduplicate(df, ["subject", "window"], ["value"]), "value")) == [10, 30, 40]
    with pytest.raises(ValueError):
        filters.deduplicate(df, ["subject"])


def test_numeric_text(spark):
    df = frame(spark, [(x,) for x in ["1", " 2 ", "3e0", "-.5", "1d", "4", "5", "6", "7", "8"]], "num_text string")
    out, done = cleaning.coerce_numeric(df)
    assert done == [{"column": "num_text", "induced": 1, "parsed": 9}]
    assert column(out, "num_text") == [1.0, 2.0, 3.0, -0.5, None, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert cleaning.coerce_numeric(df.limit(5))[1] == []


def test_category_text(spark):
    df = frame(spark, [("  Lima ",), ("lima",), ("LIMA",), ("a  b",), (None,)], "cat string")
    assert column(cleaning.normalize_strings(df)[0], "cat") == ["lima", "lima", "lima", "a b", None]
    assert cleaning.normalize_strings(df, 2)[1] == []


def test_nan_is_null(spark):
    df = schema.nan_to_null(frame(spark, [(float("nan"),), (1.0,)], "x double"))
    assert column(df, "x") == [None, 1.0]


def test_stage_labels(spark):
    df = frame(spark, [(x,) for x in ["w", "1", "2", "3", "4", "r", "N2", "REM", "odd", None]], "s string")
    assert column(df.select(labels.normalize_stage_label(F.col("s")).alias("s")), "s") == ["W", "N1", "N2", "N3", "N3", "REM", "N2", "REM", "odd", None]


def test_subjects(spark):
    df = frame(spark, [("a/b/c.csv",), ("flat.csv",), ("x\\y\\z.csv",), (".hidden",), ("a//b/c",)], "p string")
    assert column(df.select(text.subject_from_path(F.col("p")).alias("s")), "s") == ["a/b", "flat", "x/y", ".hidden", "a/b"]
    rec = frame(spark, [("SC4001E0",), ("abcd",), ("x",)], "r string")
    assert column(rec.select(text.subject_from_recording(F.col("r")).alias("s")), "s") == ["SC4001", "ab", "x"]
    both = frame(spark, [("r1", None), ("r2", "s2")], "record_id string, subject_unit_id string")
    assert column(schema.ensure_subject(both), "subject_unit_id") == ["r1", "r2"]
    with pytest.raises(ValueError):
        schema.ensure_subject(frame(spark, [(1,)], "x int"))


def test_annotation_tokens(spark):
    df = frame(spark, [("2 HA",), ("4 LA LA",), ("W",), ("R H",), ("",), (None,)], "a string")
    out = df.select(text.annotation_stage(F.col("a")).alias("s"), text.annotation_events(F.col("a")).alias("e"))
    assert [tuple(r) for r in out.collect()] == [("2", ["HA"]), ("4", ["LA", "LA"]), ("W", []), ("R", ["H"]), ("unknown", []), ("unknown", [])]


def test_channels(spark):
    rows = [(1, 0, "EEG Pz-Oz"), (1, 1, "eeg fpz-cz"), (2, 0, "EOG"), (2, 1, "EEG_FPZ_CZ"), (3, 0, "EOG"), (3, 1, " EEG x")]
    df = frame(spark, rows, "rec int, ordinal int, channel string")
    assert column(schema.match_channel(df, ["EEG Fpz-Cz"], ["rec"]), "channel", "rec") == ["eeg fpz-cz", "EEG_FPZ_CZ", " EEG x"]
    with pytest.raises(PySparkException):
        schema.match_channel(df, "EEG Fpz-Cz", ["rec"]).collect()


def test_features(spark):
    df = frame(spark, [(1, 1.0, 2.0, "x", True)], "id int, eeg_mean double, ecg_mean double, s string, b boolean")
    assert schema.resolve_features(df, ["id", "ecg_mean"]) == ["eeg_mean"]
    assert schema.resolve_features(df, ["id"], allow_many_signals=True) == ["eeg_mean", "ecg_mean"]
    for bad in (dict(exclude=["id"]), dict(include=["s"]), dict(include=["none"]), dict(include=["id"], exclude=["id"])):
        with pytest.raises(ValueError):
            schema.resolve_features(df, **bad)
    with pytest.raises(ValueError):
        schema.resolve_features_cross(df.select("id"), df.select("s"))


def test_wake_trim(spark):
    stages = ["W", "W", "N1", "N2", "N3", "REM", "W", "W"]
    df = frame(spark, [("r", i, s) for i, s in enumerate(stages)] + [("w", i, "W") for i in range(3)], "rec string, e int, sleep_stage string")
    out = filters.wake_trim(df, "rec", ["e"], minutes=0).filter("rec = 'r'")
    assert column(out, "e", "e") == [2, 3, 4, 5]
    assert out.first()["recording_epochs_before_trim"] == 8 and out.first()["recording_epochs_after_trim"] == 4
    assert filters.wake_trim(df, "rec", ["e"], minutes=0).filter("rec = 'w'").count() == 3


def test_context_stays_in_recording(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 10.0), ("b", 1, 20.0)], "rec string, e int, x double")
    out = timeseries.temporal_context(df, "rec", "e", ["x"]).orderBy("rec", "e")
    assert column(out, "x_lag1") == [1.0, 1.0, 10.0, 10.0] and column(out, "x_lead1") == [2.0, 2.0, 20.0, 20.0]


def test_sequence_window(spark):
    df = frame(spark, [("a", i) for i in range(4)], "rec string, e int")
    out = timeseries.sequence_index(df, "rec", ["e"], 3).orderBy("e")
    assert column(out, "window") == [[0, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 3]]
    with pytest.raises(ValueError):
        timeseries.sequence_index(df, "rec", ["e"], 2)


def test_binary_target(spark):
    ok = frame(spark, [("0",), ("1",)], "y string")
    filters.validate_binary_target(ok, "y")
    for rows, kw in (([(1,), (1,)], {}), ([(0,), (2,)], {}), ([], {}), ([(1,), (2,), (3,)], {"relaxed": True})):
        with pytest.raises(ValueError):
            filters.validate_binary_target(frame(spark, rows, "y int"), "y", **kw)
    filters.validate_binary_target(frame(spark, [(1,)], "y int"), "y", training=False)


def test_encoding(spark):
    df = frame(spark, [("red", "s", "yes"), ("blue", "l", "No"), (None, "?", "SÍ"), ("red", "m", None)], "color string, size string, flag string")
    out, added = encoding.encode(df, encoding.EncodingSpec(binary=["flag"], ordinal={"size": ["S", "m", "l"]}, nominal=["color"]))
    assert added == ["color_blue", "color_red"]
    assert [tuple(r) for r in out.collect()] == [(0.0, 1.0, 0.0, 1.0), (2.0, 0.0, 1.0, 0.0), (1.0, 1.0, 0.0, 0.0), (1.0, None, 0.0, 1.0)]
    with pytest.raises(PySparkException):
        encoding.encode(df, encoding.EncodingSpec(binary=["color"]))[0].collect()
    with pytest.raises(PySparkException):
        encoding.encode(df, encoding.EncodingSpec(ordinal={"size": ["s", "m", "l"]}, unknown="raise"))[0].collect()
    with pytest.raises(ValueError):
        encoding.encode(df, encoding.EncodingSpec(ordinal={"size": ["s"]}, nominal=["size"]))
    with pytest.raises(ValueError):
        encoding.categories(df, "color", cap=1)


def test_decode(spark):
    df = frame(spark, [(1.0, 0.0, 0.3), (0.0, 1.0, 0.1), (0.0, 0.0, 0.2)], "sleep_stage_w double, sleep_stage_n2 double, sleep_stage_frac_w double")
    out, used = encoding.decode_one_hot(df, "sleep_stage")
    assert used == ["sleep_stage_w", "sleep_stage_n2"] and column(out, "sleep_stage") == ["w", "n2", "<UNASSIGNED>"]
    scaled = frame(spark, [(1.8, -0.6), (-0.5, 1.7)], "sleep_stage_w double, sleep_stage_n2 double")
    assert column(encoding.decode_one_hot(scaled, "sleep_stage")[0], "sleep_stage") == ["w", "n2"]
    with pytest.raises(ValueError):
        encoding.decode_one_hot(df, "other")


def test_scaling(spark):
    df = frame(spark, [(1.0, 7.0, None), (2.0, 7.0, 4.0), (3.0, 7.0, 8.0)], "x double, flat double, holed double")
    z = scaling.scale_apply(df, scaling.scale_fit(df, ["x", "flat", "holed"]))
    assert column(z, "x") == pytest.approx([-1.224744871, 0, 1.224744871]) and column(z, "flat") == [0.0] * 3 and column(z, "holed")[0] is None
    assert column(scaling.scale_apply(df, scaling.scale_fit(df, ["x"], "minmax")), "x") == [0.0, 0.5, 1.0]
    assert scaling.scale_columns(df, include=["x", "flat"], target="flat") == ["x"]


def test_balance(spark):
    df = spark.range(20).select("id", F.when(F.col("id") < 15, 0).otherwise(1).alias("y"))
    assert balance.counts_of(balance.random_under(df, "y", ["id"]), "y") == {"0": 5, "1": 5}
    over = balance.random_over(df, "y", ["id"])
    assert balance.counts_of(over, "y") == {"0": 15, "1": 15} and over.select("id").distinct().count() == 20
    assert balance.counts_of(balance.random_under(df, "y", ["id"], {"0": 7}), "y") == {"0": 7, "1": 5}
    assert balance.random_under(df, "y", ["id"], seed=1).exceptAll(balance.random_under(df, "y", ["id"], seed=1)).isEmpty()
    for strategy, under in (({"0": 30}, True), ({"1": 3}, False), ({"9": 3}, False)):
        with pytest.raises(ValueError):
            balance.targets({"0": 15, "1": 5}, under, strategy)
    assert balance.targets({"0": 15, "1": 5}, False, 0.5) == {"0": 15, "1": 7}


def test_reference_targets():
    counts = {"W": 2, "N2": 6}
    assert balance.reference_targets(counts, "N2", 2, ["W", "N1"]) == ({"W": 4}, 1)
    assert balance.reference_targets(counts, "N2", 7000, ["W"]) == ({}, 0)
    assert balance.reference_targets({"W": 1, "N2": 6}, "N2", 2, ["W"]) == ({}, 0)


def test_smote_errors(spark):
    df = frame(spark, [(1.0, "a"), (None, "b")], "x double, y string")
    with pytest.raises(ValueError):
        balance.smote(df, "y")
    with pytest.raises(ValueError):
        balance.smote(df.withColumn("t", F.lit("text")), "y")


def test_reduction_errors(spark):
    df = frame(spark, [(1.0, 2.0, "a"), (1.0, 3.0, "b"), (1.0, 4.0, "a")], "flat double, x double, y string")
    out, dropped = reduction.variance_threshold(df, 0.0, "y")
    assert dropped == ["flat"] and out.columns == ["x", "y"]
    with pytest.raises(ValueError):
        reduction.pca(df.withColumn("x", F.when(F.col("x") > 2, F.col("x"))), "y")
    with pytest.raises(ValueError):
        reduction.lda(df.withColumn("y", F.lit("a")), "y")
    assert reduction.is_class_target(df, "y") and not reduction.is_class_target(df, "flat")
    assert reduction.is_class_target(df.withColumn("z", F.col("x").cast("int")), "z")


def test_chain_with_balance_and_selection(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), ((F.col("id") * 7) % 13).cast("double").alias("b"), F.when(F.col("id") < 45, "x").otherwise("y").alias("y"))
    o = chain.ChainOptions(target="y", cleaning=CleaningOptions(target="y"), balance="smote", scaling="minmax", reduction="select_k_best", reduction_args={"k": 1})
    out = chain.tabular_chain(df, o)
    assert out.columns == ["a", "y"] and balance.counts_of(out, "y") == {"x": 45, "y": 45}
    o = chain.ChainOptions(target="y", balance="random_under", balance_order=["a"], reduction="pca", reduction_args={"n": 2})
    assert chain.tabular_chain(df, o).columns == ["pca_1", "pca_2", "y"]


def test_folds_have_no_leak(spark):
    df = frame(spark, [(s, y, i) for i, (s, y) in enumerate([("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 0)])], "s string, y int, id int")
    f = folds.stratified_group_folds(df, "s", "y", 3)
    assert f.count() == 3 and {r["fold"] for r in folds.group_folds(df, "s", 3).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        filters.validate_cv_ready(df, "s", 4)
    with pytest.raises(PySparkException):
        joins.assign_fold(df, f.filter("s <> 'c'").select("s", "fold"), "s").collect()


def test_subject_samples(spark):
    df = spark.range(80).select((F.col("id") % 40).alias("s"), F.when(F.col("id") % 40 == 0, "rare").when(F.col("id") % 2 == 0, "x").otherwise("y").alias("y"))
    part = folds.subsample_with_coverage(df, "s", "y", 0.25, 32)
    assert part.select("s").distinct().count() >= 32 and part.select("y").distinct().count() == 3
    split = folds.train_val_split(df, "s", 0.2)
    assert split.filter("part = 'val'").select("s").distinct().count() == 8
    assert folds.train_val_split(df, "s", 0.0).filter("part = 'val'").isEmpty()
    assert filters.subject_fraction(df, "s", 0.1).select("s").distinct().count() == 4
    with pytest.raises(ValueError):
        filters.subject_fraction(df, "s", 0)


def test_alignment_and_manifest_errors(spark):
    a = frame(spark, [(0, 0, "x", "x")], "fold_id int, row_id int, y_true string, y_pred string")
    with pytest.raises(PySparkException):
        joins.align_predictions(a, a.withColumn("y_true", F.lit("y"))).collect()
    with pytest.raises(ValueError):
        epoch_store.validate_manifest(a)
    m = frame(spark, [("p", "x", 1.0, 1, "c", 1)], "epoch_store_relpath string, epoch_store_row string, sample_hz double, samples_per_epoch int, channel_name_used string, store_version int")
    with pytest.raises(PySparkException):
        epoch_store.validate_manifest(m).collect()


def test_label_masks_need_columns(spark):
    with pytest.raises(ValueError):
        schema.label_masks(frame(spark, [("d",)], "dataset_id string"))


def test_stage_and_event_text(spark, tmp_path):
    (tmp_path / "ucddb001_stage.txt").write_text("0\n1\n2\n2\n5\n")
    (tmp_path / "ucddb002_stage.txt").write_text("0\nx\n")
    out, report = recordings.scan_stage_text(spark, str(tmp_path))
    assert [tuple(r) for r in out.orderBy("epoch_index").collect()] == [("ucddb001", i, s) for i, s in enumerate([0, 1, 2, 2, 5])]
    assert tuple(report.first()) == (1, 1)
    s = recordings.recording_stage_summary(out).first()
    assert (s["n_epochs"], s["stage_mode"], s["stage_median"], s["stage_2_frac"]) == (5, 2, 2.0, 0.4)
    events = tmp_path / "events"
    events.mkdir()
    (events / "ucddb001_respevt.txt").write_text("Time Type Duration\n00:01:05  HYP-C  12.9 x\n00:02:00 A\nbad\n01:00:00 CA n/a\n10:00:00   OA  -3.5\n")
    got = recordings.parse_event_text(spark, str(events)).orderBy("start_sec").collect()
    assert [tuple(r) for r in got] == [("ucddb001", 65.0, 77.0, "HYP-C"), ("ucddb001", 36000.0, 35997.0, "OA")]


def test_segment_files(spark, tmp_path):
    d = tmp_path / "Non_Events" / "batch"
    d.mkdir(parents=True)
    (d / "S1_p10_Stagen2_Event1_Session1.csv").write_text("ch0,ch1\nx,1\ny,2\nz,3\n")
    (d / "S1_p11_Stagen3.csv").write_text("ch0\nx\n")
    (d / "S1_p12.csv").write_text("C3-M2\n1\n")
    (d / "S1_p13_Stagen1.csv").write_text("\n")
    used, report = recordings.scan_segment_files(spark, str(tmp_path))
    r = used.first()
    assert used.count() == 1 and r["source_file"] == "Non_Events/batch/S1_p10_Stagen2_Event1_Session1.csv"
    assert (r["subject_unit_id"], r["event_group"], r["sleep_stage"], r["eeg_channel"], r["signal"]) == ("S1_p10", "non_event", 2, "ch1", [1.0, 2.0, 3.0])
    assert tuple(report.first()) == (1, 3)
    with pytest.raises(ValueError):
        recordings.scan_segment_files(spark, str(d / "S1_p12.csv"))


def test_table_suffix(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.json")
    tables.write_table(frame(spark, [(1, float("nan"))], "a int, b double"), str(tmp_path / "deep/er/t.parquet"))
    assert tuple(tables.read_table(spark, str(tmp_path / "deep/er/t.parquet")).first()) == (1, None)


def test_shared_folders_are_not_local_on_a_cluster(spark, monkeypatch):
    from nocturne import session

    path = session.shared_dir(spark)
    spark.range(3).write.parquet(path)
    session.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_weights_count_rows_without_a_class(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "y string")
    assert {r["label"]: r["weight"] for r in balance.class_weights(df, "y").collect()} == {"a": 1.25, "b": 2.5}
    assert {r["label"]: r["cnt"] for r in balance.class_counts(df, "y").collect()} == {"a": 2, "b": 1}
    assert sorted((r["y"] or "", r["weight"] or 0) for r in balance.with_class_weight(df, "y").collect()) == [("", 0), ("", 0), ("a", 1.25), ("a", 1.25), ("b", 2.5)]


def test_texts_are_not_read_as_numbers_in_binary_columns(spark):
    numbers = spark.createDataFrame([(1.0, 1), (0.0, 0), (None, None)], "x double, n int")
    assert [tuple(r) for r in numbers.select(labels.encode_binary(F.col("x")), labels.encode_binary(F.col("n"))).collect()] == [(1.0, 1.0), (0.0, 0.0), (None, None)]
    for text in ("1.0", "1d"):
        with pytest.raises(PySparkException, match="not a binary value"):
            spark.createDataFrame([(text,)], "x string").select(labels.encode_binary(F.col("x"))).collect()


def test_many_categories_need_no_cap(spark):
    df = spark.range(1500).select(F.concat(F.lit("c"), "id").alias("c"))
    assert len(encoding.categories(df, "c")) == 1500
    with pytest.raises(ValueError, match="more than 10"):
        encoding.categories(df, "c", cap=10)


def test_distinct_decimals_stay_apart(spark):
    df = spark.sql("select cast('12345678901234567890123456789012345678' as decimal(38,0)) as d union all select cast('12345678901234567890123456789012345679' as decimal(38,0))")
    assert profile.dataset_profile(df).first()["n_unique"] == 2


def test_wide_correlations_take_two_jobs(spark):
    cols = [F.sin(F.col("id") * (i + 1)).alias(f"f{i}") for i in range(98)]
    df = spark.range(400).select(*cols, F.lit(0.1).alias("flat"), F.when(F.col("id") % 3 > 0, F.cos("id")).alias("holes"))
    spark.sparkContext.setJobGroup("wide", "wide")
    rows = {(r["column_a"], r["column_b"]): r["r"] for r in profile.correlation_pearson(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("wide"))
    spark.sparkContext._jsc.clearJobGroup()
    want = df.toPandas().corr()
    assert len(rows) == 100 * 100 and rows["flat", "f1"] is None and jobs <= 6
    assert all(rows[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a in ("f0", "f50", "holes") for b in ("f3", "f97", "holes"))


def test_files_of_zero_bytes_are_counted(spark, tmp_path):
    """Segments and stage lists: empty files, files of white space and bad ones are skipped and counted."""
    folder = tmp_path / "segments" / "deep er"
    folder.mkdir(parents=True)
    (folder / "SC01_N2_001.csv").write_text("C4-M1\n1\n2\n")
    made = recordings.segment_files(spark, str(tmp_path / "segments")).collect()
    assert len(made) == 1
    (folder / "SC01_N2_002.csv").write_text("")
    (folder / "SC01_N2_003.csv").write_text(" \n")
    rows = {r.source_file.rsplit("/", 1)[-1]: r.usable for r in recordings.segment_files(spark, str(tmp_path / "segments")).collect()}
    assert len(rows) == 3 and not rows["SC01_N2_002.csv"] and not rows["SC01_N2_003.csv"]
    stages = tmp_path / "stages"
    stages.mkdir()
    for name, content in (("a_stage.txt", "0\n1\n"), ("b_stage.txt", ""), ("c_stage.txt", "x\n"), ("d_stage.txt", "\n")):
        (stages / name).write_text(content)
    got, report = recordings.scan_stage_text(spark, str(stages))
    assert [tuple(r) for r in got.orderBy("epoch_index").collect()] == [("a", 0, 0), ("a", 1, 1)]
    assert tuple(report.first()) == (1, 3)


def test_distinct_counts_of_every_type(spark):
    rows = [(1, 0.0, "a", [1], None), (1, -0.0, "b", [1], None), (None, float("nan"), "a", [2], None), (3, float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, l array<int>, n string")
    assert {r.column: r.n_unique for r in profile.dataset_profile(df).collect()} == {"i": 2, "d": 2, "s": 2, "l": 2, "n": 0}


def test_fitted_chain_on_other_rows(spark, tmp_path):
    """Fills, fences, codes, shifts and axes come from the training rows; other rows keep their number, with values training hasn't seen."""
    rows = [(float(i), "yes" if i % 2 else "no", "abc"[i % 3], ["low", "mid", "high"][i % 3], "x" if i % 4 else "y") for i in range(40)] + [(None, None, None, None, "y")]
    train = spark.createDataFrame(rows, "`Raw A` double, `On Off` string, `Kind` string, `Rank` string, `Target` string")
    o = chain.ChainOptions(
        target="Target", cleaning=CleaningOptions(target="Target", winsorize=True, iqr_multiplier=0.2), encoding=encoding.EncodingSpec(binary=["On Off"], nominal=["Kind"], ordinal={"Rank": ["low", "mid", "high"]}),
        balance="smote", scaling="minmax", scale_exclude=("On Off",), reduction="select_k_best", reduction_args={"k": 3, "exclude": ["On Off"]},
    )
    fitted, made = chain.fit_chain(train, o)
    assert len(set(balance.counts_of(made, "target").values())) == 1
    fitted.save(spark, str(tmp_path / "chain"))
    again = chain.FittedChain.load(spark, str(tmp_path / "chain"))
    other = spark.createDataFrame([(1e9, "YES", "zzz", "unheard", "x"), (None, None, None, None, None)], train.schema)
    a, b = (f.apply(other) for f in (fitted, again))
    assert a.columns == made.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr) and a.count() == 2
    steps = {(s, m) for s, m, _, _ in fitted.report}
    assert {("clean", "input_rows"), ("encode", "columns_after"), ("balance", "rows_after"), ("scale", "spread"), ("reduce", "score")} <= steps
    assert fitted.report_table(spark).count() == len(fitted.report)


def test_a_path_of_the_store_gives_one_recording(spark, tmp_path):
    rows = [(f"d{i % 2}", f"rec {i}", e, [float(i), float(e)]) for i in range(9) for e in range(4)]
    df = spark.createDataFrame(rows, "dataset_id string, recording_id string, epoch_index long, signal array<double>")
    manifest = epoch_store.write_epoch_store(df, str(tmp_path / "store"), buckets=4, sample_hz=2.0, epoch_seconds=1.0)
    paths = manifest.select("epoch_store_relpath", "recording_id").distinct().collect()
    assert len(paths) == 9
    for r in paths:
        got = epoch_store.read_recording(spark, str(tmp_path / "store"), r.epoch_store_relpath)
        assert [(x.recording_id, x.epoch_store_row, x.signal[1]) for x in got.collect()] == [(r.recording_id, e, float(e)) for e in range(4)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_named_folder_may_be_a_local_path_on_a_cluster(spark, tmp_path, monkeypatch):
    """The checkpoint folder and the warehouse are shared whatever their scheme; only a warehouse taken for want of a named folder is warned of."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", f"file://{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: conf)
    path = session.shared_dir(spark)
    assert path.startswith("file:") and str(tmp_path) in path
    tables.write_table(spark.range(3), f"{path}/part.csv")
    assert tables.read_table(spark, f"{path}/part.csv", "id bigint").count() == 3
    monkeypatch.undo()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.sparkContext.getCheckpointDir():
        with pytest.warns(UserWarning, match="must share"):
            session.shared_dir(spark)
