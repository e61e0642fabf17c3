"""Queries: labels, filters, joins, epoching and windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions import arrays, labels, text
from nocturne.operators import filters, joins, schema, timeseries
from nocturne.plans import views
from nocturne.plans.views import ANNOTATIONS, ARRAYS, DIRTY, EPOCHS, INTERVALS, Catalog, r, table

catalog = Catalog()
add = catalog.add

RAW_STAGE = "CASE event_id % 9 WHEN 0 THEN 'w' WHEN 1 THEN '1' WHEN 2 THEN ' N2 ' WHEN 3 THEN '3' WHEN 4 THEN '4' WHEN 5 THEN 'Sleep stage R' WHEN 6 THEN 'REM' WHEN 7 THEN 'movement' ELSE NULL END"


def raw_stage(col="event_id"):
    m = F.col(col) % 9
    out = F.lit(None).cast("string")
    for i, s in enumerate(["w", "1", " N2 ", "3", "4", "Sleep stage R", "REM", "movement"]):
        out = F.when(m == i, s).otherwise(out)
    return out


@add("p10_normalize_stage_label", f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'W' WHEN event_id % 9 = 1 THEN 'N1' WHEN event_id % 9 = 2 THEN 'N2' WHEN event_id % 9 IN (3, 4) THEN 'N3'
 WHEN event_id % 9 IN (5, 6) THEN 'REM' WHEN event_id % 9 = 7 THEN 'movement' END AS stage FROM events""")
def p10(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.normalize_stage_label(raw_stage()).alias("stage"))


@add("p11_map_stage_codes", f"""WITH {ARRAYS} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN CASE stage_code WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' ELSE 'N3' END ELSE CAST(stage_code AS VARCHAR) END AS stage FROM v_arrays""")
def p11(spark, sf):
    data = F.when(F.col("vec_id") % 2 == 0, "coded").otherwise("named")
    return views.arrays(spark, sf).select("vec_id", labels.map_stage_codes(F.col("stage_code").cast("string"), data, "coded").alias("stage"))


PATH = "CASE WHEN doc_id % 7 = 0 THEN 'rec' || doc_id || '.csv' WHEN doc_id % 2 = 0 THEN source || '\\' || lang || '\\d' || doc_id || '.csv' ELSE source || '/' || lang || '/d' || doc_id || '.csv' END"


def doc_path():
    d = F.col("doc_id").cast("string")
    return (F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("rec"), d, F.lit(".csv")))
            .when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("\\"), "lang", F.lit("\\d"), d, F.lit(".csv")))
            .otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/d"), d, F.lit(".csv"))))


@add("p12_subject_from_path", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'rec' || doc_id ELSE source || '/' || lang END AS subject FROM documents")
def p12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.subject_from_path(doc_path()).alias("subject"))


@add("p13_ensure_subject", "SELECT event_id, CAST(user_id AS VARCHAR) AS subject_unit_id FROM events")
def p13(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.lit(None).cast("string").alias("subject_id"), F.col("user_id").cast("string").alias("recording_id"))
    return schema.ensure_subject(e).select("event_id", "subject_unit_id")


@add("p14_parse_segment_path", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'plm' WHEN 1 THEN 'rem' WHEN 2 THEN 'non_event' ELSE 'unknown' END AS event_group,
 CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 6 AS INTEGER) END AS stage, CASE WHEN doc_id % 3 = 0 THEN 'segment' || doc_id ELSE 'S1_p' || doc_id % 10 || '_2' END AS subject FROM documents""")
def p14(spark, sf):
    d = F.col("doc_id")
    group = F.when(d % 4 == 0, "Events/PLM").when(d % 4 == 1, "Events/rem").when(d % 4 == 2, "Non_Events").otherwise("other")
    stage = F.when(d % 5 != 0, F.concat(F.lit("batch_stagen"), (d % 6).cast("string"))).otherwise("batch")
    name = F.when(d % 3 == 0, F.concat(F.lit("segment"), d)).otherwise(F.concat(F.lit("S1_p"), (d % 10).cast("string"), F.lit("_2_Session1")))
    path = F.concat(group, F.lit("/"), stage, F.lit("/"), name, F.lit(".csv"))
    return table(spark, sf, "documents").select("doc_id", text.segment_event_group(path).alias("event_group"), text.segment_stage(path).alias("stage"), text.segment_subject(path).alias("subject"))


@add("p15_subject_from_recording", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'SC' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') WHEN length(CAST(user_id AS VARCHAR)) > 2 THEN substr(CAST(user_id AS VARCHAR), 1, length(CAST(user_id AS VARCHAR)) - 2) ELSE CAST(user_id AS VARCHAR) END AS subject FROM events")
def p15(spark, sf):
    u = F.col("user_id").cast("string")
    rec = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SC"), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"), F.lit("E0"))).otherwise(u)
    return table(spark, sf, "events").select("event_id", text.subject_from_recording(rec).alias("subject"))


def aux_note():
    k = F.col("event_id") % 6
    return F.when(k == 0, "2 HA").when(k == 1, "4 LA  LA").when(k == 2, "W").when(k == 3, " R H zz ").when(k == 4, "").otherwise("MT")


AUX = """v_aux AS (SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN 'W' WHEN 3 THEN 'R' WHEN 4 THEN 'unknown' ELSE 'MT' END AS stage,
 CASE event_id % 6 WHEN 0 THEN 'HA' WHEN 1 THEN 'LA LA' WHEN 3 THEN 'H' ELSE '' END AS tokens FROM events)"""


def aux(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", text.annotation_stage(aux_note()).alias("stage"), F.array_join(text.annotation_events(aux_note()), " ").alias("tokens"))


@add("p16_parse_annotation_tokens", f"WITH {AUX} SELECT * FROM v_aux")
def p16(spark, sf):
    return aux(spark, sf)


@add("p17_route_rows", f"""WITH {AUX} SELECT event_id, 'stage' AS target FROM v_aux WHERE stage IN ('W','R','1','2','3','4') UNION ALL SELECT event_id, 'event' FROM v_aux WHERE tokens <> ''
 UNION ALL SELECT event_id, 'skipped' FROM v_aux WHERE stage NOT IN ('W','R','1','2','3','4') AND tokens = ''""")
def p17(spark, sf):
    return filters.route_rows(aux(spark, sf)).select("event_id", "target")


@add("p18_parse_hms", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 AS BIGINT) END AS sec FROM events")
def p18(spark, sf):
    e = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(e % 24), two(e % 60), two((e * 7) % 60))
    return table(spark, sf, "events").select("event_id", text.parse_hms(F.when(e % 5 == 0, F.concat(clock, F.lit(".5"))).otherwise(clock)).alias("sec"))


def channel_table(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "EEG Fpz-Cz").when(F.col("event_type") == "view", "eeg fpz-cz").when(F.col("event_type") == "purchase", "EEG FPZ CZ").when(F.col("event_type") == "error", "EEG Pz-Oz").otherwise("EOG")
    flag = F.max(F.when(F.col("value") > 480, 1).otherwise(0)) == 1
    return e.groupBy("user_id", name.alias("channel")).agg(F.min("event_id").alias("ordinal"), flag.alias("has_numeric"))


CHANNELS = """v_channels AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'EEG Fpz-Cz' WHEN 'view' THEN 'eeg fpz-cz' WHEN 'purchase' THEN 'EEG FPZ CZ' WHEN 'error' THEN 'EEG Pz-Oz' ELSE 'EOG' END AS channel,
 min(event_id) AS ordinal, max(CASE WHEN value > 480 THEN 1 ELSE 0 END) = 1 AS has_numeric FROM events GROUP BY 1, 2)"""


@add("p19_match_channel", f"""WITH {CHANNELS}, k AS (SELECT user_id, channel, CASE WHEN channel = 'Eeg FPZ-CZ' THEN 0 WHEN lower(channel) = 'eeg fpz-cz' THEN 1 WHEN regexp_replace(lower(channel), '[^a-z0-9]', '', 'g') = 'eegfpzcz' THEN 2
 WHEN starts_with(lower(channel), 'eeg') THEN 3 END AS tier, ordinal FROM v_channels)
 SELECT user_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, CASE WHEN tier = 1 THEN -ordinal ELSE ordinal END) AS rn FROM k WHERE tier IS NOT NULL) t WHERE rn = 1""")
def p19(spark, sf):
    return schema.match_channel(channel_table(spark, sf), ["Eeg FPZ-CZ"], ["user_id"])


@add("p20_choose_first_available", f"""WITH {CHANNELS} SELECT user_id, (list(channel ORDER BY CASE channel WHEN 'EEG C3' THEN 0 ELSE 2 END, ordinal) FILTER (WHERE channel = 'EEG C3' OR has_numeric))[1] AS channel FROM v_channels GROUP BY user_id""")
def p20(spark, sf):
    return schema.choose_first_available(channel_table(spark, sf), ["EEG C3"], ["user_id"])


def multitask_rows(spark, sf):
    a = views.arrays(spark, sf)
    return a.select(
        F.when(F.col("vec_id") % 2 == 0, "st_vincent_apnea").otherwise("other").alias("dataset_id"), F.concat(F.lit("s"), F.col("recording_id")).alias("subject_unit_id"), F.col("recording_id"),
        F.col("epoch_index").cast("string").alias("epoch_index"), (F.col("epoch_index") * 30.0).alias("epoch_start_sec"), F.when(F.col("vec_id") % 11 != 0, F.col("epoch_index") * 30.0 + 30).alias("epoch_end_sec"),
        F.col("apnea_binary"), F.when(F.col("vec_id") % 5 != 0, F.col("stage_code").cast("string")).alias("sleep_stage"), "vec_id")


@add("p21_label_masks", f"""WITH {ARRAYS}, m AS (SELECT vec_id, recording_id, epoch_index, apnea_binary, CASE WHEN vec_id % 5 <> 0 THEN stage_code END AS sc FROM v_arrays)
 SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'st_vincent_apnea' ELSE 'other' END AS dataset_id, CAST(recording_id AS VARCHAR) AS recording_id, CAST(epoch_index AS BIGINT) AS epoch_index, CAST(apnea_binary AS DOUBLE) AS apnea_binary,
 CASE WHEN vec_id % 2 = 0 AND sc = 0 THEN 'W' WHEN sc = 0 THEN '0' WHEN sc = 1 THEN 'N1' WHEN sc = 2 THEN 'N2' WHEN sc >= 3 THEN 'N3' END AS sleep_stage,
 CAST(apnea_binary IS NOT NULL AS INTEGER) AS label_mask_apnea, CAST(sc IS NOT NULL AS INTEGER) AS label_mask_stage
 FROM m WHERE (apnea_binary IS NOT NULL OR sc IS NOT NULL) AND vec_id % 11 <> 0""")
def p21(spark, sf):
    m = schema.label_masks(multitask_rows(spark, sf))
    return m.select("vec_id", "dataset_id", "recording_id", "epoch_index", "apnea_binary", "sleep_stage", "label_mask_apnea", "label_mask_stage")


@add("p21_label_masks_strict", f"""WITH {EPOCHS} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'W' WHEN event_id % 9 = 1 THEN 'N1' WHEN event_id % 9 = 2 THEN 'N2' WHEN event_id % 9 IN (3, 4) THEN 'N3' WHEN event_id % 9 IN (5, 6) THEN 'REM' END AS sleep_stage,
 CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE END AS apnea_binary, CAST(event_id % 9 < 7 AS INTEGER) AS label_mask_stage, CAST(event_id % 3 = 0 AS INTEGER) AS label_mask_apnea FROM events""")
def p21b(spark, sf):
    e = table(spark, sf, "events").select("event_id", raw_stage().alias("sleep_stage"), F.when(F.col("event_id") % 3 == 0, "1").alias("apnea_binary"))
    return schema.label_masks_strict(e)


@add("p22_project_multitask_schema", f"""WITH {EPOCHS} SELECT 'corpus_a' AS dataset_id, CAST(recording_id AS VARCHAR) AS subject_unit_id, CAST(recording_id AS VARCHAR) AS recording_id, epoch_index, epoch_index * 30.0::DOUBLE AS epoch_start_sec,
 epoch_index * 30.0::DOUBLE + 30 AS epoch_end_sec, CAST(NULL AS VARCHAR) AS source_file, 'EEG' AS eeg_channel_standardized, CAST(NULL AS DOUBLE) AS apnea_binary, sleep_stage, CAST(NULL AS DOUBLE) AS severity_global FROM v_epochs""")
def p22(spark, sf):
    e = views.epochs(spark, sf)
    return schema.project_multitask(e, dataset_id="corpus_a", subject_unit_id=F.col("recording_id"), epoch_start_sec=F.col("epoch_index") * 30.0, epoch_end_sec=F.col("epoch_index") * 30.0 + 30, eeg_channel_standardized="EEG")


@add("f4_label_subset", f"WITH {EPOCHS} SELECT event_id, sleep_stage FROM v_epochs WHERE sleep_stage IN ('N1', 'N3')")
def f4(spark, sf):
    return filters.label_subset(views.staged(spark, sf).select("event_id", "sleep_stage"), "sleep_stage", ["N1", "N3"])


@add("f5_validate_binary_target", f"WITH {ARRAYS} SELECT 'apnea' AS target, 'single_class' AS rule, 0::BIGINT AS found WHERE FALSE UNION ALL SELECT 'stage', 'not_zero_one', count(*) FROM v_arrays WHERE stage_code NOT IN (0, 1) UNION ALL SELECT 'stage_relaxed', 'too_many_classes', count(DISTINCT stage_code) FROM v_arrays")
def f5(spark, sf):
    a = views.arrays(spark, sf)
    tag = lambda n, d: d.select(F.lit(n).alias("target"), "rule", "found")
    out = tag("apnea", filters.binary_target_violations(a, "apnea_binary")).unionByName(tag("stage", filters.binary_target_violations(a, "stage_code")))
    return out.unionByName(tag("stage_relaxed", filters.binary_target_violations(a, "stage_code", relaxed=True)))


@add("f6_validate_cv_ready", "SELECT count(DISTINCT user_id) AS n_subjects FROM events")
def f6(spark, sf):
    return filters.subject_count(filters.validate_cv_ready(table(spark, sf, "events"), "user_id", 5), "user_id")


@add("f7_unseen_labels", f"WITH {EPOCHS} SELECT DISTINCT sleep_stage AS label FROM v_epochs WHERE sleep_stage IN ('REM', 'W')")
def f7(spark, sf):
    e = views.staged(spark, sf)
    return filters.unseen_labels(e.filter(~F.col("sleep_stage").isin("REM", "W")), e, "sleep_stage")


@add("f8_wake_trim", f"""WITH {EPOCHS}, w AS (SELECT *, min(CASE WHEN sleep_stage <> 'W' THEN epoch_index END) OVER (PARTITION BY recording_id) AS a, max(CASE WHEN sleep_stage <> 'W' THEN epoch_index END) OVER (PARTITION BY recording_id) AS b,
 count(*) OVER (PARTITION BY recording_id) AS n FROM v_epochs) SELECT recording_id, epoch_index, sleep_stage, CASE WHEN a IS NOT NULL THEN n END AS recording_epochs_before_trim,
 CASE WHEN a IS NOT NULL THEN least(b + 0, n - 1) - greatest(a - 0, 0) + 1 END AS recording_epochs_after_trim, CASE WHEN a IS NOT NULL THEN 0 END AS wake_trim_minutes FROM w WHERE a IS NULL OR epoch_index BETWEEN greatest(a - 0, 0) AND least(b + 0, n - 1)""")
def f8(spark, sf):
    e = views.epochs(spark, sf).select("recording_id", "epoch_index", "sleep_stage")
    return filters.wake_trim(e, "recording_id", ["epoch_index"], minutes=0)


@add("f9_task_rows", f"WITH {ARRAYS} SELECT vec_id, apnea_binary FROM v_arrays WHERE apnea_binary IS NOT NULL")
def f9(spark, sf):
    a = views.arrays(spark, sf).withColumn("mask", F.col("apnea_binary").isNotNull().cast("int"))
    return filters.task_rows(a, "mask").select("vec_id", "apnea_binary")


@add("f10_sequence_metadata", f"""SELECT event_id, user_id, CASE WHEN event_id % 9 = 2 THEN 'N2' ELSE 'REM' END AS sleep_stage FROM events WHERE event_id % 9 IN (2, 5, 6) AND event_id % 13 <> 0""")
def f10(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", raw_stage().alias("sleep_stage"), F.when(F.col("event_id") % 13 != 0, "a.edf").alias("source_file"))
    return filters.sequence_metadata(e, "sleep_stage", "user_id", "user_id", "event_id", labels=["N2", "REM"]).select("event_id", "user_id", "sleep_stage")


@add("j1_flag_by_key", f"WITH {EPOCHS} SELECT recording_id, epoch_index, CASE WHEN EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.recording_id AND x.event_id % 50 = e.epoch_index) THEN 1 ELSE 0 END AS flag FROM v_epochs e")
def j1(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("recording_id"), (F.col("event_id") % 50).alias("epoch_index"))
    return joins.flag_by_key(views.epochs(spark, sf).select("recording_id", "epoch_index"), ev, ["recording_id", "epoch_index"])


@add("j2_flag_by_window_key", f"""WITH {EPOCHS}, {INTERVALS} SELECT recording_id, epoch_index, CASE WHEN EXISTS (SELECT 1 FROM v_intervals x WHERE x.event_type = 'click' AND x.recording_id = e.recording_id AND floor(x.start_sec / 30) = e.epoch_index) THEN 1 ELSE 0 END AS flag FROM v_epochs e""")
def j2(spark, sf):
    e = views.epochs(spark, sf).select("recording_id", "epoch_index", (F.col("epoch_index") * 30.0).alias("epoch_start_sec"), (F.col("epoch_index") * 30.0 + 30).alias("epoch_end_sec"))
    iv = views.intervals(spark, sf).filter("event_type = 'click'")
    s = F.floor(F.col("start_sec") / 30) * 30.0
    keys = iv.select("recording_id", s.alias("epoch_start_sec"), (s + 30).alias("epoch_end_sec"))
    return joins.flag_by_key(e, keys, ["recording_id", "epoch_start_sec", "epoch_end_sec"]).select("recording_id", "epoch_index", "flag")


@add("j3_flag_by_overlap", f"""WITH {EPOCHS}, {INTERVALS} SELECT recording_id, epoch_index, CASE WHEN EXISTS (SELECT 1 FROM v_intervals x WHERE x.recording_id = e.recording_id AND x.event_type = 'error' AND x.start_sec < e.epoch_index * 30 + 30 AND x.end_sec > e.epoch_index * 30) THEN 1 ELSE 0 END AS flag FROM v_epochs e""")
def j3(spark, sf):
    e = views.epochs(spark, sf).select("recording_id", "epoch_index", (F.col("epoch_index") * 30.0).alias("s"), (F.col("epoch_index") * 30.0 + 30).alias("e"))
    iv = views.intervals(spark, sf).filter("event_type = 'error'")
    return joins.flag_by_overlap(e, iv, "recording_id", "s", "e", "start_sec", "end_sec").select("recording_id", "epoch_index", "flag")


@add("j5_assign_fold", f"WITH {EPOCHS} SELECT event_id, recording_id, CAST(recording_id % 5 AS INTEGER) AS fold FROM v_epochs")
def j5(spark, sf):
    e = views.staged(spark, sf).select("event_id", "recording_id")
    folds = e.select("recording_id").distinct().withColumn("fold", (F.col("recording_id") % 5).cast("int"))
    return joins.assign_fold(e, folds, "recording_id")


@add("j9_union_corpora", f"WITH {EPOCHS}, {ARRAYS} SELECT recording_id, epoch_index, sleep_stage, CAST(NULL AS INTEGER) AS apnea_binary FROM v_epochs UNION ALL SELECT recording_id, epoch_index, NULL, apnea_binary FROM v_arrays")
def j9(spark, sf):
    return joins.union_corpora(views.epochs(spark, sf).select("recording_id", "epoch_index", "sleep_stage"), views.arrays(spark, sf).select("recording_id", "epoch_index", "apnea_binary"))


@add("j10_before_after_compare", f"""WITH {DIRTY}, a AS (SELECT lower(c_mktsegment) AS label, count(*) AS raw_count FROM customer GROUP BY 1), b AS (SELECT lower(trim(segment)) AS label, count(*) AS prep_count FROM v_dirty GROUP BY 1)
 SELECT coalesce(a.label, b.label) AS label, coalesce(raw_count, 0) AS raw_count, coalesce(prep_count, 0) AS prep_count, (SELECT count(*) FROM customer) AS raw_rows, 5 AS raw_cols, (SELECT count(*) FROM v_dirty) AS prep_rows, 6 AS prep_cols, TRUE AS balance_changed FROM a FULL JOIN b ON a.label = b.label""")
def j10(spark, sf):
    raw = table(spark, sf, "customer").withColumn("c_mktsegment", F.lower("c_mktsegment"))
    prep = views.dirty(spark, sf).withColumn("segment", text.normalize_category(F.col("segment")))
    return joins.before_after_compare(raw, prep, "c_mktsegment", "segment")


@add("t1_expand_intervals", f"""WITH {ANNOTATIONS}, x AS (SELECT recording_id, onset, label, unnest(range(CAST(floor(duration / 30) AS BIGINT))) AS i FROM v_annotations WHERE label <> 'REM'),
 y AS (SELECT *, onset + i * 30 AS s FROM x), z AS (SELECT * FROM y WHERE round_even((s + 30) * 0.7, 0) <= 14000)
 SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY onset, i) - 1 AS epoch_index, CAST(round_even(s * 0.7, 0) AS BIGINT) AS epoch_start_sample, CAST(round_even((s + 30) * 0.7, 0) AS BIGINT) AS epoch_end_sample, s AS epoch_start_sec, s + 30 AS epoch_end_sec, label AS sleep_stage FROM z""")
def t1(spark, sf):
    a = views.annotations(spark, sf)
    label = F.when(F.col("label") != "REM", F.col("label"))
    return timeseries.expand_intervals(a, "recording_id", ["onset"], label=label, fs=F.lit(0.7), signal_len=F.lit(14000))


def sampled(spark, sf):
    return views.epochs(spark, sf).select("recording_id", "epoch_index", (F.col("epoch_index") * 97).alias("sample"))


@add("t2_segments_to_next", f"""WITH {EPOCHS} SELECT recording_id, epoch_index, epoch_index * 97 AS epoch_start_sample, coalesce(lead(epoch_index * 97) OVER (PARTITION BY recording_id ORDER BY epoch_index), 100000) AS epoch_end_sample,
 epoch_index * 97 / 2.0::DOUBLE AS epoch_start_sec, coalesce(lead(epoch_index * 97) OVER (PARTITION BY recording_id ORDER BY epoch_index), 100000) / 2.0::DOUBLE AS epoch_end_sec FROM v_epochs""")
def t2(spark, sf):
    return timeseries.segments_to_next(sampled(spark, sf), "recording_id", ["epoch_index"], "sample", F.lit(100000), F.lit(2.0)).drop("sample")


@add("t3_epochs_ending_at", f"WITH {EPOCHS} SELECT recording_id, epoch_index, greatest(epoch_index * 97 - 30, 0) AS epoch_start_sample, epoch_index * 97 AS epoch_end_sample, CAST(greatest(epoch_index * 97 - 30, 0) AS DOUBLE) AS epoch_start_sec, CAST(epoch_index * 97 AS DOUBLE) AS epoch_end_sec FROM v_epochs")
def t3(spark, sf):
    return timeseries.epochs_ending_at(sampled(spark, sf), "sample", F.lit(1.0)).drop("sample")


@add("t4_align_to_grid", f"""WITH {EPOCHS} SELECT recording_id, epoch_index, epoch_index * 97 AS event_center_sample, (epoch_index * 97 // 30) * 30 AS epoch_start_sample, least((epoch_index * 97 // 30) * 30 + 30, 5000) AS epoch_end_sample,
 CAST((epoch_index * 97 // 30) * 30 AS DOUBLE) AS epoch_start_sec, CAST(least((epoch_index * 97 // 30) * 30 + 30, 5000) AS DOUBLE) AS epoch_end_sec, (epoch_index * 97 // 30) * 30 >= 5000 AS skipped FROM v_epochs""")
def t4(spark, sf):
    return timeseries.align_to_grid(sampled(spark, sf), "sample", F.lit(1.0), F.lit(5000).cast("bigint")).drop("sample")


def long_samples(spark, sf):
    a = views.arrays(spark, sf)
    return a.select("recording_id", (F.col("vec_id") % 2).alias("channel"), (F.floor(F.col("epoch_index") / 2) * 64).alias("base"), F.posexplode("signal").alias("i", "value")).select(
        "recording_id", "channel", (F.col("base") + F.col("i")).alias("sample_idx"), "value")


@add("t5_slice_channel_stats", f"""WITH {ARRAYS}, u AS (SELECT recording_id, vec_id % 2 AS channel, epoch_index // 2 * 64 + generate_subscripts(signal, 1) - 1 AS idx, unnest(signal) AS value FROM v_arrays),
 e AS (SELECT recording_id, k AS epoch_index, k * 50 AS a, least(k * 50 + 50, 700) AS b FROM (SELECT DISTINCT recording_id FROM v_arrays) t, range(15) g(k))
 SELECT e.recording_id, e.epoch_index, e.a AS epoch_start_sample, e.b AS epoch_end_sample, round(avg(value) FILTER (WHERE channel = 0), 6) + 0.0 AS eeg_mean, round(stddev_pop(CAST(value AS DOUBLE)) FILTER (WHERE channel = 0), 6) AS eeg_std,
 round(avg(value) FILTER (WHERE channel = 1), 6) + 0.0 AS eog_mean, round(stddev_pop(CAST(value AS DOUBLE)) FILTER (WHERE channel = 1), 6) AS eog_std FROM e LEFT JOIN u ON u.recording_id = e.recording_id AND idx >= a AND idx < b GROUP BY 1, 2, 3, 4""")
def t5(spark, sf):
    e = views.arrays(spark, sf).select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(14).cast("bigint"))).alias("epoch_index")).select(
        "recording_id", "epoch_index", (F.col("epoch_index") * 50).alias("epoch_start_sample"), F.least(F.col("epoch_index") * 50 + 50, F.lit(700)).alias("epoch_end_sample"))
    out = timeseries.slice_channel_stats(long_samples(spark, sf), e, {"0": "eeg", "1": "eog"}, ["recording_id"], width=50)
    return out.withColumns({c: r(c) for c in ("eeg_mean", "eeg_std", "eog_mean", "eog_std")})


def rounded(xs, digits=5):
    return F.transform(xs, lambda x: F.round(x.cast("double"), digits) + F.lit(0.0))


@add("t6_extract_epoch_array", f"""WITH {ARRAYS}, p AS (SELECT vec_id, signal[vec_id % 5 * 8 + 1 : least(vec_id % 5 * 8 + 40, vec_id % 5 * 8 + 48)] AS part FROM v_arrays)
 SELECT vec_id, list_transform(list_concat(part, list_transform(range(40 - len(part)), lambda j: part[-1])), lambda x: round(CAST(x AS DOUBLE), 5) + 0.0) AS epoch FROM p""")
def t6(spark, sf):
    start = F.col("vec_id") % 5 * 0.125
    return views.arrays(spark, sf).select("vec_id", rounded(arrays.cut_epoch(F.col("signal"), F.lit(64.0), start, start + 0.75, 40)).alias("epoch"))


@add("t7_normalize_epoch_array", f"""WITH {ARRAYS}, p AS (SELECT vec_id, CAST(signal AS DOUBLE[]) AS x FROM v_arrays), m AS (SELECT *, list_avg(x) AS mu, list_stddev_pop(x) AS sd FROM p)
 SELECT vec_id, list_transform(x, lambda v: round(CASE WHEN sd > 0.000001 THEN (v - mu) / sd ELSE v - mu END, 5) + 0.0) AS z FROM m""")
def t7(spark, sf):
    return views.arrays(spark, sf).select("vec_id", rounded(arrays.normalize(F.col("signal").cast("array<double>"))).alias("z"))


_CTX = ", ".join(f"coalesce({fn}(eeg_value, {k}) OVER w, {edge}(eeg_value IGNORE NULLS) OVER f) AS eeg_value_{fn}{k}" for fn, edge in (("lag", "first_value"), ("lead", "last_value")) for k in (1, 2))


@add("t8_temporal_context", f"""WITH {EPOCHS}, n AS (SELECT recording_id, epoch_index, CASE WHEN event_id % 6 <> 0 THEN eeg_value END AS eeg_value FROM v_epochs) SELECT *, {_CTX} FROM n
 WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_index), f AS (PARTITION BY recording_id ORDER BY epoch_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def t8(spark, sf):
    e = views.epochs(spark, sf).select("recording_id", "epoch_index", F.when(F.col("event_id") % 6 != 0, F.col("eeg_value")).alias("eeg_value"))
    return timeseries.temporal_context(e, "recording_id", "epoch_index", ["eeg_value"])


_WIN = ", ".join(f"base + least(greatest(epoch_index + ({d}), 0), n - 1)" for d in range(-2, 3))


@add("t9_sequence_index", f"""WITH {EPOCHS}, g AS (SELECT recording_id, epoch_index, row_number() OVER (ORDER BY recording_id, epoch_index) - 1 AS row_index, count(*) OVER (PARTITION BY recording_id) AS n FROM v_epochs),
 b AS (SELECT *, row_index - epoch_index AS base FROM g) SELECT recording_id, epoch_index, row_index, [{_WIN}] AS "window" FROM b""")
def t9(spark, sf):
    return timeseries.sequence_index(views.epochs(spark, sf).select("recording_id", "epoch_index"), "recording_id", ["epoch_index"], 5)


@add("t10_resample_signal", f"""WITH {ARRAYS}, u AS (SELECT vec_id, generate_subscripts(signal, 1) - 1 AS i, CAST(unnest(signal) AS DOUBLE) AS v FROM v_arrays),
 x AS (SELECT vec_id, f, sum(v * cos(2 * pi() * f * i / 64)) AS re, -sum(v * sin(2 * pi() * f * i / 64)) AS im FROM u, range(33) g(f) GROUP BY 1, 2),
 y AS (SELECT vec_id, m, sum(CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * f * m / 100) - im * sin(2 * pi() * f * m / 100))) / 64 AS v FROM x, range(100) h(m) GROUP BY 1, 2)
 SELECT vec_id, list(round(v, 6) + 0.0 ORDER BY m) AS signal FROM y GROUP BY vec_id""")
def t10(spark, sf):
    return views.arrays(spark, sf).select("vec_id", rounded(arrays.resample(F.col("signal"), 64.0, 100.0, "double"), 6).alias("signal"))


@add("t11_recording_batches", f"WITH {EPOCHS} SELECT recording_id, epoch_index, epoch_index // 16 AS batch_id, epoch_index % 16 AS slot, epoch_index // 16 AS batch_order FROM v_epochs")
def t11(spark, sf):
    return timeseries.recording_batches(views.epochs(spark, sf).select("recording_id", "epoch_index"), "recording_id", ["epoch_index"], 16, shuffle=False)


@add("t11_batch_count", "SELECT CAST(sum(n // 16) AS BIGINT) AS n_batches FROM (SELECT count(*) AS n FROM events GROUP BY user_id) t")
def t11b(spark, sf):
    return timeseries.batch_count(views.staged(spark, sf), "recording_id", 16, drop_last=True)


@add("t11_recording_batches_shuffled", "SELECT user_id AS recording_id, count(*) // 16 AS batches, count(*) // 16 * 16 AS n_rows, count(*) // 16 AS full_batches FROM events GROUP BY user_id")
def t11c(spark, sf):
    b = timeseries.recording_batches(views.staged(spark, sf).select("recording_id", "event_id"), "recording_id", ["event_id"], 16, drop_last=True)
    sizes = b.groupBy("recording_id", "batch_id").agg(F.count("*").alias("k"))
    return sizes.groupBy("recording_id").agg(F.count("*").alias("batches"), F.sum("k").alias("n_rows"), F.count_if(F.col("k") == 16).alias("full_batches"))


@add("t12_augment_epochs")
def t12(spark, sf):
    a = arrays.augment(F.col("signal"), F.col("vec_id"), noise_std=0.05, scale=(0.8, 1.2), mask_fraction=0.1, mask_count=2, band_fraction=0.1, band_prob=0.5)
    return views.arrays(spark, sf).select("vec_id", a.alias("signal"))


@add("t12_augment_checks", "SELECT vec_id, len(embedding) AS n, true AS spans_are_zero, true AS rest_is_scaled FROM embeddings")
def t12b(spark, sf):
    """Length, zeroed spans and scale of what augmentation without noise returns."""
    a = views.arrays(spark, sf).withColumn("out", arrays.augment(F.col("signal"), F.col("vec_id"), scale=(0.8, 1.2), mask_fraction=0.1, mask_count=2))
    zeros, width = F.size(F.filter("out", lambda x: x == 0)), F.bround(F.size("signal") * 0.1)
    kept = F.filter(F.zip_with("out", "signal", lambda y, x: F.when((x != 0) & (y != 0), y / x)), lambda r: r.isNotNull())
    spread = F.array_max(kept) - F.array_min(kept)
    scaled = (F.array_min(kept) >= 0.8 - 1e-6) & (F.array_max(kept) <= 1.2 + 1e-6) & (spread < 1e-4)
    return a.select("vec_id", F.size("out").cast("bigint").alias("n"), zeros.between(width, 2 * width).alias("spans_are_zero"), scaled.alias("rest_is_scaled"))
