"""Text sources: one-segment CSV files, stage lists, event lists, file pairing."""
from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions import arrays, text
from nocturne.functions.text import parse_number
from nocturne.operators.ordered import running
from nocturne.session import keep

# Channel preference and sampling rate of the segment corpus.
SEGMENT_CHANNELS = ("C4-M1", "C3-M2", "F4-M1", "F3-M2", "O2-M1", "O1-M2", "E1-M2", "E2-M1")
SEGMENT_FS = 200.0


FILES_A_TASK = 2_000  # Spark counts a file as 4 MB at least and so gives a task a few files only


def _whole_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(file_path, value): one row per file, also per file of zero bytes, which Spark lists but doesn't read.

    The folder is listed once, each file is read once, by tasks of some thousand files, and a listed name that wasn't read is an empty file.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    raw = reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    # The listing lies on the driver. Its names come as one text: a call for each of them is slow. They are encoded, so none holds a line feed.
    names = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", raw._jdf.inputFiles()).split()
    raw = raw.coalesce(max(4 * spark.sparkContext.defaultParallelism, math.ceil(len(names) / FILES_A_TASK)))
    listed = spark.createDataFrame(pd.DataFrame({"_listed": names}, dtype=str), "_listed string")
    same = lambda c: F.regexp_replace(c, ":/+", ":/").alias("_name")  # noqa: E731  # the two write an empty host differently
    both = listed.select(same("_listed"), "_listed").join(raw.select(same("file_path"), "file_path", "value"), "_name", "left")
    return both.select(F.coalesce("file_path", "_listed").alias("file_path"), F.coalesce("value", F.lit("")).alias("value"))


def _lines(content):
    return F.filter(F.split(content, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")


def _cells(line):
    return F.transform(F.split(line, ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))


def segment_files(spark: SparkSession, root: str, preferred=SEGMENT_CHANNELS, pattern: str = "*.csv") -> DataFrame:
    """Every CSV file below ``root`` with its path parts, chosen channel and samples.

    One file is one short segment by format, so a file is one row.  ``usable``
    is false for empty files, names without a stage and files without numbers.
    """
    raw = _whole_files(spark, root, pattern)
    base = re.escape(re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/")) + "/")
    path = F.regexp_replace(F.col("file_path"), f"^.*?{base}", "")
    rows = raw.select(path.alias("source_file"), _lines(F.col("value")).alias("lines"))
    rows = rows.select("source_file", _cells(F.get("lines", F.lit(0))).alias("header"),
                       F.transform(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), _cells).alias("rows"))
    liked = F.array_compact(F.transform(F.array(*map(F.lit, preferred)), lambda c: F.nullif(F.array_position("header", c), F.lit(0))))
    numbered = F.filter(F.sequence(F.lit(1), F.greatest(F.size("header"), F.lit(1))),
                        lambda j: F.exists("rows", lambda r: parse_number(F.get(r, j.cast("int") - 1)).isNotNull()))
    rows = rows.withColumn("_at", F.coalesce(F.get(liked, F.lit(0)), F.get(numbered, F.lit(0)).cast("bigint")).cast("int"))
    rows = rows.withColumn("signal", F.transform("rows", lambda r: parse_number(F.get(r, F.col("_at") - 1))))
    source = F.col("source_file")
    stage = text.segment_stage(source)
    return rows.select(
        "source_file", text.segment_subject(source).alias("subject_unit_id"), text.segment_event_group(source).alias("event_group"),
        stage.alias("sleep_stage"), text.snake_case(F.get("header", F.col("_at") - 1)).alias("eeg_channel"), "signal",
        F.coalesce(stage.isNotNull() & F.col("_at").isNotNull() & (F.size(arrays.finite(F.col("signal"))) > 0), F.lit(False)).alias("usable"),
    )


def scan_segment_files(spark: SparkSession, root: str, *, fs: float = SEGMENT_FS, max_files: int | None = None, preferred=SEGMENT_CHANNELS, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Usable segments in path order up to ``max_files``, and the used and skipped file counts."""
    files = keep(segment_files(spark, root, preferred, pattern))  # read for the counts and the rows
    hit = F.col("usable").cast("bigint")
    if max_files is not None:
        files = running(files, [], ["source_file"], sums={"_used": hit}).filter(F.col("_used") - hit < max_files).drop("_used")
    report = files.agg(F.count_if("usable").alias("n_files_used"), F.count_if(~F.col("usable")).alias("n_files_skipped"))
    if not report.first()["n_files_used"]:
        raise ValueError(f"no usable segment file under {root}")
    used = files.filter("usable").drop("usable").withColumns({
        "sfreq_hz": F.lit(float(fs)), "epoch_duration_sec": F.size("signal") / F.lit(float(fs)),
    })
    return used, report


def _recording(suffix: str, by_folder: str | None):
    """Recording name from the file name, or from a ``key=value`` folder."""
    path = F.col("file_path")
    if by_folder:
        return F.regexp_extract(path, f"/{by_folder}=([^/]*)/", 1)
    return F.regexp_replace(text.path_stem(path), suffix, "")


def scan_stage_text(spark: SparkSession, path: str, by_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(recording_id, epoch_index, stage) of stage lists; a file with any bad line is skipped and counted."""
    raw = _whole_files(spark, path)
    values = F.transform(_lines(F.col("value")), lambda x: F.trim(x).try_cast("int"))
    files = raw.select(_recording("_stage$", by_folder).alias("recording_id"), values.alias("stages"))
    good = (F.size("stages") > 0) & ~F.exists("stages", lambda x: x.isNull())
    report = files.agg(F.count_if(good).alias("n_files_used"), F.count_if(~good).alias("n_files_skipped"))
    out = files.filter(good).select("recording_id", F.posexplode("stages").alias("epoch_index", "stage"))
    return out.withColumn("epoch_index", F.col("epoch_index").cast("bigint")), report


def parse_event_text(spark: SparkSession, path: str, by_folder: str | None = None) -> DataFrame:
    """(recording_id, start_sec, end_sec, event_type) of event lists, one line at a time."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_path"), "value").select(_recording("_respevt$", by_folder).alias("recording_id"), text.event_line(F.col("value")).alias("e"))
    return raw.filter("e is not null").select("recording_id", "e.*")


def pair_files(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """(folder, recording, label_file): the first label name starting with the recording name minus its last character.

    Label names are reduced to one per (folder, prefix) before the join; only the
    prefix lengths that occur are made.
    """
    n = F.length("recording")
    keyed = signals.withColumn("_key", F.when(n > 1, F.substring(F.col("recording"), F.lit(1), n - 1)).otherwise(F.col("recording")))
    lengths = [r[0] for r in keyed.select(F.length("_key")).distinct().collect()]
    cuts = F.transform(F.array(*map(F.lit, lengths or [0])), lambda k: F.when(F.length("label_file") >= k, F.substring(F.col("label_file"), F.lit(1), k)))
    first = labels.withColumn("_key", F.explode(F.array_compact(cuts))).groupBy("folder", "_key").agg(F.min("label_file").alias("label_file"))
    return keyed.join(first, ["folder", "_key"]).select("folder", "recording", "label_file")


def recording_stage_summary(df: DataFrame, recording: str = "recording_id", stage: str = "stage") -> DataFrame:
    """Epoch count, mode (smallest on ties), median and the share of each stage 0..5 per recording.

    Stages are counted per (recording, stage) first; mode, median and shares come from those few rows.
    """
    counts = df.groupBy(recording, F.col(stage).alias("s")).agg(F.count("*").alias("k"))
    n = F.sum("k")
    share = [(F.coalesce(F.sum(F.when(F.col("s") == i, F.col("k"))), F.lit(0)) / n).alias(f"stage_{i}_frac") for i in range(6)]
    return counts.groupBy(recording).agg(
        n.alias("n_epochs"), F.min_by("s", F.struct(-F.col("k"), "s")).alias("stage_mode"),
        F.percentile(F.col("s").cast("double"), 0.5, F.col("k")).alias("stage_median"), *share,
    )
