"""String parsing: names, categories, paths, clock times, annotation tokens."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event codes and stage tokens of the annotation format.
EVENT_CODES = ("H", "HA", "OA", "X", "CA", "CAA", "L", "LA", "A", "MT")
STAGE_TOKENS = ("W", "R", "1", "2", "3", "4")

# How clock times, file names, ids, store names and event lines are written.
SEGMENT_STAGE = r"(?i)Stagen(\d+)"
SEGMENT_SUBJECT = r"(?i)^(S\d+_p\d+(?:_\d+)?)"
RECORDING_SUBJECT = r"(?i)^([A-Z]{2}\d{4})"
UNSAFE_IN_STORE = r"[^A-Za-z0-9_.-]+"
EVENT_LINE = r"^\d{2}:\d{2}:\d{2}\s+"
CLOCK = r"^\s*(\d{2}):(\d{2}):(\d{2})\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def snake_case(col: Column) -> Column:
    """Lower-case with every run of other characters turned into one underscore."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_category(col: Column) -> Column:
    """Trimmed, single-spaced, lower-case; null stays null."""
    return F.lower(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")))


def parse_number(col: Column) -> Column:
    """Text to double, null for anything that is not a plain decimal number."""
    return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))


def parse_hms(col: Column) -> Column:
    """``HH:MM:SS`` to whole seconds, else null."""
    part = [F.regexp_extract(col, CLOCK, i).try_cast("bigint") for i in (1, 2, 3)]
    return F.when(col.rlike(CLOCK), part[0] * 3600 + part[1] * 60 + part[2])


def _slashed(path: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(clean, r"(^|/)(\./)+", "$1")


def path_stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.regexp_extract(_slashed(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def subject_from_path(path: Column) -> Column:
    """Parent folders joined by ``/``; the file stem for a path without folders."""
    clean = _slashed(path)
    return F.when(clean.contains("/"), F.regexp_extract(clean, r"^(.*)/[^/]*$", 1)).otherwise(path_stem(path))


def segment_event_group(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.contains("plm"), "plm")
        .when(low.contains("rem"), "rem")
        .when(low.contains("non_event"), "non_event")
        .otherwise("unknown")
    )


def segment_stage(path: Column) -> Column:
    return F.regexp_extract(path, SEGMENT_STAGE, 1).try_cast("int")


def segment_subject(path: Column) -> Column:
    stem = path_stem(path)
    found = F.regexp_extract(stem, SEGMENT_SUBJECT, 1)
    return F.when(found != "", found).otherwise(stem)


def subject_from_recording(col: Column) -> Column:
    """Two letters and four digits at the start, else the name without its last two characters."""
    found = F.regexp_extract(col, RECORDING_SUBJECT, 1)
    cut = F.substring(col, F.lit(1), F.length(col) - 2)
    return F.when(found != "", found).when(F.length(col) > 2, cut).otherwise(col)


def annotation_tokens(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda t: t != "")


def annotation_stage(col: Column) -> Column:
    return F.coalesce(F.get(annotation_tokens(col), F.lit(0)), F.lit("unknown"))


def annotation_events(col: Column) -> Column:
    """Known event codes after the first token, in order, repeats kept."""
    rest = F.slice(annotation_tokens(col), F.lit(2), F.greatest(F.size(annotation_tokens(col)) - 1, F.lit(0)))
    return F.filter(rest, lambda t: t.isin(*EVENT_CODES))


def store_relpath(dataset: Column, recording: Column) -> Column:
    safe = F.regexp_replace(F.trim(recording), UNSAFE_IN_STORE, "_")
    return F.concat_ws("/", dataset, safe)


def event_line(line: Column) -> Column:
    """Struct (start_sec, end_sec, event_type) of one event-list line; null when the line is not an event."""
    parts = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    start = parse_hms(F.get(parts, F.lit(0)))
    length = F.floor(F.abs(parse_number(F.get(parts, F.lit(2)))))
    signed = F.when(parse_number(F.get(parts, F.lit(2))) < 0, -length).otherwise(length)
    ok = line.rlike(EVENT_LINE) & (F.size(parts) >= 3) & start.isNotNull() & signed.isNotNull()
    return F.when(
        ok,
        F.struct(
            start.cast("double").alias("start_sec"),
            (start + signed).cast("double").alias("end_sec"),
            F.get(parts, F.lit(1)).alias("event_type"),
        ),
    )
