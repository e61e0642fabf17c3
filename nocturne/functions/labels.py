"""Label maps and binary/ordinal codes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.text import snake_case

# The five sleep stages.
STAGES = ("W", "N1", "N2", "N3", "REM")

# Spellings of the five sleep stages.
STAGE_NAMES = {
    "w": "W",
    "wake": "W",
    "sleep_stage_w": "W",
    "1": "N1",
    "n1": "N1",
    "sleep_stage_1": "N1",
    "2": "N2",
    "n2": "N2",
    "sleep_stage_2": "N2",
    "3": "N3",
    "4": "N3",
    "n3": "N3",
    "sleep_stage_3": "N3",
    "sleep_stage_4": "N3",
    "r": "REM",
    "rem": "REM",
    "sleep_stage_r": "REM",
}
# Integer stage codes.
STAGE_CODES = {0: "W", 1: "N1", 2: "N2", 3: "N3", 4: "N3", 5: "REM"}
# Texts read as yes and no.
YES = ("1", "true", "t", "yes", "y", "si", "sí")
NO = ("0", "false", "f", "no", "n")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_stage_label(col: Column) -> Column:
    """One of the five stage names where the spelling is known; other values unchanged."""
    text = col.cast("string")
    return F.coalesce(_lookup(STAGE_NAMES, snake_case(text)), text)


def stage_from_code(col: Column) -> Column:
    """Integer stage code to name, null outside 0..5."""
    number = col.cast("string").try_cast("double")
    return F.when(number == F.floor(number), _lookup(STAGE_CODES, number.cast("int")))


def map_stage_codes(label: Column, dataset: Column, coded_dataset: str) -> Column:
    """Decode integer stages on the rows of one dataset and leave the others."""
    return F.when(dataset == coded_dataset, F.coalesce(stage_from_code(label), label)).otherwise(label)


def encode_binary(col: Column) -> Column:
    """yes/no-like value to 1.0/0.0; null stays null; anything else fails the query. Only numeric columns are read as numbers."""
    text = F.lower(F.trim(col.cast("string")))
    numeric = F.typeof(col).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    number = F.when(numeric, text.try_cast("double"))
    return (
        F.when(col.isNull(), F.lit(None).cast("double"))
        .when(text.isin(*YES) | (number == 1.0), 1.0)
        .when(text.isin(*NO) | (number == 0.0), 0.0)
        .otherwise(F.raise_error(F.concat(F.lit("not a binary value: "), text)).cast("double"))
    )


def ordinal_code(col: Column, order: list[str], unknown: str = "null") -> Column:
    """Position in the declared order; unknown values become null or fail the query."""
    if not order:
        raise ValueError("the declared order is empty")
    names = [str(x).strip().lower() for x in order]
    code = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.trim(col.cast("string")))), F.lit(0)) - 1
    if unknown == "raise":
        code = F.when(col.isNotNull() & code.isNull(), F.raise_error(F.lit("value outside the declared order"))).otherwise(code)
    return code.cast("double")
