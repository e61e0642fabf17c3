"""Removal of lines that stand, equal or nearly, earlier in the corpus. DataFrame operations only.

Segment-partition join: two lines within ``threshold`` edits, the shorter cut into threshold + 1 segments, share at least
one segment unchanged.  Every distinct line is indexed under its segments and its length, and probes, for each length it may match,
the few substrings that can be that segment after so many edits before and behind it.  A line's letters, counted modulo
two, must agree but for two letters an edit; pairs that do are verified by edit distance in a band of 2 * threshold + 1
diagonals, all diagonals of a column at once as bits of one number.

Equal lines are one line throughout, so a line that a third of all documents share is one row after the first, partial, aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize, pick

#: Letters and marks whose counts modulo two make a line's signature.
COUNTED = "etaonrishdlucmwfgypbvk,."
#: Near lines by three edits, equal lines at every non-empty length. Only the edit join has a floor.
WHOLE = {"threshold": 3, "min_chars": 32, "exact_chars": 1}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two texts whose lengths differ by at most the threshold; right up to the threshold, larger beyond it.

    Bit d of a column's numbers is the cell on diagonal d of the band. ``plus`` and ``minus`` say where a cell is one more or one less than the
    cell above it; ``same`` is where it equals its upper left neighbour. The distance is counted along the diagonal that ends at the last cell.
    """
    k, width = threshold, 2 * threshold + 1
    mask = F.lit((1 << width) - 1).cast("bigint")
    none = F.lit(0).cast("bigint")
    letters = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit((1 << width) - (1 << k)).cast("bigint").alias("plus"), none.alias("minus"), F.greatest(F.length(a) - F.length(b), F.lit(0)).cast("bigint").alias("cost"))
    diagonal = (F.length(a) - F.length(b) + k).cast("int")

    def equal(p: Column, t: Column, j: Column) -> Column:
        """Bits of the rows of column j (from 0) whose letter is the column's."""
        total = none
        for d in range(width):
            row = j + (d - k)
            total = total + F.when((row >= 0) & F.get(p, row).eqNullSafe(F.get(t, j)), F.lit(1 << d).cast("bigint")).otherwise(none)
        return total

    def column(state: Column, eq: Column) -> Column:
        plus, minus = state["plus"], state["minus"]
        carried = ((eq.bitwiseAND(plus) + plus).bitwiseXOR(plus)).bitwiseOR(eq).bitwiseOR(minus).bitwiseAND(mask)

        def after(same: Column) -> Column:
            right = minus.bitwiseOR(F.bitwise_not(same.bitwiseOR(plus))).bitwiseAND(mask)
            next_same = F.shiftright(same, 1)
            return F.struct(
                same.bitwiseAND(plus).bitwiseOR(F.bitwise_not(next_same.bitwiseOR(right))).bitwiseAND(mask).alias("plus"),
                next_same.bitwiseAND(right).alias("minus"),
                (state["cost"] + 1 - F.call_function("shiftright", same, diagonal).bitwiseAND(F.lit(1).cast("bigint"))).alias("cost"),
            )

        return _let(carried, after)

    columns = _let(F.struct(letters(a).alias("p"), letters(b).alias("t")), lambda s: F.transform(s["t"], lambda _, j: equal(s["p"], s["t"], j)))
    return F.aggregate(columns, start, column, lambda s: s["cost"])


def _keyed(lines: DataFrame, threshold: int, min_chars: int, *, probe: bool) -> DataFrame:
    """The lines with each ``key`` they are indexed under or probe: one row per key, from a table of (less, i, move), so the key is one short expression.

    A key is segment i of a line that is ``less`` shorter, ``move`` places from where it stands there. At most i edits lie before the segment and
    threshold - i behind it, if no earlier segment matches.
    """
    places = [
        (less, i, move)
        for less in range(threshold + 1 if probe else 1) for i in range(threshold + 1)
        for move in (range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1) if probe else [0])
    ]
    table = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("less", "i", "move"), place)]) for place in places])
    rows = lines.withColumn("_p", F.explode(table))
    n, i = (F.col("n") - F.col("_p.less")).cast("int"), F.col("_p.i")
    lo, hi = F.floor(n * i / (threshold + 1)).cast("int"), F.floor(n * (i + 1) / (threshold + 1)).cast("int")
    start, size = lo + F.col("_p.move"), hi - lo
    fits = (n >= min_chars) & (start >= 0) & (start + size <= F.col("n"))
    return rows.filter(fits).withColumn("key", F.xxhash64(n, i, F.substring(F.col("line"), start + 1, size))).drop("_p")


def _signature(line: Column) -> Column:
    bits = F.lit(0).cast("bigint")
    size = F.octet_length(line)
    for i, letter in enumerate(COUNTED):
        odd = (size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))) % 2
        bits = bits.bitwiseOR(F.shiftleft(odd.cast("bigint"), i))
    return bits


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, version, at, line): every line of every document with its place in the corpus; ``version`` is the CRC-32 of the text."""
    plain = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = plain.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    at = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("line_no")
    return rows.select("doc_id", "version", "line_no", at.cast("decimal(38,0)").alias("at"), "line")


def similar_lines(distinct: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(a, b, a_at, b_at, distance): distinct lines (id, at, line, n, sign) within the threshold; a stands before b."""
    left = _keyed(distinct, threshold, min_chars, probe=False).select("id", "sign", "key")
    right = _keyed(distinct, threshold, min_chars, probe=True).select(F.col("id").alias("other"), F.col("sign").alias("other_sign"), "key")
    close = F.bit_count(F.col("sign").bitwiseXOR(F.col("other_sign"))) <= 2 * threshold
    pairs = materialize(left.join(right, "key").filter((F.col("id") != F.col("other")) & close).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    told = materialize(distinct.join(ends, "id").select("id", "at", "line"))
    side = lambda s: told.select(F.col("id").alias(s), F.col("at").alias(f"{s}_at"), F.col("line").alias(f"{s}_line"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.abs(F.length("a_line") - F.length("b_line")) <= threshold)
    measured = both.withColumn("distance", banded_distance(F.col("a_line"), F.col("b_line"), threshold)).filter((F.col("distance") <= threshold) & (F.col("distance") > 0))
    swap = F.col("a_at") > F.col("b_at")
    order = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return measured.select(order("a", "b").alias("a"), order("b", "a").alias("b"), order("a_at", "b_at").alias("a_at"), order("b_at", "a_at").alias("b_at"), "distance")


def line_marks(docs: DataFrame, threshold: int = 1, min_chars: int = 32, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, version, gone, gone_chars, n_links): the numbers (from 0) of the lines that go, their characters, and the links of the document's lines to other lines."""
    lines = line_table(docs).filter(F.length("line") >= (min_chars if exact_chars is None else min(exact_chars, min_chars)))
    sums = lines.groupBy("line").agg(F.min("at").alias("at"), F.count("*").alias("copies"))
    distinct = materialize(sums.select(F.xxhash64("line").alias("id"), "at", "copies", "line", F.length("line").alias("n"), _signature(F.col("line")).alias("sign")))
    links = materialize(similar_lines(distinct.filter(F.col("n") >= min_chars), threshold, min_chars))
    ends = links.select(F.col("b_at").alias("at"), F.lit(True).alias("late")).union(links.select("a_at", F.lit(False)))
    near = ends.groupBy("at").agg(F.max("late").alias("late"), F.count("*").alias("links"))
    check = F.xxhash64(F.lit(1), F.col("line"))
    told = distinct.select("id", check.alias("check"), "at", "copies").join(near, "at", "left").filter("copies > 1 or links is not null")
    told = told.select("id", "check", F.col("at").alias("first_at"), F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links"))
    held = lines.select("doc_id", "version", "line_no", "at", F.length("line").alias("size"), F.xxhash64("line").alias("id"), check.alias("check"))
    found = held.join(told, ["id", "check"])
    goes = F.col("late") | (F.col("at") > F.col("first_at"))
    return found.groupBy("doc_id", "version").agg(F.collect_set(F.when(goes, F.col("line_no"))).alias("gone"), F.sum(F.when(goes, F.col("size"))).alias("gone_chars"), F.sum("links").alias("n_links"))


def dedup_lines(docs: DataFrame, *, threshold: int = 1, min_chars: int = 32, exact_chars: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """(carry columns, doc_id, text, n_lines, n_removed, n_chars_removed, n_links) of every document.

    Lines end at line feeds. A line of ``min_chars`` characters or more goes if it stands, equal or within ``threshold`` edits (characters inserted, deleted
    or replaced), earlier in the corpus: in a document of smaller doc_id or further up in its own. Lines are judged on the
    input, not on what is left. Shorter lines have no near copies; those of ``exact_chars``
    characters or more go where they stand earlier in equal form, others stay (by default all shorter lines). n_links counts, for the document's
    lines, the distinct other lines within the threshold, earlier or later.

    A null text has no lines and stays null; an empty text is one empty line; a row without doc_id is kept whole; rows of one doc_id count as one document;
    an empty table gives an empty table. A document that loses all lines has an empty text.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "text")]
    plain = pick(docs, *carry, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    plain = plain.withColumn("version", F.crc32(F.col("text").cast("binary"))).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    both = plain.join(line_marks(docs, threshold, min_chars, exact_chars), ["doc_id", "version"], "left")
    numbers = F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone")))
    left = _let(F.split("text", "\n"), lambda rows: F.array_join(F.transform(numbers, lambda i: F.get(rows, i)), "\n"))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    text = F.when(removed > 0, left).otherwise(F.col("text"))
    return both.select(*carry, "doc_id", text.alias("text"), F.col("n_lines").cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"), F.coalesce("gone_chars", F.lit(0)).cast("bigint").alias("n_chars_removed"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
