"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds; exact halves go to the even neighbour."""
    return F.bround(seconds * 1000).cast("long")


def frame_ms(frame: Column, fps: Column | float) -> Column:
    return F.bround(frame / (fps if isinstance(fps, Column) else F.lit(float(fps))) * 1000).cast("long")


def truth(text: Column, words: Sequence[str] = ("1", "true", "yes")) -> Column:
    """Whether a text cell spells a true value; NULL is false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*words), F.lit(False))


def optional_int(text: Column) -> Column:
    """Whole number in a text cell; blanks and the usual spellings of nothing become NULL."""
    cell = F.lower(F.trim(text.cast("string")))
    number = F.when(~cell.isin("", "none", "null", "nan"), cell).try_cast("double")
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long")


def clock_label(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds.cast("long") % 60)


def clock_text(seconds: Column) -> Column:
    """``mm:ss``, or ``hh:mm:ss`` from one hour on."""
    s = seconds.cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest))


def clock_seconds(text: Column) -> Column:
    """Struct ``(seconds, reason)``: the parsed clock, or why it could not be parsed."""
    t = F.trim(text)
    part = lambda i: F.split(t, ":").getItem(i).try_cast("long")
    two, three = t.rlike("^[0-9]+:[0-9]+$"), t.rlike("^[0-9]+:[0-9]+:[0-9]+$")
    reason = (
        F.when(t.isNull() | (t == ""), "missing_ocr")
        .when(two & (part(1) >= 60), "seconds_out_of_range")
        .when(three & ((part(1) >= 60) | (part(2) >= 60)), "clock_component_out_of_range")
        .when(two | three, F.lit(None).cast("string"))
        .when(~t.rlike("^[0-9:]+$"), "invalid_characters")
        .otherwise("invalid_clock_format")
    )
    value = F.when(two, part(0) * 60 + part(1)).when(three, part(0) * 3600 + part(1) * 60 + part(2))
    return F.struct(F.when(reason.isNull(), value).alias("seconds"), reason.alias("reason"))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """Stable identifier from the parts of a record's identity."""
    joined = F.concat_ws("\x1f", *[part.cast("string") for part in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def safe_rate(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval; 0 when nothing was observed."""
    n = total.cast("double")
    p = successes / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(total > 0, (centre - margin) / (1 + z * z / n)).otherwise(F.lit(0.0))


def lower_median(sorted_values: Column) -> Column:
    return F.element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) / 2) + 1).cast("int"))


def upper_median(sorted_values: Column) -> Column:
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) / 2) + 1).cast("int"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def token_count(text: Column, token: str) -> Column:
    """How often a token occurs in a ``|``-separated cell."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\|"), lambda part: part == token))


def first_max_name(names: Sequence[str], values: Sequence[Column]) -> Column:
    """Name of the largest value; the first one wins a tie."""
    stacked = F.array(*values)
    return F.element_at(F.array(*[F.lit(name) for name in names]), F.array_position(stacked, F.array_max(stacked)).cast("int"))


def interval_bounds(text: Column) -> Column:
    """Struct ``(start_s, end_s, duration_s)`` of an ``m:ss-m:ss`` label; hyphen, en dash and em dash all count."""
    halves = F.split(F.trim(text), "[-–—]", 2)

    def seconds(part: Column) -> Column:
        pieces = F.split(F.trim(part), ":")
        numbers = F.transform(pieces, lambda p: p.try_cast("double"))
        total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc * 60 + x)
        return F.when(F.size(pieces).between(1, 3), total)

    start, end = seconds(halves.getItem(0)), seconds(F.get(halves, F.lit(1)))
    known = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(known, start).alias("start_s"), F.when(known, end).alias("end_s"),
                    F.when(known, end - start).alias("duration_s"))


def mean_median(values: Column) -> Column:
    """Median of an array; the two middle values are averaged."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, (lower_median(ordered) + upper_median(ordered)) / 2)
