"""Places of pattern matches in whole texts, as array columns, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of the leftmost non-overlapping matches, in code points, end exclusive.

    `before` is the text since the last match. The pattern must not match an empty string. A start is the sum of the lengths
    of all earlier pieces; sums are taken over runs of 256 matches first, so a text with many matches costs little more than its length.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("before"), matches.alias("match"))
    steps = F.transform(pairs, lambda p: F.length(p["before"]) + F.length(p["match"]))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda s, x: s + x)

    def build(pack: Column) -> Column:
        steps_, pairs_ = pack["steps"], pack["pairs"]
        last = F.floor((F.size(steps_) - 1) / F.lit(_RUN)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda j: total(F.slice(steps_, j * _RUN + 1, F.lit(_RUN))))
        offsets = F.transform(F.sequence(F.lit(0), last), lambda j: total(F.slice(sums, F.lit(1), j)))
        return F.flatten(F.transform(F.array(F.struct(steps_.alias("steps"), pairs_.alias("pairs"), offsets.alias("offsets"))), lambda q: F.transform(
            q["pairs"], lambda p, i: _span(p, F.get(q["offsets"], F.floor(i / F.lit(_RUN)).cast("int")) + total(F.slice(q["steps"], i - i % _RUN + 1, i % _RUN)) + F.length(p["before"])))))

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    packed = F.transform(F.array(F.struct(steps.alias("steps"), pairs.alias("pairs"))), build)
    return F.when(text.rlike(pattern), F.flatten(packed)).otherwise(none)


def _span(pair: Column, start: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(pair["match"])).cast("int").alias("end"), pair["match"].alias("match"), pair["before"].alias("before"))


def of_kind(spans: Column, kind: int) -> Column:
    """Sortable array<struct<start, kind, end>>."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))
