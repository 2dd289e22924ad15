"""Health payload: nested evidence read from JSON, guarded by the fingerprint of the observations it was made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.sources.files import table_fingerprint

# fixed values: shape of the evidence of a health event
EVIDENCE = "array<struct<source: string, details: struct<previous_percent: double, current_percent: double>>>"


def json_value(text: Column, path: str, kind: str) -> Column:
    """A value inside a JSON text of any shape; null where the text is no JSON, the path leads nowhere, or the value is of another type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def guarded(rows: DataFrame, observations: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, if the observations of their keys are those of the recorded fingerprint (keys, rows, fingerprint); else the job that reads them fails."""
    keys = list(keys)
    actual = table_fingerprint(observations, keys).select(*keys, F.col("fingerprint").alias("_actual"))
    d = rows.join(actual, keys, "left").join(recorded.select(*keys, F.col("fingerprint").alias("_recorded")), keys, "left")
    said = F.concat(F.lit("attribution does not match the selected health run: recorded "), F.coalesce("_recorded", F.lit("nothing")), F.lit(", found "), F.coalesce("_actual", F.lit("nothing")))
    fine = F.coalesce(F.col("_actual") == F.col("_recorded"), F.lit(False))
    # the error stands in a column that is kept, so that no plan prunes it
    return d.withColumn("provenance", F.when(fine, F.col("_actual")).otherwise(F.raise_error(said))).drop("_actual", "_recorded")


def health_payload(events: DataFrame, observations: DataFrame, recorded: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Events of the payload: percentages before and after from the first evidence, attribution from the attributes, guarded by provenance.

    ``events``: ``event_id, event_type, start_ms, end_ms, anchor_ms, quantity, evidence_grade, evidence`` (JSON of ``EVIDENCE``) ``, attributes`` (JSON of any shape).
    """
    d = guarded(events, observations, recorded, [key]).withColumn("_e", F.from_json("evidence", EVIDENCE))
    details = F.get(F.col("_e"), F.lit(0))["details"]
    return d.select(key, "event_id", "event_type", "start_ms", "end_ms", F.col("anchor_ms").alias("media_time_ms"), "quantity", "evidence_grade", details["previous_percent"].alias("previous_percent"),
                    details["current_percent"].alias("current_percent"), json_value(F.col("attributes"), "$.attribution.item", "string").alias("attribution"), F.coalesce(F.size("_e"), F.lit(0)).alias("evidence_rows"), "provenance")
