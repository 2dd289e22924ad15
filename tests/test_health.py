"""The health payload stops on observations of another run."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import health
from sessionlake.sources.files import table_fingerprint

EVENTS = "session_id long, event_id long, event_type string, start_ms long, end_ms long, anchor_ms long, quantity long, evidence_grade string, evidence string, attributes string"


def test_wrong_provenance_raises(spark):
    seen = spark.createDataFrame([(1, 10, 5), (1, 20, 6), (2, 10, 7)], "session_id long, t_ms long, v long")
    evidence = '[{"source": "bar", "details": {"previous_percent": 80.5, "current_percent": 60}}]'
    events = spark.createDataFrame([(1, 1, "health_decreased", 10, 20, 10, 1, "A", evidence, '{"attribution": {"item": "x"}}'), (2, 2, "health_decreased", 10, 20, 10, 1, "A", None, "not json")], EVENTS)
    recorded = table_fingerprint(seen, ["session_id"])
    rows = {r.event_id: (r.previous_percent, r.current_percent, r.attribution, r.evidence_rows) for r in health.health_payload(events, seen, recorded).collect()}
    assert rows == {1: (80.5, 60.0, "x", 1), 2: (None, None, None, 0)}
    other = seen.withColumn("v", F.when(F.col("t_ms") == 20, 9).otherwise(F.col("v")))
    with pytest.raises(Exception, match="does not match the selected health run"):
        health.health_payload(events, other, recorded).collect()
    with pytest.raises(Exception, match="recorded nothing"):
        health.health_payload(events, seen, recorded.filter("session_id = 1")).collect()
