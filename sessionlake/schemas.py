"""Table schemas of the event, observation and signal layers."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: ordered vocabularies
EVIDENCE_GRADES = ("A", "B", "C", "D", "unresolved")
PUBLICATION_STATUSES = ("auto_accepted", "needs_review", "unresolved")
TEMPORAL_TYPES = ("point", "interval", "state", "counter")

_TEXT, _LONG, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TEXTS = T.MapType(_TEXT, _TEXT)


def _table(**columns: str) -> T.StructType:
    """Fields by type, each a space-separated list of names in table order."""
    kinds = {"text": _TEXT, "long": _LONG, "double": _DOUBLE, "bool": _BOOL, "map": _TEXTS}
    return T.StructType([T.StructField(name, kinds[kind.split("_")[0]]) for kind, names in columns.items() for name in names.split()])


EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("source_artifact", _TEXT), T.StructField("source_record_key", _TEXT), T.StructField("modalities", T.ArrayType(_TEXT)),
    T.StructField("details", _TEXTS)]))

EVENT_SCHEMA = _table(
    text_1="event_id video_asset_id", long_1="session_id", text_2="event_family event_type", long_2="time_lower_ms anchor_time_ms time_upper_ms",
    text_3="temporal_precision evidence_grade publication_status inference_method processing_run_id", long_3="frame_number game_time_ms character_level",
    text_4="item_name item_type action acquisition_source", double_1="quantity quantity_min quantity_max", text_5="unit", map_1="attributes").add("evidence", EVIDENCE)

OBSERVATION_SCHEMA = _table(
    text_1="observation_id video_asset_id detector_name detector_version observation_type", long_1="frame_number media_time_ms",
    text_2="visibility evidence_grade", double_1="value_num", text_3="value_text", bool_1="value_bool", text_4="source_artifact", map_1="attributes")

SIGNAL_SCHEMA = _table(
    text_1="observation_id video_asset_id", long_1="session_id", text_2="observable_code", long_2="time_lower_ms time_upper_ms",
    text_3="temporal_precision visibility evidence_grade", bool_1="observed", text_4="source_artifact source_record_key", double_1="numeric_value",
    text_5="text_value unit", long_3="frame_number", map_1="attributes")
