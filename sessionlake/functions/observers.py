"""Plug-in detectors: a function from feature batches to observation rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sessionlake.schemas import OBSERVATION_SCHEMA

Observer = Callable[[pd.DataFrame], pd.DataFrame]
OBSERVERS: dict[str, Observer] = {}


def register_observer(name: str, observer: Observer) -> None:
    if name in OBSERVERS:
        raise ValueError(f"observer {name} is registered twice")
    OBSERVERS[name] = observer


def observe(features: DataFrame, name: str) -> DataFrame:
    """Apply a registered detector to a feature table, one Arrow batch at a time; columns it leaves out are NULL."""
    observer = OBSERVERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = observer(batch).reindex(columns=OBSERVATION_SCHEMA.names).astype(object)
            yield rows.where(rows.notna(), None)

    return features.mapInPandas(run, OBSERVATION_SCHEMA)
