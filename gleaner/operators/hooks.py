"""Extension points: a summary engine, a note renderer and supplied text tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas

BatchFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def summarize_with(df: DataFrame, engine: BatchFunction, key: str = "doc_id") -> DataFrame:
    """Run a summary engine over Arrow batches: (key, s) with ``s`` the raw summary.

    Filter rows before calling this; Spark does not move filters past Python code.
    The result goes through ``normalize_summary``.
    """
    kind = df.schema[key].dataType.simpleString()
    flat = df.mapInPandas(engine, f"{key} {kind}, {schemas.SUMMARY}")
    names = [c for c in flat.columns if c != key]
    return flat.select(key, F.struct(*names).alias("s"))


def render_with(materials: DataFrame, renderer: BatchFunction, key: str = "doc_id") -> DataFrame:
    """Run a note renderer over Arrow batches: (key, body, error)."""
    kind = materials.schema[key].dataType.simpleString()
    return materials.mapInPandas(renderer, f"{key} {kind}, body STRING, error STRING")


def attach_tracks(requests: DataFrame, tracks: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Join supplied payloads (key, track, payload), one column per track name.

    Tracks of a key are few and named up front, so the pivot is one aggregation.
    """
    wide = tracks.groupBy(key).pivot("track", list(names)).agg(F.max("payload"))
    return requests.join(wide, key, "left")
