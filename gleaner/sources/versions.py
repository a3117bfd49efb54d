"""Keyed tables of versions with a commit manifest.

A version is a folder of its own, named by a UUID, so writers never share a folder. It counts from
the moment its manifest, again a folder of its own, is written by Spark's commit protocol; data
without a manifest is ignored. Rows carry the time and id of the write that brought them
(``_at``, ``_version``), which order them however often they are compacted. Two writers at once lose
nothing: both commit, and reading merges them by key.

A *token* makes a write repeatable: of several commits with one token only the last counts, so a
micro-batch that is written again after a failure replaces itself.

A compaction commits the merged rows as a version that replaces those it has read; commits that
arrive meanwhile stay beside it. ``vacuum`` deletes what no reader can see any more.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.keyed import distinct_last

MANIFEST = "version STRING, at BIGINT, token STRING, replaces ARRAY<STRING>"
#: Columns that order the rows of a table.
ORDER = ("_at", "_version")


class Commit(NamedTuple):
    version: str
    at: int
    token: str | None
    replaces: list[str]


def _path(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """Manifests in order of commit. There is one per write since the last compaction and vacuum."""
    folder, fs = _path(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(folder):
        return []
    rows = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/commits/*").collect()
    return sorted(Commit(r["version"], r["at"], r["token"], list(r["replaces"] or [])) for r in rows)


def live(found: Sequence[Commit]) -> list[Commit]:
    """Commits that are read: neither replaced by a compaction nor repeated under their token."""
    ordered = sorted(found, key=lambda c: (c.at, c.version))
    last = {c.token: c.version for c in ordered if c.token is not None}
    gone = {v for c in ordered for v in c.replaces}
    return [c for c in ordered if c.version not in gone and (c.token is None or last[c.token] == c.version)]


def _commit(df: DataFrame, path: str, version: str, at: int, token: str | None, replaces: list[str]) -> Commit:
    root = path.rstrip("/")
    df.write.parquet(f"{root}/data/{version}")
    row = df.sparkSession.createDataFrame([(version, at, token, replaces)], MANIFEST)
    row.coalesce(1).write.json(f"{root}/commits/{version}")
    return Commit(version, at, token, replaces)


def write(df: DataFrame, path: str, token: str | None = None, at: int | None = None) -> Commit:
    """Add rows as one version. ``at`` (microseconds) orders it; default: now."""
    version, at = uuid.uuid4().hex, time.time_ns() // 1000 if at is None else at
    stamped = df.withColumns({"_at": F.lit(at).cast("long"), "_version": F.lit(version)})
    return _commit(stamped, path, version, at, token, [])


def done(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a write with this token is committed."""
    return any(c.token == token for c in commits(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all live versions with ``_at`` and ``_version``; None while nothing is committed."""
    root = path.rstrip("/")
    found = live(commits(spark, path))
    if not found:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/data/{c.version}" for c in found])


def latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Current rows: the last write per key, within one write the last by ``order``."""
    df = read(spark, path)
    if df is None:
        raise FileNotFoundError(f"no committed version below {path}")
    at = [F.col(c).alias(f"_by_{c}") for c in order]
    return distinct_last(df.select("*", *at), list(keys), [*ORDER, *[f"_by_{c}" for c in order]]).drop(*ORDER, *[f"_by_{c}" for c in order])


def compact(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> Commit | None:
    """Replace the live versions by one. With ``keys`` only the last row of each key is kept.

    Tokens of the versions are given up, so compact only what no stream will repeat.
    """
    found = live(commits(spark, path))
    df = read(spark, path)
    if len(found) < 2 or df is None:
        return None
    if keys is not None:
        df = distinct_last(df.withColumns({f"_by{c}": F.col(c) for c in ORDER}), list(keys), [f"_by{c}" for c in ORDER]).drop(*[f"_by{c}" for c in ORDER])
    return _commit(df, path, uuid.uuid4().hex, found[-1].at, None, [c.version for c in found])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the data of committed versions that are no longer live. Only without running readers of older states."""
    found = commits(spark, path)
    gone = sorted({c.version for c in found} - {c.version for c in live(found)})
    for version in gone:
        folder, fs = _path(spark, f"{path.rstrip('/')}/data/{version}")
        fs.delete(folder, True)
    return gone
