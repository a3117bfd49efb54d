"""Stateful streams: duplicate suppression with bounded state, and a summary cache with expiry in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions import urls
from gleaner.sources import writers

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_cases(cases: DataFrame, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each (case_digest, auto_reason) once per ``delay``: the state of a case goes when the watermark has passed it."""
    return cases.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["case_digest", "auto_reason"])


def inbox_stream(
    cases: DataFrame, inbox: str, checkpoint: str, time: str = "at", delay: str = "1 hour", files: bool = True
) -> StreamingQuery:
    """Append the automatic cases of a stream to the stored inbox, each (case_digest, auto_reason) once for ever.

    The stream's own state drops repeats within ``delay``; what comes later meets the inbox. A
    micro-batch that is repeated replaces its own version.
    """

    def append(batch: DataFrame, number: int) -> None:
        writers.append_auto_cases(batch, inbox, f"{checkpoint}#{number}")

    started = first_cases(cases, time, delay).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if files else started).start()


#: A cache event: a write of a summary, or a lookup by a request.
CACHE_EVENT = "url_key string, at timestamp, kind string, request_id string, fingerprint string, summary string"
LOOKUP = "url_key string, request_id string, at timestamp, hit boolean, fingerprint string, summary string, written_at timestamp"
_ANSWERED = "url_key string, request_id string, us long, hit boolean, fingerprint string, summary string, written long"
#: What a group keeps, as one Arrow stream: events that wait until no earlier one can come, and per URL the last write before them.
_KEPT = pa.schema([("url_key", pa.string()), ("us", pa.int64()), ("lookup", pa.bool_()), *((c, pa.string()) for c in ("request_id", "fingerprint", "summary"))])


def cache_events(writes: DataFrame, requests: DataFrame) -> DataFrame:
    """Cache writes (source_url, at, fingerprint, summary) and requests (request_id, source_url, at) as one stream; URLs canonical."""
    key = urls.canonical_url(F.col("source_url")).alias("url_key")
    none = F.lit(None).cast("string")
    w = writes.select(key, "at", F.lit("write").alias("kind"), none.alias("request_id"), "fingerprint", "summary")
    r = requests.select(key, "at", F.lit("lookup").alias("kind"), "request_id", none.alias("fingerprint"), none.alias("summary"))
    return w.unionByName(r)


def _answer(ttl: int):
    """The state function of :func:`cached_lookups` over the URLs of one group; ``ttl`` in microseconds."""

    def answer(key, parts, state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        frames = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        if not state.hasTimedOut:
            frames += [part.loc[part["us"] >= now, _KEPT.names] for part in parts]
        events = pd.concat(frames, ignore_index=True)
        events = events.sort_values(["url_key", "us", "lookup", "fingerprint", "summary", "request_id"], na_position="first", ignore_index=True)
        us, lookup, url = events["us"].to_numpy("int64"), events["lookup"].to_numpy("bool"), pd.factorize(events["url_key"])[0]
        last = np.maximum.accumulate(np.where(lookup, -1, np.arange(len(us))))  # the last write so far, of any URL
        hit = (last >= 0) & (url >= 0) & (url[last] == url) & (us - us[last] <= ttl)

        due = np.flatnonzero(lookup & (us < now))
        found, entry = hit[due], events.iloc[last[due]]
        out = events.loc[due, ["url_key", "request_id", "us"]].assign(
            hit=found, **{c: np.where(found, entry[c], None) for c in ("fingerprint", "summary")}, written=entry["us"].to_numpy())

        past = np.flatnonzero(~lookup & (us < now) & (us + ttl >= now))
        past = past[np.append(url[past][1:] != url[past][:-1], True)] if len(past) else past  # the last of each URL
        keep = np.concatenate([past, np.flatnonzero(us >= now)])
        if len(keep):
            state.update((_packed(events.iloc[keep]),))
            wake = np.where(lookup[keep], us[keep], us[keep] + ttl).min() // 1000
            state.setTimeoutTimestamp(max(int(wake), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield out

    return answer


def _packed(events: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KEPT) as writer:
        writer.write_batch(pa.RecordBatch.from_pandas(events, _KEPT, preserve_index=False))
    return sink.getvalue().to_pybytes()


def cached_lookups(
    events: DataFrame, ttl_hours: int = 72, delay: str = "1 hour", salts: int | None = None, groups: int = 1024
) -> DataFrame:
    """Every lookup of a stream of :data:`CACHE_EVENT` with the cache entry that was valid at its own time.

    That is the last write of the URL not after the lookup, if it is at most ``ttl_hours`` (1 at least) old.
    Events may come ``delay`` late, later ones are dropped; a lookup is answered when the watermark has passed it. The clock
    is the events' own, so a replay gives the same answers. An entry leaves the state when it has expired. A lookup
    without URL hits nothing; events without time or kind are neither entries nor answered.

    Lookups of one URL are dealt over ``salts`` (default: the parallelism) and each write is copied
    to all of them, so a hot URL isn't one task's. URLs share a state row with others of their hash, ``groups`` of them
    per salt, so calls of Python don't grow with the URLs; a group must fit a worker. Start the stream with :func:`with_rocksdb`.
    """
    n = salts or events.sparkSession.sparkContext.defaultParallelism
    spread = F.when(F.col("kind") == "write", F.sequence(F.lit(0), F.lit(n - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("request_id"), F.lit(n)).cast("int")))
    dealt = events.withColumns({"salt": F.explode(spread), "at": F.col("at").cast("timestamp")}).withWatermark("at", delay)
    # One condition on the time, so that it isn't pushed below the watermark, which counts all events.
    dealt = dealt.where("CASE WHEN at IS NOT NULL THEN kind = 'lookup' OR kind = 'write' AND url_key IS NOT NULL END").withColumns({
        "group": F.pmod(F.xxhash64("url_key"), F.lit(groups)).cast("int"), "us": F.unix_micros("at"), "lookup": F.col("kind") == "lookup",
    }).drop("kind")
    ttl = max(1, ttl_hours) * 3_600_000_000
    answered = dealt.groupBy("group", "salt").applyInPandasWithState(_answer(ttl), _ANSWERED, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)
    at, written = F.timestamp_micros("us").alias("at"), F.when(F.col("hit"), F.timestamp_micros("written")).alias("written_at")
    return answered.select("url_key", "request_id", at, "hit", "fingerprint", "summary", written)


def with_rocksdb(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state needs the RocksDB store, and restore the session's setting."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
