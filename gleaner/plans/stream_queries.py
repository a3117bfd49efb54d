"""Queries of versioned tables, stateful streams and ordered replay, over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators.keyed import number_rows
from gleaner.plans import base
from gleaner.plans.registry import query
from gleaner.session import run_folder
from gleaner.sources import versions, writers
from gleaner.streaming import ingest, state


def event_stream(spark, sf_dir):
    schema = base.read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(
    "inbox_stream",
    """SELECT DISTINCT sha1('url|https://e.com/' || user_id || '|') AS case_digest, event_type AS auto_reason FROM events
       WHERE (user_id, event_type) NOT IN (SELECT doc_id, CASE quality WHEN 1 THEN 'click' ELSE 'view' END FROM labels)""",
)
def inbox_stream(spark, sf_dir):
    """Cases of an event stream beside an inbox that already holds those of the labelled users; the stream is replayed once more."""
    folder = run_folder(spark, "inbox")
    digest = lambda user: F.sha1(F.concat(F.lit("url|https://e.com/"), user, F.lit("|")))
    labels = base.read_table(spark, sf_dir, "labels", "doc_id", "quality")
    reason = F.when(F.col("quality") == 1, "click").otherwise("view")
    seed = labels.select(digest(F.col("doc_id")).alias("case_digest"), reason.alias("auto_reason"), F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("seeded"))
    writers.append_auto_cases(seed, f"{folder}/inbox", "seed")
    for run in range(2):
        events = event_stream(spark, sf_dir).select(digest(F.col("user_id")).alias("case_digest"), F.col("event_type").alias("auto_reason"), F.col("ts").alias("at"), F.lit(False).alias("seeded"))
        state.inbox_stream(events, f"{folder}/inbox", f"{folder}/state-{run}").awaitTermination()
    found = writers.read_inbox(spark, f"{folder}/inbox", key="case_digest")
    return found.where("NOT seeded").select("case_digest", "auto_reason")


@query(
    "cached_lookups",
    """WITH w AS (SELECT user_id, ts, event_id FROM events WHERE event_type IN ('signup', 'purchase')),
        l AS (SELECT user_id, ts, event_id FROM events WHERE event_type NOT IN ('signup', 'purchase') AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
        j AS (SELECT l.event_id, l.ts - w.ts <= INTERVAL 24 HOUR AS fresh, w.event_id AS entry FROM l ASOF LEFT JOIN w ON l.user_id = w.user_id AND l.ts >= w.ts)
        SELECT event_id, coalesce(fresh, false) AS hit, CASE WHEN fresh THEN entry END AS entry FROM j""",
)
def cached_lookups(spark, sf_dir):
    """Each lookup of an event stream with the cache entry of its user that was valid at its time (24 hours)."""
    folder = run_folder(spark, "cache")
    ev = event_stream(spark, sf_dir)
    write = F.col("event_type").isin("signup", "purchase")
    events = ev.select(
        F.col("user_id").cast("string").alias("url_key"), F.col("ts").alias("at"), F.when(write, "write").when(~write, "lookup").alias("kind"),
        F.when(~write, F.col("event_id").cast("string")).alias("request_id"), F.when(write, F.col("event_id").cast("string")).alias("fingerprint"),
        F.lit(None).cast("string").alias("summary"),
    )
    found = state.cached_lookups(events, ttl_hours=24, delay="1 hour", salts=2)
    writer = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    state.with_rocksdb(spark, lambda: writer.start(f"{folder}/out")).awaitTermination()
    return spark.read.schema(state.LOOKUP).parquet(f"{folder}/out").select(
        F.col("request_id").cast("long").alias("event_id"), "hit", F.col("fingerprint").cast("long").alias("entry")
    )


@query(
    "versioned_upsert",
    """WITH v AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS version FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, ts DESC, event_id DESC) AS n FROM v)
        SELECT user_id AS job_id, event_type AS status, value FROM r WHERE n = 1""",
)
def versioned_upsert(spark, sf_dir):
    """Job records from five writers into one table: one writes twice, the first three are compacted, the rest comes after."""
    path = f"{run_folder(spark, 'upsert')}/jobs"
    ev = base.read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "value",
        F.struct(F.col("ts"), F.col("event_id")).alias("updated_at"),
    )
    for at, kind in enumerate(("click", "view", "error", "signup", "purchase"), 1):
        writers.write_jobs(ev.where(F.col("status") == kind), path, version=f"writer-{kind}", at=at)
        if kind == "view":
            writers.write_jobs(ev.where(F.col("status") == kind), path, version="writer-view", at=at)
        if kind == "error":
            versions.compact(spark, path, ["job_id"])
            versions.vacuum(spark, path)
    return writers.read_latest(spark, path, ["job_id"]).select("job_id", "status", "value")


@query(
    "ordered_replay",
    """SELECT event_id, seq, seq // 300 AS batch FROM (
        SELECT event_id, row_number() OVER (ORDER BY event_type, value DESC, event_id) - 1 AS seq FROM events) WHERE seq < 1000""",
)
def ordered_replay(spark, sf_dir):
    """The first thousand payloads in order, in batches of 300; stopped after two batches and resumed."""
    path = f"{run_folder(spark, 'replay')}/out"
    ev = base.read_table(spark, sf_dir, "events").select("event_id", "event_type", (-F.col("value")).alias("rank"))
    order = ["event_type", "rank", "event_id"]
    job = lambda df: df.select("event_id", "seq")
    ingest.replay_in_order(ev, job, path, order, limit=600, per_batch=300)
    ingest.replay_in_order(ev, job, path, order, limit=1000, per_batch=300)
    return versions.read(spark, path).select("event_id", "seq", F.col("_at").alias("batch"))


@query("numbered_rows", "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS seq FROM events")
def numbered_rows(spark, sf_dir):
    """The place of every event in a total order."""
    ev = base.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return number_rows(ev, ["user_id", "ts", "event_id"]).select("event_id", "seq")
