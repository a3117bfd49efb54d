"""Versioned tables, stateful streams, ordered replay and the case registry."""

from __future__ import annotations

import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as parquet
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner import plans
from gleaner.operators import cases
from gleaner.operators.keyed import number_rows
from gleaner.sources import versions, writers
from gleaner.streaming import ingest, state

START = datetime(2026, 1, 1)


def put(spark, rows, schema, folder, number):
    """One JSON file per micro-batch, later than the files before."""
    target = f"{folder}/{number}.json"
    os.makedirs(folder, exist_ok=True)
    lines = spark.createDataFrame(rows, schema).toJSON().collect()
    with open(target, "w", encoding="utf-8") as out:
        out.write("\n".join(lines))
    stamp = time.time() - 1000 + 10 * number
    os.utime(target, (stamp, stamp))


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    parts = [spark.range(k * 100, k * 100 + 100).withColumn("who", F.lit(k)) for k in range(6)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda df: versions.write(df, path), parts))
    assert versions.read(spark, path).select("id").distinct().count() == 600
    assert len(versions.live(versions.commits(spark, path))) == 6
    versions.compact(spark, path, ["id"])
    assert len(versions.live(versions.commits(spark, path))) == 1
    assert versions.latest(spark, path, ["id"]).count() == 600
    assert len(versions.vacuum(spark, path)) == 6 and versions.latest(spark, path, ["id"]).count() == 600


def test_versions_order_tokens_and_unfinished_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    assert versions.read(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, path, ["k"])
    versions.write(make(("a", 3)), path, at=30)
    versions.write(make(("a", 1), ("b", 1)), path, at=10)  # committed later, but written before
    make(("a", 9)).write.parquet(f"{path}/data/unfinished")
    got = lambda: {r.k: r.v for r in versions.latest(spark, path, ["k"]).collect()}
    assert got() == {"a": 3, "b": 1}
    versions.write(make(("c", 1)), path, token="s#0", at=40)
    versions.write(make(("c", 2), ("d", 2)), path, token="s#0", at=40 + 1)
    assert got() == {"a": 3, "b": 1, "c": 2, "d": 2} and versions.done(spark, path, "s#0") and not versions.done(spark, path, "s#1")
    before = versions.commits(spark, path)
    versions.compact(spark, path, ["k"])
    versions.write(make(("b", 0)), path, at=5)  # older than what was compacted
    versions.write(make(("b", 7)), path, at=50)
    assert got() == {"a": 3, "b": 7, "c": 2, "d": 2} and len(versions.commits(spark, path)) == len(before) + 3
    assert versions.compact(spark, path, ["k"]) and versions.compact(spark, path, ["k"]) is None


CASE = "case_digest string, auto_reason string, at timestamp"


def test_inbox_stream_keeps_every_case_once_with_bounded_state(spark, tmp_path):
    rng, folder, want = random.Random(1), str(tmp_path / "in"), set()
    for batch in range(6):
        rows = [(f"c{rng.randint(0, 30)}", rng.choice("rs"), START + timedelta(hours=10 * batch, minutes=rng.randint(0, 50))) for _ in range(80)]
        want |= {r[:2] for r in rows}
        put(spark, rows, CASE, folder, batch)
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "state")
    writers.append_auto_cases(spark.createDataFrame([("c1", "r", START)], CASE), inbox, "seed")
    run = state.inbox_stream(stream(spark, CASE, folder), inbox, checkpoint)
    run.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(kept) <= 62 and min(kept[2:]) < 30  # about a batch of cases, and gone when the watermark passes them
    rows = versions.read(spark, inbox).select("case_digest", "auto_reason").collect()
    assert sorted(map(tuple, rows)) == sorted(want | {("c1", "r")})
    state.inbox_stream(stream(spark, CASE, folder), inbox, str(tmp_path / "again")).awaitTermination()
    assert versions.read(spark, inbox).count() == len(want | {("c1", "r")})


def test_cache_hits_and_expires_in_event_time(spark, tmp_path):
    at = lambda hours, minutes=0: START + timedelta(hours=hours, minutes=minutes)
    write = lambda url, t, fp: (url, t, "write", None, fp, fp.upper())
    look = lambda url, t, name: (url, t, "lookup", name, None, None)
    batches = [
        [write("u", at(0), "a"), look("u", at(1), "hit"), look("v", at(1), "miss")],
        [look("u", at(24), "edge"), look("u", at(24, 1), "expired"), look("u", at(0, 30), "late")],  # the late one is behind the watermark
        [write("u", at(30, 30), "c"), look("u", at(30, 20), "before"), write("u", at(30, 10), "b"), look("u", at(30, 40), "last")],
        [look("w", at(90), "open")],
    ]
    folder = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        put(spark, rows, state.CACHE_EVENT, folder, k)
    found = state.cached_lookups(stream(spark, state.CACHE_EVENT, folder), ttl_hours=24, delay="1 minute", salts=3)
    writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    run = state.with_rocksdb(spark, lambda: writer.start(str(tmp_path / "out")))
    run.awaitTermination()
    rows = spark.read.schema(state.LOOKUP).parquet(str(tmp_path / "out")).collect()
    got = {r.request_id: (r.hit, r.fingerprint, r.summary) for r in rows}
    assert len(rows) == len(got)
    assert got == {
        "hit": (True, "a", "A"), "miss": (False, None, None), "edge": (True, "a", "A"), "expired": (False, None, None),
        "before": (True, "b", "B"), "last": (True, "c", "C"),
    }
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_cache_state_does_not_grow_with_urls(spark, tmp_path):
    rng, folder, events = random.Random(3), str(tmp_path / "in"), []
    for batch in range(5):
        rows = []
        for k in range(400):
            at = START + timedelta(hours=10 * batch, milliseconds=rng.randint(-1_800_000, 36_000_000 - 1))
            url, kind = rng.choice([None, *(f"u{rng.randint(0, 40)}" for _ in range(9))]), rng.choice(["write", "lookup", "lookup", None])
            name = f"{batch}-{k}"
            rows.append((url, at, kind, *((None, name, name.upper()) if kind == "write" else (name, None, None))))
        events += rows
        put(spark, rows, state.CACHE_EVENT, folder, batch)
    found = state.cached_lookups(stream(spark, state.CACHE_EVENT, folder), ttl_hours=12, delay="1 hour", salts=2, groups=3)
    writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    run = state.with_rocksdb(spark, lambda: writer.start(str(tmp_path / "out")))
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 6
    end, want = max(e[1] for e in events) - timedelta(hours=1), {}
    for url, at, kind, name, *_ in events:
        if kind == "lookup" and at < end:
            before = [e for e in events if e[2] == "write" and e[0] == url and url is not None and e[1] <= at]
            last = max(before, key=lambda e: e[1], default=None)
            want[name] = (url, at, True, *last[4:], last[1]) if last and at - last[1] <= timedelta(hours=12) else (url, at, False, None, None, None)
    rows = spark.read.schema(state.LOOKUP).parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(want) and {r.request_id: (r.url_key, r.at, r.hit, r.fingerprint, r.summary, r.written_at) for r in rows} == want
    assert any(w[2] for w in want.values()) and not all(w[2] for w in want.values())


def test_cached_lookups_of_rows_with_nulls_equal_sql(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    rows = [
        (1, at(0), 7, "signup"), (2, at(1), 7, "view"), (3, at(1), None, "purchase"), (4, at(2), None, "click"), (5, at(2), 7, None),
        (6, None, 7, "purchase"), (7, None, 7, "view"), (8, at(30), 7, "error"), (9, at(40), 8, "signup"), (10, at(39.5), 8, "view"), (11, at(41), 8, None),
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").select("*", F.lit(0.0).alias("value"), F.lit("").alias("props"))
    parquet.write_table(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toArrow(), str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(plans.oracle_sql()["cached_lookups"]).fetchall()
    assert sorted(map(tuple, plans.queries()["cached_lookups"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 4


def test_cache_events_have_canonical_keys(spark):
    writes = spark.createDataFrame([("https://E.com/x?utm_source=y", START, "f", "s")], "source_url string, at timestamp, fingerprint string, summary string")
    requests = spark.createDataFrame([("r", "https://e.com/x", START)], "request_id string, source_url string, at timestamp")
    rows = state.cache_events(writes, requests).collect()
    assert len({r.url_key for r in rows}) == 1 and {r.kind for r in rows} == {"write", "lookup"}


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []
    payloads = spark.createDataFrame([(k * 7 % 50, f"p{k * 7 % 50}") for k in range(50)], "name long, payload string")

    def job(df):
        names = [r.name for r in df.orderBy("seq").collect()]
        seen.append(names)
        if len(seen) == 3:
            raise RuntimeError("stop")
        return df

    with pytest.raises(RuntimeError):
        ingest.replay_in_order(payloads, job, path, ["name"], limit=35, per_batch=10)
    assert ingest.replay_in_order(payloads, job, path, ["name"], limit=35, per_batch=10) == 2
    assert seen == [list(range(10)), list(range(10, 20)), list(range(20, 30)), list(range(20, 30)), list(range(30, 35))]
    rows = versions.read(spark, path).orderBy("_at", "seq").collect()
    assert [(r.name, r.seq, r._at) for r in rows] == [(k, k, k // 10) for k in range(35)]
    assert ingest.replay_in_order(payloads, job, path, ["name"], limit=35, per_batch=10) == 0
    assert ingest.replay_in_order(payloads.limit(0), job, str(tmp_path / "none"), ["name"]) == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit(1).alias("hot")).repartition(7)
    rows = number_rows(df, ["hot", "x"]).collect()
    assert sorted((r.seq, r.x) for r in rows) == [(k, k) for k in range(1000)]


REGISTERED = "ord bigint, id string, source_kind string, source_url string, raw_text string, platform_hint string, provenance string, labels array<string>, auto_reason string"


def test_registry_merges_in_any_order_without_texts(spark):
    rng = random.Random(4)
    rows = [
        (k, f"i{k}", "url", f"https://e.com/{rng.randint(0, 5)}", rng.choice(["", "long text " * 50]), None, rng.choice(["manual", "auto"]),
         rng.sample("abcde", rng.randint(0, 3)), rng.choice(["", "r", "s"]))
        for k in range(60)
    ]
    df = spark.createDataFrame(rows, REGISTERED)
    whole = sorted(map(str, cases.merge_cases(df).collect()))
    parts = [cases.case_registry(df.where(f"ord % 3 = {k}")) for k in range(3)]
    assert sorted(map(str, cases.registry_cases(cases.merge_registries(parts[2], cases.merge_registries(parts[1], parts[0]), parts[0])).collect())) == whole
    plan = cases.merge_cases(df)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "Aggregate" in line]
    assert below and not any("raw_text" in line for line in below)


def test_two_keys_with_one_digest_are_an_error(spark):
    df = spark.createDataFrame([(1, "i", "url", "https://e.com", "", None, "auto", ["x"], "")], REGISTERED)
    other = cases.case_registry(df).withColumn("check", F.col("check") + 1)
    with pytest.raises(PySparkException, match="share the digest"):
        cases.merge_registries(cases.case_registry(df), other).collect()
