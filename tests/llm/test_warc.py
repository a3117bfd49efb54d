from __future__ import annotations

import gzip
import io

from pyspark.sql import functions as F

from gleaner.llm import warc
from gleaner.llm.common import shared_folder

BIG = "<p>" + "é" * 700 + "</p>"
PAGES = [
    (1, "http://a/", BIG), (5, "http://b/\r\nX: y", BIG), (3, None, BIG), (5, "http://b/", BIG), (None, "http://n/", BIG),
    (6, "http://c/", "small"), (7, "http://c/", "small"), (8, "u", None), (9, "u", ""), (10, "u", "x" * 999), (11, "u", "x" * 999),
    (12, "u", "x" * 1000), (13, "u", "x" * 1000), (14, "u", "WARC/1.1\r\n\r\n" * 5000), (None, None, "y" * 2000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("x")).withColumn("n", F.lit(1))


def expected(rows=PAGES):
    import hashlib

    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html] = max(i, largest.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = largest.get(html) if len(data) >= 1000 and largest.get(html) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_at_any_split(spark):
    archives = warc.write(warc.plan(pages(spark)).repartition(2), shared_folder(spark, "t"))
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES)
    for split in (7, 64, 500, 1 << 20):
        got = warc.read(spark, archives, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to) for r in got), key=repr) == expected()
        assert all(r.payload.decode() == (dict((p[0], p[2]) for p in PAGES)[r.page_id] or "") for r in got if r.warc_type == "response" and r.page_id)


def test_empty_table(spark):
    archives = warc.write(warc.plan(pages(spark, [])), shared_folder(spark, "t"))
    assert warc.read(spark, archives).collect() == []


def records(data, start, end):
    return [(o, warc.parse(c)[0].get("x-page-id")) for o, c in warc.split_records(io.BytesIO(data), start, end)]


def test_each_record_belongs_to_the_split_of_its_start():
    members = [warc.record(i, "u", bytes([i]) * i * 50, "d", 0, None) for i in range(12)]
    data = b"".join(members)
    offsets = [sum(map(len, members[:i])) for i in range(12)]
    for cut in range(0, len(data), 37):
        both = records(data, 0, cut) + records(data, cut, len(data))
        assert both == [(o, str(i)) for i, o in enumerate(offsets)]


def test_damage_and_decoys_are_passed_over():
    decoy = gzip.compress(b"not a record") + warc._MAGIC + b"garbage"
    broken = warc.record(1, "u", b"lost" * 2000, "d", 0, None)[:-30]
    data = warc.record(0, "u", b"a", "d", 0, None) + decoy + broken + warc.record(2, "u", b"b", "d", 0, None)
    assert [i for _, i in records(data, 0, len(data))] == ["0", "2"]
