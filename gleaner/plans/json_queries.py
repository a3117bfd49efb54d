"""Queries over JSON that Spark builds from the given tables: nested harvest, split arrays, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import validation
from gleaner.plans import base
from gleaner.plans.registry import query
from gleaner.session import run_folder
from gleaner.sources import json_files


@query(
    "harvest_nested",
    """SELECT event_id, 'https://e.com/u/' || user_id || '?q="' || event_type || '"' AS source_url, 'url' AS source_kind FROM events
       UNION ALL SELECT event_id, 'https://e.com/deep/' || event_id, CASE WHEN value > 20 THEN 'video_url' END FROM events
       UNION ALL SELECT event_id, 'https://e.com/outer', NULL FROM events WHERE event_type = 'error'""",
)
def harvest_nested(spark, sf_dir):
    """URLs of objects at several depths, with escapes, braces in strings, and fields of other types."""
    ev = base.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    text = F.concat(
        F.lit('{"note": "a } b { \\" c", "runs": [1, [{"payload": {"source_url": "https:\\/\\/e.com\\/u\\/'), "user_id", F.lit('?q=\\"'), "event_type",
        F.lit('\\"", "source_kind": " url ", "meta": {"empty": {}, "again": [[{"source_url": "https://e.com/deep/'), "event_id", F.lit('", "source_kind": '),
        F.when(F.col("value") > 20, F.lit('"video_url"')).otherwise(F.lit("7")), F.lit('}]]}}}]], "source_url": '),
        F.when(F.col("event_type") == "error", F.lit('"https://e.com/outer"')).when(F.col("event_type") == "view", F.lit('"  "')).otherwise(F.lit("null")), F.lit("}"),
    )
    return json_files.harvest(ev.select("event_id", text.alias("value")), "value", ["event_id"])


@query(
    "json_array_split",
    "SELECT doc_id, lang, length(text) AS chars, sha1(text) AS sha, n_chars FROM documents",
)
def json_array_split(spark, sf_dir):
    """Documents written as files of one JSON array each and read back object by object, whatever the texts hold."""
    folder = f"{run_folder(spark, 'arrays')}/arrays"
    docs = base.documents(spark, sf_dir, "doc_id", "text", "lang", "n_chars")
    packed = docs.select(F.to_json(F.struct("doc_id", "text", F.struct("lang", F.array("n_chars", F.lit(0)).alias("list")).alias("nested"))).alias("value"), F.spark_partition_id().alias("file"))
    lines = F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n "), F.lit("]"))
    shards = packed.groupBy("file", F.pmod(F.xxhash64("value"), F.lit(8)).alias("part")).agg(lines.alias("value"))
    shards.write.partitionBy("file", "part").text(folder)
    schema = "doc_id BIGINT, text STRING, nested STRUCT<lang: STRING, list: ARRAY<BIGINT>>"
    rows = json_files.read_objects(spark, f"{folder}/*/*/*", schema)
    return rows.select("doc_id", "nested.lang", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("sha"), F.col("nested.list")[0].alias("n_chars"))


def payloads(spark, sf_dir):
    """Documents as JSON documents with all kinds of faults, by language and source."""
    docs = base.documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    text = lambda c: F.to_json(F.struct(c.alias("x")))
    first = F.substring_index(F.col("text"), "\n", 1)
    quoted = F.expr("substring(j, 6, length(j) - 6)")
    docs = docs.withColumn("j", text(first)).withColumn("line", F.coalesce(quoted, F.lit('""')))
    title = F.when(F.col("lang") == "de", F.lit("")).when(F.col("lang") == "fr", F.lit('"title": "  ", ')).when(
        F.col("lang") == "es", F.concat(F.lit('"title": '), F.col("n_chars").cast("string"), F.lit(", "))).otherwise(F.lit('"title": "T", '))
    odd = F.substring("source", 4, 9).cast("int") % 2 == 1
    sections = F.when(odd, F.concat(
        F.lit('[{"heading": "H", "level": 2, "content": '), "line", F.lit('}, 5, {"heading": "", "level": "2", "content": "x"}, {"heading": 3, "content": ["y"]}]')))
    sections = sections.otherwise(F.lit('"none"'))
    body = F.concat(
        F.lit("{"), title, F.lit('"summary": "S", "sections": '), sections, F.lit(', "images": [{"src": " i ", "alt": null}, {"alt": "a"}], "videos": [{"src": "v", "duration_seconds": '),
        F.when(odd, F.lit("1.5")).otherwise(F.lit('"1.5"')), F.lit(', "frame_summaries": ["a", " ", 2]}], "tables": [{"headers": {}, "rows": [["1", 2], "r"]}]}'),
    )
    broken = F.when(F.col("lang") == "en", F.when(F.col("n_chars") < 500, F.lit("[1]")).when(F.col("n_chars") < 800, F.lit("{broken")))
    return docs.select("doc_id", F.coalesce(broken, body).alias("payload"))


_PAYLOADS = """p AS (SELECT doc_id, lang, n_chars, CAST(substr(source, 4) AS INT) % 2 = 1 AS odd, trim(split_part(coalesce(text, ''), chr(10), 1), ' ' || chr(9) || chr(13)) <> '' AS filled,
        lang = 'en' AND n_chars < 800 AS broken, lang IN ('de', 'fr') AS untitled FROM documents),
      o AS (SELECT * FROM p WHERE NOT broken)"""


@query(
    "validated_documents",
    f"""WITH {_PAYLOADS} SELECT doc_id, broken OR untitled AS rejected,
        CASE WHEN broken OR untitled THEN NULL ELSE CASE WHEN lang = 'es' THEN CAST(n_chars AS VARCHAR) ELSE 'T' END END AS title,
        CASE WHEN NOT (broken OR untitled) THEN CASE WHEN odd THEN 1 + filled::BIGINT ELSE 0 END END AS n_sections,
        CASE WHEN NOT (broken OR untitled) THEN 'i' END AS images, CASE WHEN NOT (broken OR untitled) AND odd THEN 1.5 END AS duration,
        CASE WHEN NOT (broken OR untitled) THEN 'a,2' END AS frames, CASE WHEN NOT (broken OR untitled) THEN '1,2' END AS cells,
        CASE WHEN broken THEN 1 ELSE untitled::BIGINT + CASE WHEN odd THEN 3 + (NOT filled)::BIGINT ELSE 2 END + 2 END AS n_errors FROM p""",
)
def validated_documents(spark, sf_dir):
    """The accepted fields of every document, and how many errors it has."""
    d = validation.check(payloads(spark, sf_dir), "payload")
    doc = F.col("document")
    return d.select(
        "doc_id", "rejected", doc["title"].alias("title"), F.when(doc.isNotNull(), F.size(doc["sections"]).cast("long")).alias("n_sections"),
        F.array_join(F.transform(doc["images"], lambda i: i["src"]), ",").alias("images"), doc["videos"][0]["duration_seconds"].alias("duration"),
        F.array_join(doc["videos"][0]["frame_summaries"], ",").alias("frames"), F.array_join(doc["tables"][0]["rows"][0], ",").alias("cells"),
        F.size("errors").cast("long").alias("n_errors"),
    )


@query(
    "document_errors",
    f"""WITH {_PAYLOADS}, e AS (
        SELECT '$' AS path, 'not_object' AS code FROM p WHERE broken
        UNION ALL SELECT '$.title', 'missing' FROM o WHERE untitled
        UNION ALL SELECT '$.sections', 'wrong_type' FROM o WHERE NOT odd
        UNION ALL SELECT '$.sections[]', 'not_object' FROM o WHERE odd
        UNION ALL SELECT '$.sections[].content', 'missing' FROM o WHERE odd AND NOT filled
        UNION ALL SELECT '$.sections[].level', 'wrong_type' FROM o WHERE odd
        UNION ALL SELECT '$.sections[].content', 'wrong_type' FROM o WHERE odd
        UNION ALL SELECT '$.images[].src', 'missing' FROM o
        UNION ALL SELECT '$.videos[].duration_seconds', 'wrong_type' FROM o WHERE NOT odd
        UNION ALL SELECT '$.tables[].headers', 'wrong_type' FROM o)
        SELECT path, code, count(*) AS n FROM e GROUP BY path, code""",
)
def document_errors(spark, sf_dir):
    """The reject table by path and code."""
    return validation.error_counts(validation.check(payloads(spark, sf_dir), "payload"))
