"""JSON files that are larger than a task should read, and JSON of any nesting.

``json_objects`` splits one array (or a series of objects) over tasks. Spark's text source cuts a
file into byte ranges and these at every ``}``; whether such a brace lies in a string, and how deep it is,
follows from the quotes and brackets before it, which are prefix sums: within a byte range by a window,
over the ranges by their totals. Neither a file nor an array is ever one value.

``walk`` follows parsed JSON level by level, as many levels as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import run_folder

_PLACE = ["_path", "_range"]


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all fragments of the file before this one."""
    inside = Window.partitionBy(*_PLACE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*_PLACE).agg(F.sum(value).alias("_n"))  # one row per byte range
    starts = totals.select(*_PLACE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.withColumn("_local", local).join(starts, _PLACE).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local")


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def json_objects(spark: SparkSession, path: str | list[str], text: str = "value") -> DataFrame:
    """Columns _path, _ord, ``text``: the objects of a JSON array, or those that stand one behind another, as text.

    ``_ord`` is the place among the file's objects, from 0. Elements that aren't objects are no rows. An
    unclosed object at the end of a file is none.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_text"), F.col("_metadata.file_size").alias("_size"),
    )
    # A file that doesn't end in a brace has a last fragment without one. Readers may leave out three bytes of an order mark.
    files = raw.groupBy("_path").agg((F.sum(F.octet_length("_text") + 1) - F.max("_size")).alias("_over"), F.max(F.struct("_range", "_at")).alias("_last"))
    raw = raw.drop("_size")
    plain = F.regexp_replace("_text", r"(?s)\\.", "")  # escapes; they occur in strings only
    array = (F.col("_range") == 0) & F.startswith(F.ltrim(F.translate("_text", "﻿\n\r\t", "    ")), F.lit("["))
    df = raw.withColumns({"_plain": plain, "_quotes": _count(plain, '"')})
    df = _before(df, "_quotes", "_q")
    starts_in, ends_in = F.col("_q") % 2 == 1, (F.col("_q") + F.col("_quotes")) % 2 == 1
    balanced = F.when(starts_in, F.concat(F.lit('"'), "_plain")).otherwise(F.col("_plain"))
    bare = F.regexp_replace(F.regexp_replace(balanced, '"[^"]*"', ""), '"[^"]*$', "")
    df = df.withColumns({"_bare": bare, "_closed": ~ends_in}).withColumn(
        "_delta", _count(F.col("_bare"), "[{") - _count(F.col("_bare"), "]}") - F.col("_closed").cast("int")).drop("_plain", "_bare")
    df = _before(df, "_delta", "_depth")
    first = Window.partitionBy(*_PLACE).orderBy("_at")
    heads = df.where("_range = 0").withColumn("_row", F.row_number().over(first)).where("_row = 1").select("_path", array.cast("int").alias("_base"))
    df = df.join(heads, "_path")
    df = df.withColumn("_end", (F.col("_closed") & (F.col("_depth") + F.col("_delta") == F.col("_base"))).cast("int"))
    df = _before(df, "_end", "_ord")
    pieces = F.sort_array(F.collect_list(F.struct("_range", "_at", "_text")))
    whole = df.groupBy("_path", "_ord").agg(F.max("_end").alias("_end"), pieces.alias("_pieces")).where("_end = 1")
    final = F.element_at("_pieces", -1)
    whole = whole.join(files, "_path").where(~(F.col("_over").isin(1, -2) & (F.struct(final["_range"], final["_at"]) == F.col("_last"))))
    body = F.concat(F.array_join(F.transform("_pieces", lambda p: p["_text"]), "}"), F.lit("}"))
    return whole.select("_path", "_ord", body.alias("_body")).select("_path", "_ord", F.expr("substring(_body, instr(_body, '{'))").alias(text))


def read_objects(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The objects of JSON files as rows of ``schema``, with ``_path`` and ``_ord``: like ``multiLine``, but split."""
    return json_objects(spark, path, "_json").select("_path", "_ord", F.from_json("_json", schema).alias("_row")).select("_path", "_ord", "_row.*")


def _is(node: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(node)
    found = F.lit(False)
    for k in kinds:
        found = found | F.startswith(kind, F.lit(k))
    return F.coalesce(found, F.lit(False))


def walk(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Every object and array in JSON texts: columns ``keep``, path, node (VARIANT).

    A text that isn't JSON has none. Each level is a table, so the depth is bounded by the data alone.
    """
    spark = df.sparkSession
    folder, depth = run_folder(spark, "walk"), 0
    level = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(value).alias("node"))
    levels = []
    while True:
        level.where(_is(F.col("node"), "OBJECT", "ARRAY")).write.parquet(f"{folder}/{depth}")
        stored = spark.read.parquet(f"{folder}/{depth}")
        levels.append(stored)
        if stored.isEmpty():
            break
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        inner = stored.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level = inner.select(*keep, F.concat("path", step).alias("path"), F.col("value").alias("node"))
        depth += 1
    found = levels[0]
    for more in levels[1:-1]:
        found = found.unionByName(more)
    return found


def text_field(node: Column, name: str) -> Column:
    """A field of an object if it is a string, else null."""
    field = F.try_variant_get(node, f"$.{name}", "variant")
    return F.when(_is(field, "STRING"), F.try_variant_get(node, f"$.{name}", "string"))


def harvest(df: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(source_url, source_kind) of every object, however deep, whose ``source_url`` is a string with more than white space.

    The URL is as it stands, the kind without outer white space; null if it isn't a string.
    """
    kept = keep or []
    nodes = walk(df, value, kept).where(_is(F.col("node"), "OBJECT"))
    found = nodes.select(*kept, text_field(F.col("node"), "source_url").alias("source_url"), F.trim(text_field(F.col("node"), "source_kind")).alias("source_kind"))
    return found.where(F.trim("source_url") != "")
