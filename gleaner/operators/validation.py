"""Strict validation of JSON documents from one declarative description.

A description says for every field its kind and whether it must be there. :func:`check` turns it into two
columns: the document in its proper types, and an error (path, code) for everything that isn't as described. A
missing required field at the top rejects the document; within a list it drops the item.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx


class Field(NamedTuple):
    """Kinds: text, int, number, texts (list of texts), rows (list of lists of texts)."""

    kind: str = "text"
    required: bool = False


class Items(NamedTuple):
    """A list of objects."""

    fields: dict[str, Field]


#: A structured page document.
DOCUMENT: dict[str, Field | Items] = {
    "title": Field(required=True),
    "summary": Field(required=True),
    "sections": Items({"heading": Field(), "level": Field("int"), "content": Field(required=True)}),
    "images": Items({"src": Field(required=True), "alt": Field(), "caption": Field(), "context": Field()}),
    "videos": Items({
        "src": Field(required=True), "poster": Field(), "provider": Field(), "duration_seconds": Field("number"), "frame_summaries": Field("texts"),
    }),
    "tables": Items({"caption": Field(), "headers": Field("texts"), "rows": Field("rows")}),
}

_NO_ERRORS = "array<struct<path:string,code:string>>"
_KINDS = {"text": "string", "int": "bigint", "number": "double", "texts": "array<string>", "rows": "array<array<string>>"}


def _error(path: Column, code: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))


def _none() -> Column:
    return F.array().cast(_NO_ERRORS)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _starts(kind: Column, *names: str) -> Column:
    found = F.startswith(kind, F.lit(names[0]))
    for n in names[1:]:
        found = found | F.startswith(kind, F.lit(n))
    return found


def _plain_text(v: Column) -> Column:
    """A scalar as text without outer white space; blank for null, lists and objects."""
    scalar = ~_starts(_kind(v), "OBJECT", "ARRAY", "VOID")
    return F.coalesce(F.when(scalar, tx.strip(F.try_variant_get(v, "$", "string"))), F.lit(""))


def _elements(v: Column) -> Column:
    return F.when(_starts(_kind(v), "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _texts(v: Column, blanks: bool) -> Column:
    found = F.transform(_elements(v), _plain_text)
    return found if blanks else F.filter(found, lambda t: t != "")


def _field(v: Column, field: Field, path: Column) -> tuple[Column, Column]:
    """Value and errors of one field; ``v`` is null where it is absent."""
    kind = _kind(v)
    absent = kind == "VOID"
    if field.kind == "text":
        value, wrong = F.nullif(_plain_text(v), F.lit("")), _starts(kind, "OBJECT", "ARRAY")
    elif field.kind == "int":
        value, wrong = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")), kind != "BIGINT"
    elif field.kind == "number":
        number = _starts(kind, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        value, wrong = F.when(number, F.try_variant_get(v, "$", "double")), ~number
    elif field.kind == "texts":
        value, wrong = _texts(v, blanks=False), ~_starts(kind, "ARRAY")
    else:
        rows = F.filter(_elements(v), lambda r: _starts(_kind(r), "ARRAY"))
        value, wrong = F.transform(rows, lambda r: _texts(r, blanks=True)), ~_starts(kind, "ARRAY")
    errors = F.when(~absent & wrong, _error(path, "wrong_type"))
    if field.required:
        errors = errors.when(value.isNull(), _error(path, "missing"))
    return value.cast(_KINDS[field.kind]), errors.otherwise(_none())


def _object(v: Column, fields: dict[str, Field], path: Column) -> Column:
    """struct(value, errors, ok) of an object."""
    made = {n: _field(F.try_variant_get(v, f"$.{n}", "variant"), f, F.concat(path, F.lit(f".{n}"))) for n, f in fields.items()}
    missing = F.lit(False)
    for n, f in fields.items():
        missing = missing | made[n][0].isNull() if f.required else missing
    is_object = _starts(_kind(v), "OBJECT")
    errors = F.when(is_object, F.concat(*[e for _, e in made.values()])).otherwise(_error(path, "not_object"))
    return F.struct(F.struct(*[x.alias(n) for n, (x, _) in made.items()]).alias("value"), errors.alias("errors"), (is_object & ~missing).alias("ok"))


def _items(v: Column, items: Items, name: str) -> Column:
    """struct(value, errors) of a list of objects."""
    path = lambda i: F.concat(F.lit(f"$.{name}["), i.cast("string"), F.lit("]"))
    found = F.transform(_elements(v), lambda x, i: _object(x, items.fields, path(i)))
    wrong = F.when(_starts(_kind(v), "ARRAY", "VOID"), _none()).otherwise(_error(F.lit(f"$.{name}"), "wrong_type"))
    return tx.let(found, lambda xs: F.struct(
        F.transform(F.filter(xs, lambda x: x["ok"]), lambda x: x["value"]).alias("value"),
        F.concat(wrong, F.flatten(F.transform(xs, lambda x: x["errors"]))).alias("errors"),
    ))


def check(df: DataFrame, value: str, spec: dict[str, Field | Items] = DOCUMENT) -> DataFrame:
    """``df`` with ``document`` (null if rejected), ``errors`` and ``rejected``.

    ``value`` is a column of JSON text. Text that isn't JSON, or no object, is one error ``not_object``. Codes:
    not_object, missing (a required field is absent, null or blank), wrong_type. What is of the wrong
    type counts as absent; a JSON null is absent without an error where it isn't required.
    """
    df = df.withColumn("_node", F.try_parse_json(value))
    node = F.col("_node")
    plain = {n: f for n, f in spec.items() if isinstance(f, Field)}
    df = df.withColumn("_top", _object(node, plain, F.lit("$")))
    lists = [n for n, f in spec.items() if isinstance(f, Items)]
    df = df.withColumns({f"_{n}": _items(F.try_variant_get(node, f"$.{n}", "variant"), spec[n], n) for n in lists})
    document = F.struct(*[F.col(f"_top.value.{n}" if n in plain else f"_{n}.value").alias(n) for n in spec])
    errors = F.concat(F.col("_top.errors"), *[F.col(f"_{n}.errors") for n in lists])
    made = df.withColumns({"errors": errors, "rejected": ~F.col("_top.ok"), "document": F.when(F.col("_top.ok"), document)})
    return made.drop("_node", "_top", *[f"_{n}" for n in lists])


def error_rows(checked: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, path, code, rejected: one row per error."""
    return checked.select(*keep, "rejected", F.explode("errors").alias("e")).select(*keep, "e.path", "e.code", "rejected")


def error_counts(checked: DataFrame) -> DataFrame:
    """Errors per path (places in lists left out) and code."""
    rows = error_rows(checked, [])
    place = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return rows.groupBy(place.alias("path"), "code").agg(F.count("*").alias("n"))
