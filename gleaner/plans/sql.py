"""Text pieces for the oracle SQL."""

from __future__ import annotations

from collections.abc import Iterable

from gleaner.functions.text import WHITESPACE


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(c: str, chars: str = WHITESPACE) -> str:
    return f"trim({c}, {lit(chars)})"


def rstrip(c: str, chars: str = WHITESPACE) -> str:
    return f"rtrim({c}, {lit(chars)})"


def squash(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def contains_any(c: str, tokens: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(t)})" for t in tokens) + ")"


def starts_any(c: str, tokens: Iterable[str]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {lit(t)})" for t in tokens) + ")"


def ends_any(c: str, tokens: Iterable[str]) -> str:
    return "(" + " OR ".join(f"ends_with({c}, {lit(t)})" for t in tokens) + ")"


def in_list(c: str, tokens: Iterable[str]) -> str:
    return f"{c} IN (" + ", ".join(lit(t) for t in tokens) + ")"


def clip(c: str, n: int, marker: str = "...") -> str:
    cut = rstrip(f"substr({c}, 1, {n})")
    return f"CASE WHEN length({c}) > {n} THEN {cut} || {lit(marker)} ELSE {c} END"


def lines(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ``raw`` and ``lines(key, pos, line)`` of a text table."""
    item = strip("xs[i]")
    return f"""raw AS (SELECT {key}, string_split({text}, chr(10)) AS xs FROM {table}),
    numbered AS (SELECT {key}, xs, unnest(range(1, len(xs) + 1)) AS i FROM raw),
    lines AS (SELECT {key}, i - 1 AS pos, {item} AS line FROM numbered WHERE {item} <> '')"""


#: Kind of a request, derived from the source column.
KIND = (
    "CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'pasted_text' WHEN 1 THEN 'url' "
    "WHEN 2 THEN 'mixed' WHEN 3 THEN 'image' ELSE 'video_url' END"
)

#: Requests: documents with the page of the same number as source.
REQUESTS = f"""requests AS (
      SELECT d.doc_id, {KIND} AS source_kind, p.url AS source_url, d.lang, d.source,
             CASE WHEN p.url IS NULL THEN d.text ELSE p.url || chr(10) || d.text END AS text
      FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""
