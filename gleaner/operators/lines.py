"""Line-level operators.

``explode_lines`` is the long form for corpus-wide questions. Per-document rules
(first-wins dedupe, budgets, groups opened by a marker) stay inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx


def explode_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pos, line): trimmed non-blank lines with their raw position."""
    raw = F.split(F.col(text), tx.LINE_BREAK)
    rows = ar.explode_rows(df, doc_id, raw, "raw", "pos")
    return rows.select(doc_id, "pos", tx.strip(F.col("raw")).alias("line")).filter("line <> ''")


def first_by_key(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first item per key, in order.

    Items are sorted by (key, position), so equal keys become neighbours and one
    pass over neighbours finds the first of each. n log n in the row's own length.
    """
    keyed = F.sort_array(F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("p"), x.alias("v"))))
    firsts = tx.let(
        keyed, lambda ks: F.filter(ks, lambda e, i: (i == 0) | ~e["k"].eqNullSafe(F.get(ks, i - 1)["k"]))
    )
    back = F.sort_array(F.transform(firsts, lambda e: F.struct(e["p"].alias("p"), e["v"].alias("v"))))
    return F.transform(back, lambda e: e["v"])


def label_of(c: Column) -> Column:
    """Text before the first colon (ASCII first, else full-width), else empty."""
    return tx.strip(
        F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1))
        .when(F.contains(c, F.lit("：")), F.substring_index(c, "：", 1))
        .otherwise(F.lit(""))
    )


def dedupe_labels(arr: Column, labels: Iterable[str] = lx.FACT_LABELS) -> Column:
    """First item per known ``label:``; items without a known label all stay."""
    labels = tuple(labels)
    tagged = F.transform(arr, lambda x, i: F.struct(x.alias("v"), label_of(x).alias("l"), i.alias("i")))
    keep = first_by_key(
        tagged, lambda t: F.when(t["l"].isin(*labels), t["l"]).otherwise(F.concat(F.lit("\x00"), t["i"].cast("string")))
    )
    return F.transform(keep, lambda t: t["v"])


def outside_fences(raw: Column) -> Column:
    """Lines outside Markdown code fences, the fence lines themselves excluded.

    Joining with a line break and cutting at the fences turns the running parity
    into piece numbers: even pieces lie outside.
    """
    fence, end = "\x01", "\x02"
    marked = F.transform(raw, lambda x: F.when(F.startswith(tx.strip(x), F.lit("```")), F.lit(fence)).otherwise(x))
    pieces = F.split(F.array_join(marked, end), fence)
    outside = F.filter(pieces, lambda p, i: i % 2 == 0)
    return F.filter(F.flatten(F.transform(outside, lambda p: F.split(p, end))), lambda x: x != "")


def groups_by_marker(arr: Column, is_marker: Callable[[Column], Column]) -> Column:
    """array<struct<head, items>>: every marker opens a group up to the next marker."""

    def build(xs: Column, heads: Column) -> Column:
        return F.transform(
            heads,
            lambda p, k: F.struct(
                F.element_at(xs, p).alias("head"),
                F.slice(xs, p + 1, F.coalesce(F.get(heads, k + 1), F.size(xs) + 1) - p - 1).alias("items"),
            ),
        )

    def positions(xs: Column) -> Column:
        return F.filter(F.transform(xs, lambda x, i: F.when(is_marker(x), i + 1)), lambda p: p.isNotNull())

    return tx.let(arr, lambda xs: tx.let(positions(xs), lambda heads: build(xs, heads)))


def _from_first(xs: Column, flags: Column, keep: bool) -> Column:
    """Tail of ``xs`` from the first raised flag; that item itself only if ``keep``."""
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, ar.skip(xs, at - (1 if keep else 0))).otherwise(F.slice(xs, 1, 0))


def until_first(xs: Column, flags: Column) -> Column:
    """Items before the first raised flag."""
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, ar.take(xs, at - 1)).otherwise(xs)


def section_slice(raw: Column, heading: str) -> Column:
    """Lines between a ``## heading`` line and the next ``## `` line."""
    trimmed = F.transform(raw, lambda x: tx.strip(x))
    rest = tx.let(trimmed, lambda xs: _from_first(xs, F.transform(xs, lambda x: x == heading), keep=False))
    return tx.let(rest, lambda xs: until_first(xs, F.transform(xs, lambda x: F.startswith(x, F.lit("## ")))))


def between_markers(arr: Column, is_start: Callable[[Column], Column], is_stop: Callable[[Column], Column]) -> Column:
    """Items from the first start (included) up to the first stop behind it."""
    rest = tx.let(arr, lambda xs: _from_first(xs, F.transform(xs, is_start), keep=True))
    return tx.let(rest, lambda xs: until_first(xs, F.transform(xs, is_stop)))


def unique_ratio(c: Column) -> Column:
    """Distinct over all non-blank lines; 0 for empty text."""
    return tx.let(
        ar.lines(c),
        lambda xs: F.when(F.size(xs) > 0, F.size(F.array_distinct(xs)) / F.size(xs)).otherwise(F.lit(0.0)),
    )
