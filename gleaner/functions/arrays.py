"""Array expressions for work inside one row.

A text arrives whole in one cell, so everything that only looks at the lines of
that text can run as a narrow map: no exchange, no window, no skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx

EMPTY = "array<string>"


def strings(*values: Column | str) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]).cast(EMPTY)


def empty_strings() -> Column:
    return F.array().cast(EMPTY)


def or_empty(arr: Column) -> Column:
    return F.coalesce(arr, empty_strings())


def lines(c: Column) -> Column:
    """Trimmed non-blank lines in document order."""
    raw = F.split(tx.text_or_empty(c), tx.LINE_BREAK)
    return F.filter(F.transform(raw, lambda x: tx.strip(x)), lambda x: x != "")


def take(arr: Column, n: int | Column | None) -> Column:
    """The first ``n`` values; None: all."""
    return arr if n is None else F.slice(arr, 1, n)


def skip(arr: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return tx.let(arr, lambda xs: F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0))))


def keep_first(arr: Column, limit: int | None = None) -> Column:
    """Trim, drop blanks, keep the first of equal values, optionally the first ``limit``."""
    cleaned = F.filter(F.transform(or_empty(arr), lambda x: tx.strip(x)), lambda x: x.isNotNull() & (x != ""))
    unique = F.array_distinct(cleaned)
    return take(unique, limit)


def join_present(sep: str, *values: Column) -> Column:
    """Join the non-blank values."""
    present = F.filter(F.array(*[F.coalesce(v, F.lit("")) for v in values]), lambda x: tx.strip(x) != "")
    return F.array_join(present, sep)


def merge_blocks(*blocks: Column) -> Column:
    """Trimmed distinct blocks, in order, with an empty line between."""
    arr = F.array(*[tx.text_or_empty(b) for b in blocks])
    return tx.strip(F.array_join(keep_first(arr), "\n\n"))


def exists_in(arr: Column, value: Column) -> Column:
    return F.array_contains(arr, value)


def ranked(arr: Column, score: Callable[[Column], Column]) -> Column:
    """array<struct<rank,pos,value>> with the negated score, each score computed once."""
    return F.transform(arr, lambda x, i: F.struct((-score(x)).alias("rank"), i.alias("pos"), x.alias("value")))


def best_in_order(entries: Column, limit: int | Column) -> Column:
    """Best ``limit`` values of ranked entries, earlier position first on ties, in document order.

    Ordering uses the natural order of a struct, which Spark sorts without calling
    back into a comparator.
    """
    best = F.slice(F.sort_array(entries), 1, limit)
    by_position = F.sort_array(F.transform(best, lambda e: F.struct(e["pos"].alias("pos"), e["value"].alias("value"))))
    return F.transform(by_position, lambda e: e["value"])


def top_by_score(arr: Column, score: Callable[[Column], Column], limit: int | Column) -> Column:
    """Best ``limit`` values by score, back in document order."""
    return best_in_order(ranked(arr, score), limit)


def explode_rows(df: DataFrame, keep: list[str] | str, arr: Column, value: str, ord_name: str = "ord") -> DataFrame:
    """One row per item with its position.

    The outer form plus a filter on the position reads ``arr`` once. The inner form
    makes the optimizer test ``size(arr) > 0`` first, and pushing that test to the
    scan repeats the whole computation behind ``arr``.
    """
    keep = [keep] if isinstance(keep, str) else keep
    return df.select(*keep, F.posexplode_outer(arr).alias(ord_name, value)).filter(F.col(ord_name).isNotNull())


def fits_prefix(sizes: Column, budget: int | Column, separator: int = 1) -> Column:
    """How many leading items fit into ``budget`` characters, separators included.

    The fold carries three numbers and stops counting at the first overflow.
    """
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, size: Column) -> Column:
        projected = acc["used"] + size + F.when(acc["kept"] > 0, F.lit(separator)).otherwise(F.lit(0))
        fits = acc["open"] & (projected <= budget)
        return F.struct(
            F.when(fits, projected).otherwise(acc["used"]).alias("used"),
            (acc["kept"] + fits.cast("int")).alias("kept"),
            fits.alias("open"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["kept"])
