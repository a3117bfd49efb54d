"""Keyed helpers that stay safe when one key holds a third of the rows.

``distinct_first`` and ``distinct_last`` are aggregations, so every task reduces
its own rows before the shuffle. ``top_per_key`` filters on a row number, which
Spark turns into a group limit on both sides of the exchange. Neither sends all
rows of a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import run_folder


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in others])
    chosen = F.max_by(row, by) if last else F.min_by(row, by)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``."""
    return _pick(df, keys, order, last=False)


def distinct_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    return _pick(df, keys, order, last=True)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Iterable[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on an expensive computed condition without computing it twice.

    The optimizer pushes a filter below the projection that computes its columns
    and so repeats the computation. A row number in that projection keeps it above.
    """
    marked = df.withColumns({"_keep": condition, "_row": F.monotonically_increasing_id()})
    return marked.filter(F.col("_keep") & (F.col("_row") >= 0)).drop("_keep", "_row")


def salted_lookup(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", salts: int = 16, deal_by: Sequence[str] | None = None
) -> DataFrame:
    """Join facts with hot keys to a lookup that has one row per key.

    Facts of one key are dealt over ``salts`` buckets by a hash of ``deal_by`` (or
    of all columns); the lookup is replicated once per bucket. The lookup may have
    any size, and no task sees more than one bucket of a hot key.
    """
    deal = deal_by or [c for c in facts.columns if c not in keys] or list(keys)
    dealt = facts.withColumn("_salt", F.pmod(F.xxhash64(*deal), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Place of each row in ``order`` from 0, without one task that sorts them all.

    Rows are sorted by range and written; a partition's first number is the size of those before it.
    """
    spark = df.sparkSession
    folder = f"{run_folder(spark, 'number')}/rows"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")
