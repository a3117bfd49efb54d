"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell holds a number of tokens.
*Raking* scales the token weights of the cells until their sums by source, by language and by
topic are all as wanted. The scale of a cell, times one factor for the whole corpus, is the
probability with which its documents are sampled; the factor is *calibrated* so that the
expected tokens meet the budget although no probability exceeds 1. A document is kept if a
hash of its id, read as a number in [0, 1), lies below its probability, so a sample can be
repeated and is the same on every cluster.

Native throughout. Texts are read once to count tokens and once for the sample; what moves is
one row per cell, summed before the exchange. Margins are aggregations joined back to the
cells, never a window over all cells of a language, and every sweep is a table in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import free_name, materialize
from gleaner.sources.tables import read_table

#: Targets by default: a margin's share is its token count to this power (1: as found, 0: all equal).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample is to hold.
BUDGET = 0.6
SWEEPS = 8
CALIBRATION = 12
SEED = "mix"
NONE = "(none)"

# Topics by form, first match counts; anything else is prose. A corpus with a topic column passes that instead.
TOPICS = (("legal", "licens"), ("contact", "@"), ("table", " | "), ("emphasis", "!!"))
PROSE = "prose"
AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """Topic of a text by the first mark that it contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(PROSE)
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(lowered, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """White space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of a key; a null key counts as an empty one."""
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(code, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def cells(measured: DataFrame) -> DataFrame:
    """(source, lang, topic, t): tokens of every cell."""
    return measured.groupBy(*AXES).agg(F.sum("n_tokens").cast("double").alias("t"))


def margins(table: DataFrame, axis: str, value: str) -> DataFrame:
    return table.groupBy(axis).agg(F.sum(value).alias("m"))


def default_targets(table: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """Per axis (key, share): the smoothed shares of the tokens that there are."""
    out = {}
    for axis in AXES:
        m = margins(table, axis, "t").where("m > 0").select(axis, F.pow("m", F.lit(powers[axis])).alias("p"))
        total = m.agg(F.sum("p")).first()[0] or 1.0
        out[axis] = m.select(axis, (F.col("p") / F.lit(total)).alias("share"))
    return out


def rake(table: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``table`` with ``w``: token weights whose margins approach ``targets`` times all tokens.

    A key without a target keeps its weight; a target without tokens can't be met and is left out.
    """
    total = table.agg(F.sum("t")).first()[0] or 0.0
    state = table.withColumn("w", F.col("t"))
    for _ in range(sweeps):
        for axis in AXES:
            scale = margins(state, axis, "w").join(targets[axis], axis).select(
                axis, F.when(F.col("m") > 0, F.col("share") * F.lit(total) / F.col("m")).otherwise(F.lit(1.0)).alias("f")
            )
            state = state.join(scale, axis, "left").select(*AXES, "t", (F.col("w") * F.coalesce("f", F.lit(1.0))).alias("w"))
        state = materialize(state, "rake")
    return state


def calibrate(raked: DataFrame, budget: float = BUDGET, steps: int = CALIBRATION) -> DataFrame:
    """(source, lang, topic, weight, prob): scale and sampling probability of every cell.

    The factor is found by repeated scaling; only sums reach the driver. Cells without tokens cost nothing: weight and probability 1.
    """
    table = raked.withColumn("weight", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(F.lit(1.0)))
    goal = budget * (raked.agg(F.sum("t")).first()[0] or 0.0)
    factor = budget
    for _ in range(steps):
        reached = table.agg(F.sum(F.least(F.lit(1.0), F.lit(factor) * F.col("weight")) * F.col("t"))).first()[0] or 0.0
        factor = factor * goal / reached if reached > 0 else factor
    prob = F.when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("weight"))).otherwise(F.lit(1.0))
    return table.select(*AXES, "weight", prob.alias("prob"))


def mix(
    docs: DataFrame, result: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    topic: str | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with a struct ``result``: source, lang, topic, n_tokens, weight, prob, kept.

    ``targets`` maps each axis to (key, share); by default the shares there are, smoothed. Null
    sources, languages and topics form cells of their own. Null and empty texts have no tokens
    and the probability of their cell. Rows repeated with an id are all kept or all left out.
    """
    kept = docs.columns if keep is None else keep
    m = free_name(docs, "m_in")
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE))
    body = F.col(f"`{text}`").cast("string")
    struct = F.struct(
        named(source).alias("source"), named(lang).alias("lang"), (named(topic) if topic else topic_of(body)).alias("topic"),
        tokens_of(body).alias("n_tokens"), unit(F.col(f"`{doc_id}`")).alias("u"),
    )
    measured = docs.select(*[F.col(f"`{c}`") for c in kept], struct.alias(m))
    table = materialize(cells(measured.select(f"{m}.*")), "cells")
    probabilities = materialize(calibrate(rake(table, targets or default_targets(table)), budget), "mix")
    keys = [free_name(docs, f"{a}_in") for a in AXES]
    weight, prob = free_name(docs, "weight_in"), free_name(docs, "prob_in")
    cell = probabilities.toDF(*keys, weight, prob)
    same = F.lit(True)
    for axis, key in zip(AXES, keys):
        same = same & (F.col(m)[axis] == F.col(key))
    joined = measured.join(cell, same, "left")
    f = F.col(m)
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.struct(
        f["source"].alias("source"), f["lang"].alias("lang"), f["topic"].alias("topic"), f["n_tokens"].alias("n_tokens"),
        F.col(weight).alias("weight"), F.col(prob).alias("prob"), (f["u"] < F.col(prob)).alias("kept"),
    ).alias(result))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with all their columns."""
    result = free_name(docs, "mix")
    found = mix(docs, result, **options)
    return found.where(F.col(result)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    found = mix(docs, "mix", keep=["doc_id"])
    return found.select(
        "doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.weight", 6).alias("weight"),
        F.round("mix.prob", 6).alias("prob"), "mix.kept",
    )


def _oracle() -> str:
    topic = "CASE " + " ".join(f"WHEN contains(lower(coalesce(text, '')), '{mark}') THEN '{name}'" for name, mark in TOPICS) + f" ELSE '{PROSE}' END"
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic,
          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
          ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(t) AS n FROM c0)",
    ]
    for axis in AXES:
        parts.append(f"""t_{axis} AS MATERIALIZED (SELECT {axis}, p / sum(p) OVER () AS share
          FROM (SELECT {axis}, pow(sum(t), {POWERS[axis]}) AS p FROM c0 GROUP BY {axis} HAVING sum(t) > 0))""")
    k = 0
    for _ in range(SWEEPS):
        for axis in AXES:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
              SELECT c.source, c.lang, c.topic, c.t, c.w * coalesce(CASE WHEN m > 0 THEN share * n / m ELSE 1 END, 1) AS w
              FROM c{k} c LEFT JOIN (SELECT {axis}, sum(w) AS m FROM c{k} GROUP BY {axis}) s USING ({axis})
              LEFT JOIN t_{axis} USING ({axis}), total)""")
            k += 1
    parts.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN w / t ELSE 1 END AS weight FROM c{k})")
    parts.append(f"f0 AS MATERIALIZED (SELECT {BUDGET}::DOUBLE AS f)")
    for i in range(CALIBRATION):
        parts.append(f"""f{i + 1} AS MATERIALIZED (SELECT any_value(f) * {BUDGET} * any_value(n) / sum(least(1, f * weight) * t) AS f FROM r, f{i}, total)""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight,
      round(CASE WHEN t > 0 THEN least(1, f * weight) ELSE 1 END, 6) AS prob,
      u < CASE WHEN t > 0 THEN least(1, f * weight) ELSE 1 END AS kept
    FROM d JOIN r USING (source, lang, topic), f{CALIBRATION}"""


ORACLE = _oracle()
