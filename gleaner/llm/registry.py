"""The thin query of every operator, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleaner.session import apply_defaults

Query = Callable[[SparkSession, str], DataFrame]

#: query name -> module; each module has ``query`` and, where SQL can say it, ``ORACLE``
MODULES = {
    "op1_warc": "gleaner.llm.warc",
    "op2_cotraining": "gleaner.llm.cotraining",
    "op3_neardup": "gleaner.llm.neardup",
    "op4_rules": "gleaner.llm.rules",
    "op5_language": "gleaner.llm.langid",
    "op6_pii": "gleaner.llm.pii",
    "op7_licenses": "gleaner.llm.licenses",
    "op8_substrings": "gleaner.llm.substrings",
    "op9_decontaminate": "gleaner.llm.decontaminate",
    "op10_mixing": "gleaner.llm.mixing",
    "op11_ranked": "gleaner.llm.ranked",
    "op12_chat": "gleaner.llm.chat",
    "op13_crosstok": "gleaner.llm.crosstok",
}


def _with_defaults(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {name: _with_defaults(importlib.import_module(module).query) for name, module in MODULES.items()}
    return {**found, "pipeline": _with_defaults(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(module), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in {**found, "pipeline": corpus_pipeline.ORACLE_SQL}.items() if sql}
