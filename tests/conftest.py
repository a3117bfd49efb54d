from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row."""

    def run(fn, **row):
        names, kinds = [], []
        for name, value in row.items():
            names.append(name)
            kinds.append(
                "boolean" if isinstance(value, bool) else "array<string>" if isinstance(value, list)
                else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
            )
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) or "x int"
        df = spark.createDataFrame([tuple(row.values()) or (1,)], schema)
        return df.select(fn(df).alias("out")).first()["out"]

    return run
