"""Small tables with the cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 97} x{i}" for i in range(4000))

ODD = [
    (1, "The cat sat on the mat and then the cat sat on the hat near the door of the house.", "en", "a", 80),
    (2, None, "en", "a", 0),
    (3, "", None, "a", 0),
    (4, "   \n\t ", "en", None, 6),
    (5, "12 345 -- !!", None, None, 12),
    (6, LONG, "en", "b", len(LONG)),
    (7, "The cat sat on the mat and then the cat sat on the hat near the door of the house.", "en", "b", None),
    (7, "The cat sat on the mat and then the cat sat on the hat near the door of the house.", "en", "b", None),
    (8, "le chat est sur la table et le chien est dans la rue avec les enfants de la ville", "fr", "b", 80),
    (None, "die Katze sitzt auf dem Tisch und der Hund ist in der Straße mit den Kindern der Stadt", "de", "a", 85),
]


def table(spark, rows, schema=SCHEMA):
    """Rows with further columns whose names clash with those that the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    for name in ("n", "m", "kept", "found", "text_in", "key", "node", "weight"):
        df = df.withColumn(name, F.lit("x"))
    return df


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
