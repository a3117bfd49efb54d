"""Helpers shared by the operators: word rules, batch annotation, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from gleaner.session import checkpoint_dir

_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: A-Z to a-z, every other ASCII byte outside 0-9 and a-z to a space; bytes of non-ASCII letters stay.
FOLD = bytes(
    b if b >= 0x80 or b in _ALNUM else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

#: Text bytes that a Python task holds as one block.
BLOCK_BYTES = 4 << 20


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(FOLD).split()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of about ``limit`` bytes of text each, with the texts as bytes (null: None)."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def annotate(
    df: DataFrame,
    text: str,
    result: str,
    schema: T.StructType,
    make: Callable[[], Callable[[list], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) and a struct column ``result`` computed from the text of each row.

    ``make`` runs once per task and returns the function from a list of texts (UTF-8 bytes
    or None) to one list or array per field. Rows stay where they are: no exchange.
    """
    kept = df.columns if keep is None else keep
    source = free_name(df, "text_in")
    out = T.StructType([*[df.schema[c] for c in kept], T.StructField(result, schema)])
    arrow_out = to_arrow_schema(out)
    fields = [pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, texts in blocks(batch, source):
                made = [
                    a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(work(texts), fields, strict=True)
                ]
                struct = pa.StructArray.from_arrays(made, fields=fields)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, struct], names=arrow_out.names)

    picked = [F.col(f"`{c}`") for c in kept]
    return df.select(*picked, F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, out)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a local temporary folder serves.
    """
    root = checkpoint_dir(spark) or tempfile.mkdtemp(prefix="gleaner-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
