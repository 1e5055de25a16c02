"""What the operators share: Arrow passes, word splitting, stable hashing and the queries' registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.session import cut, prepare, scratch_path

__all__ = ["LLM_QUERIES", "arrow_map", "cut", "llm_query", "mix", "scratch_path", "stored", "table", "texts", "words_of"]

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Rows of one Arrow batch: long texts make large rows, and a batch lies in a Python worker whole.
BATCH_ROWS = 1000

#: Bytes that are part of a word: ASCII letters (lowered) and digits, and every byte of a non-ASCII character.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def llm_query(fn):
    """Register a query under its function's name, with its DuckDB text from `sql.py` where there is one."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return fn(spark, sf)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    LLM_QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """A table in the shared folder that holds `df`: cuts the lineage like a checkpoint, and the plan's constraints too,
    which grow from round to round in iterations."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most_bytes: int | None = None) -> DataFrame:
    """`step` over Arrow batches. With `most_bytes` it gets them in parts of no more bytes, or of one row."""
    if most_bytes is None:
        return df.mapInArrow(step, schema)

    def bounded(batches):
        return step(part for b in batches for part in halves(b, most_bytes))

    return df.mapInArrow(bounded, schema)


def halves(b: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows < 2 or b.nbytes <= most_bytes:
        yield b
    else:
        yield from halves(b.slice(0, b.num_rows // 2), most_bytes)
        yield from halves(b.slice(b.num_rows // 2), most_bytes)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
