"""What the operators share: table reads, folds, block sizes and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import shared_folder, ship, written

__all__ = ["fold", "is_held_out", "map_rows", "one_model", "read", "shared_folder", "small_batches", "written"]

#: Characters of text that one vectorised step takes; a longer text is a step of its own.
STEP_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; null for null ids, which are not held out."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 3


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def small_batches(texts: list[str], limit: int = STEP_CHARS):
    """(first, end) ranges of consecutive texts that hold at most ``limit`` characters, or one longer text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def map_rows(df: DataFrame, kept: Sequence[str | Column], inputs: Sequence[str | Column], added: str, make: Callable[[], Callable[..., Sequence]]) -> DataFrame:
    """``kept`` columns of ``df``, untouched, beside the ``added`` ones that a function gives for ``inputs``.

    ``make`` builds that function once a task; it takes the inputs of a batch as lists and gives a sequence for each added
    column. Kept columns stay Arrow arrays, so that ids beyond 2^53 beside nulls remain what they are. An added column
    takes the place of a kept one of its name.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(added)
    chosen = df.select(*kept)
    names = [c for c in chosen.columns if c not in new.names]
    source = df.select(*kept, *inputs).toDF(*chosen.columns, *(f"{c}{len(chosen.columns)}_{k}" for k, c in enumerate(["_input"] * len(inputs))))
    schema = T.StructType([f for f in chosen.schema.fields if f.name in names] + new.fields)
    n, at = len(chosen.columns), [k for k, c in enumerate(chosen.columns) if c in names]
    types = [_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            found = f(*(c.to_pylist() for c in batch.columns[n:]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_MODEL: list = [None, None]


def one_model(key: object, make: Callable[[], object]) -> object:
    """The model of that key; a worker process holds one at a time, so that reused workers do not add up what each operator needs."""
    if _MODEL[0] != key:
        _MODEL[:] = [None, None]
        _MODEL[:] = [key, make()]
    return _MODEL[1]
