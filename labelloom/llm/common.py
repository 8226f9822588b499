"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of every contract here: ASCII blanks and controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

# A side goes into a broadcast only when a count has shown it to be this small.
BROADCAST_ROWS = 200_000

# Output batches of Python stages are cut at about this many bytes.
BATCH_BYTES = 4 << 20


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; -1 for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a narrow table for broadcast if its counted rows are within the bound.

    Pass `rows` when they are known. Larger tables are returned unmarked, so that the
    join shuffles and adaptive execution splits skewed keys.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row. Nested columns, maps too, count by their text form."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    parts = []
    for field in df.schema.fields:
        column = F.col("`{}`".format(field.name.replace("`", "``")))
        value = column.cast("string") if isinstance(field.dataType, nested) else column
        # Hashing passes over nulls: what is null has to be told apart by itself.
        parts += [value, column.isNull()]
    return F.xxhash64(*parts)


def words(text: Column) -> Column:
    """The white-space separated words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pass_through(docs: DataFrame, added: Iterable[str]) -> DataFrame:
    """The input without the columns that the operator itself adds."""
    return docs.drop(*[c for c in docs.columns if c in set(added)])


def in_small_batches(batch: pa.RecordBatch, bytes_per_row: float) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BATCH_BYTES each."""
    rows = max(1, int(BATCH_BYTES / max(1.0, bytes_per_row)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
