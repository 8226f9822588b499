"""Row identity and the hash order that replaces random number generators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_COLUMNS = ("prompt", "y", "source", "subtype")


def with_row_id(df: DataFrame, columns: tuple[str, ...] = LABELLED_COLUMNS) -> DataFrame:
    """Add a content-derived `row_id` unless the frame already has one.

    Ids that depend on partitioning would make a re-run task choose other rows.
    Rows equal in all `columns` share an id, so deduplicate before using it as a key.
    """
    if "row_id" in df.columns:
        return df
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return df.withColumn("row_id", F.sha2(F.concat_ws("\x1f", *parts), 256))


def hash_order(
    seed: int, purpose: str | Column, row_id: Column | str = "row_id"
) -> Column:
    """Hex key that orders rows as a seeded permutation would.

    `purpose` keeps picks independent of one another under the same seed.
    """
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    return F.sha2(
        F.concat_ws("|", F.lit(str(seed)), purpose, row_id.cast("string")), 256
    )


def stratum_key(y: str = "y", source: str = "source") -> Column:
    return F.concat_ws("_", F.col(y).cast("string"), F.col(source))


def double_order_key(value: Column | str) -> Column:
    """A 64-bit integer that orders doubles as they compare; not a number comes last.

    Positive doubles order as their bits do, negative ones the other way round.
    """

    @F.arrow_udf(T.LongType())
    def key(values: pa.Array) -> pa.Array:
        bits = np.asarray(values, dtype=np.float64).view(np.int64)
        turned = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
        return pa.array(turned, mask=np.asarray(values.is_null()))

    return key.asNondeterministic()(F.col(value) if isinstance(value, str) else value)
