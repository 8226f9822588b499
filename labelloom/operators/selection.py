"""The first n rows of a table by integer keys, without sorting it in one place."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize

# Bins of one look at the table; as many counts come to the driver each time.
BINS = 1024
# Rows equal in the keys so far that one task may rank.
FEW_TIES = 10_000
_BYTES = 7


def first_rows(df: DataFrame, keys: Sequence[Column], n: int, *, last: str) -> DataFrame:
    """The n first rows by the keys (bigint, ascending), then by the column `last`.

    A histogram of the first key finds the value at which the n-th row stands; everything
    before it is taken. Only the rows at that value go on to the next key, and are ranked
    once they are few. Each look at the table narrows the value down 1024 times.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = materialize(df.withColumns(dict(zip(names, keys))), "selection")
    if rows.count() <= n:
        return rows.drop(*names)
    chosen, rest, room = [], rows, n
    for name in names:
        value, before = _cut(rest, name, room)
        chosen.append(rest.where(F.col(name) < value))
        rest = rest.where(F.col(name) == value)
        room -= before
        ties = rest.count()
        if ties == room:
            break
        if ties <= FEW_TIES:
            rest = rest.orderBy(last).limit(room)
            break
    else:
        rest = rest.orderBy(last).limit(room)
    return functools.reduce(DataFrame.unionAll, [*chosen, rest]).drop(*names)


def _cut(rows: DataFrame, key: str, n: int) -> tuple[int, int]:
    """The key of the n-th row, and how many rows have a smaller one."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    before = 0
    while low < high:
        width = (high - low) // BINS + 1
        counts = (
            rows.where(F.col(key).between(low, high))
            .groupBy(F.expr(f"({key} - {low}L) div {width}L").alias("bin"))
            .count()
            .collect()
        )
        for row in sorted(counts):
            if before + row["count"] >= n:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            before += row["count"]
    return low, before


def byte_keys(text: Column | str, parts: int = 8) -> list[Column]:
    """Integers that order strings as their UTF-8 bytes do, `_BYTES` bytes in each."""
    data = F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")
    return [
        F.conv(
            F.rpad(F.hex(F.substring(data, 1 + _BYTES * i, _BYTES)), 2 * _BYTES, "0"), 16, 10
        ).cast("long")
        for i in range(parts)
    ]
