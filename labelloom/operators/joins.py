"""Joins that stay even when a few keys hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize

# A key with more than 1/HOT_SHARE of the rows is hot. There can be at most HOT_SHARE
# such keys, which bounds what is broadcast whatever the table size.
HOT_SHARE = 1000
# A written table of one or two numbers a row is broadcast up to this many rows.
FEW_ROWS = 500_000


def join_splitting_hot_keys(
    left: DataFrame, right: DataFrame, key: str, total: int
) -> DataFrame:
    """Inner join where `right` has one row per key and `n`, the key's rows in `left`.

    A key with more than 1/HOT_SHARE of the `total` left rows is hot. Hot keys are
    matched by broadcast, of at most HOT_SHARE rows, and leave the shuffle join, in
    which every key is then small against the whole.
    """
    is_hot = F.col("n") > F.lit(total / HOT_SHARE)
    hot = F.broadcast(right.where(is_hot))
    return left.join(hot, key).unionByName(
        left.join(hot.select(key), key, "left_anti").join(right.where(~is_hot), key)
    )


def broadcast_if_few(narrow: DataFrame) -> DataFrame:
    """Marks a written, narrow table for broadcast if its counted rows are few."""
    return F.broadcast(narrow) if narrow.count() <= FEW_ROWS else narrow


def hot_keys(written: DataFrame, key: str) -> DataFrame:
    """(hot, parts): keys with over 1/HOT_SHARE of the rows, and into how many parts their
    rows are to be dealt so that no part has more. At most HOT_SHARE rows."""
    total = max(1, written.count())
    share = F.ceil(F.col("count") * HOT_SHARE / F.lit(total)).cast("int")
    counted = written.groupBy(F.col(key).alias("hot")).count()
    return materialize(
        counted.select("hot", share.alias("parts")).where("parts > 1"), "hot-keys"
    )


def join_dealing_hot_keys(
    left: DataFrame, right: DataFrame, key: str, other: str, hot: DataFrame
) -> DataFrame:
    """Inner join where `right` has one wide row per key, too wide to broadcast.

    Rows of a hot key (see `hot_keys`) are dealt by the column `other`, and the key's row on
    the right is repeated for each part.
    """
    hot = F.broadcast(hot)
    part = F.when(F.col("parts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(other), F.col("parts"))
    )
    dealt = left.join(hot, F.col(key) == F.col("hot"), "left").withColumn(
        "_part", part.cast("int")
    )
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    repeated = right.join(hot, F.col(key) == F.col("hot"), "left").withColumn(
        "_part", F.explode(parts)
    )
    return (
        dealt.drop("hot", "parts")
        .join(repeated.drop("hot", "parts"), [key, "_part"])
        .drop("_part")
    )
