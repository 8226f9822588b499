"""Exact duplicates and text that carries both labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import subtype_priority
from labelloom.operators.joins import HOT_SHARE, join_splitting_hot_keys
from labelloom.session import materialize


# Short hashes of the filter that clears safe rows before the leak join: 4 MB at most.
FILTER_SIZE = 1 << 20


def with_priority(df: DataFrame, *, prefer_label: int | None = None) -> DataFrame:
    """Add `priority`; with `prefer_label`, rows of that label outrank all others.

    By default the priority looks at the subtype only, so a row with an unlisted
    subtype loses to an identical safe row whatever its label.
    """
    priority = subtype_priority("subtype")
    if prefer_label is not None:
        priority = F.when(F.col("y") == prefer_label, priority).otherwise(priority + 10)
    return df.withColumn("priority", priority)


def exact_dedup(
    df: DataFrame,
    *,
    key: str = "prompt_norm",
    order: Sequence[str] = ("priority", "row_id"),
    copies: str | None = None,
) -> DataFrame:
    """One row per text: the smallest by `order`. `copies` names a group-size column.

    Decided on (hash of the text, order), so that no task sorts texts: tasks add up before
    they shuffle, and a text that makes up a third of the table leaves one row a task. The
    rows that stay are then found by hash and order, which also spreads the copies of one
    text; their side of that join is narrow and is the one that is hashed.
    """
    key_of = F.unhex(F.sha2(F.col(key), 256))
    keyed = df.withColumn("_key", key_of)
    best = materialize(
        keyed.groupBy("_key", *order)
        .agg(F.count("*").alias("m"))
        .groupBy("_key")
        .agg(F.min(F.struct(*order, "m")).alias("best"), F.sum("m").alias("n"))
        .select(
            F.col("_key").alias("_of"),
            *[F.col(f"best.{c}").alias(f"_{i}") for i, c in enumerate(order)],
            (F.col("best.m") > 1).alias("_several"),
            F.col("n").alias("_n"),
        ),
        "first-of-text",
    )
    same = F.col("_key").eqNullSafe(F.col("_of"))
    for i, column in enumerate(order):
        same &= F.col(column).eqNullSafe(F.col(f"_{i}"))
    extra = [F.col("_n").alias(copies)] if copies else []
    kept = keyed.join(best.hint("shuffle_hash"), same)
    if not best.where("_several").isEmpty():
        # Rows equal in text and order: any one of them.
        columns = F.struct(*df.columns, "_n")
        once = kept.where("_several").groupBy("_key").agg(F.first(columns).alias("row"))
        kept = kept.where("NOT _several").select(*df.columns, "_n").unionByName(
            once.select("row.*")
        )
    return kept.select(*df.columns, *extra)


def label_conflicts(df: DataFrame, *, key: str = "prompt_norm") -> DataFrame:
    """Hashes of the texts that occur both with y=0 and with y=1."""
    return _conflicts(df, key).select("text_hash")


def _conflicts(df: DataFrame, key: str) -> DataFrame:
    """(text_hash, n): conflicting texts, and their safe rows."""
    return (
        df.groupBy(F.sha2(F.col(key), 256).alias("text_hash"))
        .agg(
            F.min("y").alias("lowest"),
            F.max("y").alias("highest"),
            F.count_if(F.col("y") == 0).alias("n"),
        )
        .where("lowest = 0 AND highest = 1")
        .select("text_hash", "n")
    )


def leaked_rows(df: DataFrame, *, key: str = "prompt_norm") -> DataFrame:
    """Safe rows whose text also occurs in a blocked row."""
    _, suspects = _suspects(df, key)
    conflicts, total = _counted_conflicts(df, key)
    met = join_splitting_hot_keys(suspects, conflicts, "text_hash", total)
    return met.select(*df.columns)


def drop_leaked(df: DataFrame, *, key: str = "prompt_norm") -> DataFrame:
    """All rows but the leaked safe ones. Only suspect safe rows take part in the join."""
    others = df.where(~F.col("y").eqNullSafe(0))
    clear, suspects = _suspects(df, key)
    conflicts, total = _counted_conflicts(df, key)
    is_hot = F.col("n") > F.lit(total / HOT_SHARE)
    hot = F.broadcast(conflicts.where(is_hot).select("text_hash"))
    cold = conflicts.where(~is_hot).select("text_hash")
    left = suspects.join(hot, "text_hash", "left_anti").join(cold, "text_hash", "left_anti")
    return others.unionByName(clear).unionByName(left.select(*df.columns))


def _suspects(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Safe rows that no blocked row can share a text with, and the others with their hash.

    A filter of the blocked texts: the set of their short hashes, which has at most
    FILTER_SIZE members whatever the table holds and is broadcast. It never clears a leaked
    row; what it lets through by chance, the join decides. `df` is read several times: pass
    a written table if its text is costly to make.
    """
    short = F.pmod(F.xxhash64(key), F.lit(FILTER_SIZE)).cast("int")
    blocked = F.broadcast(df.where("y = 1").select(short.alias("_short")).distinct())
    safe = df.where("y = 0").withColumn("_short", short)
    clear = safe.join(blocked, "_short", "left_anti").select(*df.columns)
    suspects = safe.join(blocked, "_short", "left_semi")
    return clear, suspects.select(*df.columns, F.sha2(F.col(key), 256).alias("text_hash"))


def _counted_conflicts(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The conflicts, written once, and the safe rows; what is hot follows from both."""
    conflicts = materialize(_conflicts(df, key), "conflicts")
    return conflicts, conflicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
