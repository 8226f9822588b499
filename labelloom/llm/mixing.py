"""Mixing sources to target weights along a time-varying curriculum.

1. Sizes and source totals; each source's share of the budget follows its weight, limited
   to `max_repeats` times its size, the excess going to the others by weight.
2. Each source's rows lie one after the other in hash order on a line of words, repeated
   as often as the mix reads the source. A copy is taken if its middle lies before the
   target.
3. A source's demand over training time t in [0, 1] is the integral of its schedule, which
   runs linearly from `start` to `end` times its mean rate. Solving demand(t) = the copy's
   middle gives its training position; `arrange` range-sorts by it.

The running totals are two-level: a total for each (source, hash prefix), running totals
of those, then a window inside each prefix, whose depth follows from the row count. Rows
that agree in id, source and all other columns are one row with a number in these windows;
where rows of one id fill a prefix, it is split by row hash. No window holds a whole source.

Defined cases: a null text has size 0 and takes no words; null sources are one source,
last in order; null ids are one id, first by hash of the empty string; rows of one id are
rows of their own, ordered by a hash of their content, and equal rows are interchangeable;
a very long text is one row of its size; an empty table gives an empty one; columns of
whatever name and type are carried along by `arrange`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import broadcast_if_small, row_key
from labelloom.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_REPEATS = 2
# Schedule of each weight class: rate at the start and end of training over its mean.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
ROWS_PER_PREFIX = 20_000
# Equal rows that one task writes out one by one.
EQUAL_ROWS = 10_000


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast(
        "long"
    )


def source_targets(
    totals: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(source, source_size, rows, rank, weight, target) from one row per source.

    With levels sorted by limit over weight, the limited sources are a prefix: the first
    one whose fair part of what is left stays within its limit ends it. This equals
    resharing the excess until no source is above. The table has one row per source, so
    its windows see as many rows as there are sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    level = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("rank")
    )
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rest = F.lit(budget) * F.sum("source_size").over(whole) - F.lit(
        max_repeats
    ) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    limit = F.col("source_size") * max_repeats
    shares = (
        ranked.withColumn("rest", rest)
        .withColumn("left", F.sum("weight").over(onward))
        .withColumn("limited", F.col("weight") * F.col("rest") > limit * F.col("left"))
    )
    # The first source that is not limited fixes the level for itself and all after it.
    first = F.min(
        F.when(~F.col("limited"), F.struct("level_rank", "rest", "left"))
    ).over(whole)
    return (
        shares.withColumn("level_rank", F.row_number().over(level))
        .withColumn("first", first)
        .withColumn(
            "target",
            F.when(
                F.col("first").isNull() | (F.col("level_rank") < F.col("first.level_rank")),
                limit.cast("double"),
            ).otherwise(F.col("weight") * F.col("first.rest") / F.col("first.left")),
        )
        .select("source", "source_size", "rows", "rank", "weight", "target")
    )


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
    rows_per_prefix: int = ROWS_PER_PREFIX,
) -> DataFrame:
    """One row per document: size, its source's size and target, and its positions.

    `copies` is how often the mix takes the document, `taken` the words of all copies,
    `positions` the ascending training positions of the copies in [0, 1].
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size_in_words(F.col(text_col)).alias("size"),
            row_key(docs).alias("row_key"),
        )
        .groupBy("doc_id", "source", "size", "row_key")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-sizes",
    )
    totals = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")
    )
    targets = materialize(
        source_targets(totals, weights=weights, budget=budget, max_repeats=max_repeats),
        "mix-targets",
    )
    sources = targets.count()
    hashed = _in_blocks(rows, rows_per_prefix)
    key = ["source", "prefix", "part"]
    running = (
        Window.partitionBy("source")
        .orderBy("prefix", "part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = materialize(
        hashed.groupBy(*key)
        .agg(F.sum(F.col("size") * F.col("n")).alias("inside"))
        .select(
            F.col("source").alias("of_source"),
            F.col("prefix").alias("of_prefix"),
            F.col("part").alias("of_part"),
            F.coalesce(F.sum("inside").over(running), F.lit(0)).alias("offset"),
        )
        .join(
            broadcast_if_small(
                targets.withColumnRenamed("source", "target_source"), sources
            ),
            F.col("of_source").eqNullSafe(F.col("target_source")),
        ),
        "mix-offsets",
    )
    inside = (
        Window.partitionBy(*key)
        .orderBy("order", F.col("doc_id").asc_nulls_last(), "row_hex", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = hashed.withColumn(
        "start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    ).join(
        broadcast_if_small(offsets),
        F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("prefix") == F.col("of_prefix"))
        & (F.col("part") == F.col("of_part")),
    )
    placed = _every_row(placed)
    start = F.col("start") + F.col("copy") * F.col("size")
    middle = F.col("offset") + start + F.col("size") / 2.0
    middles = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(max_repeats - 1)),
            lambda k: k * F.col("source_size") + middle,
        ),
        lambda c: c < F.col("target"),
    )
    rates = F.get(
        F.array(*[F.struct(F.lit(float(a)), F.lit(float(b))) for a, b in schedules]),
        F.col("rank") % len(schedules),
    )
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.size(middles).alias("copies"),
        (F.col("size") * F.size(middles)).alias("taken"),
        F.transform(
            middles, lambda c: _position(c / F.col("target"), rates["col1"], rates["col2"])
        ).alias("positions"),
        "row_key",
    )


def _in_blocks(rows: DataFrame, rows_per_prefix: int) -> DataFrame:
    """Add the hash order, its prefix, and the part of a prefix that too many rows share.

    Prefixes hold about `rows_per_prefix` rows of different ids. One with over four times
    as many holds rows of one id; its parts follow the order within the prefix, which is
    by hash of the id and then by hash of the row.
    """
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / rows_per_prefix, 16)))
    hashed = rows.withColumns(
        {
            "order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
            "row_hex": F.lpad(F.hex("row_key"), 16, "0"),
            "part": F.lit(""),
        }
    ).withColumn("prefix", F.substring("order", 1, digits))
    full = materialize(
        hashed.groupBy(F.col("source").alias("of"), F.col("prefix").alias("at"))
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > 4 * rows_per_prefix),
        "mix-full",
    )
    most = full.agg(F.max("held")).first()[0]
    if most is None:
        return hashed
    depth = math.ceil(math.log(most / rows_per_prefix, 16))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("prefix") == F.col("at"))
    part = F.concat("order", F.substring("row_hex", 1, depth))
    return (
        hashed.join(broadcast_if_small(full), same, "left")
        .withColumn("part", F.when(F.col("held").isNotNull(), part).otherwise(""))
        .drop("of", "at", "held")
    )


def _every_row(placed: DataFrame) -> DataFrame:
    """One row for each of the `n` equal rows, numbered by `copy`; many are spread first."""
    few = placed.where(F.col("n") <= EQUAL_ROWS)
    last = F.col("n") - 1
    many = (
        placed.where(F.col("n") > EQUAL_ROWS)
        .withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(EQUAL_ROWS))))
        .repartition("source", "doc_id", "from")
        .withColumn("upto", F.least(F.col("from") + (EQUAL_ROWS - 1), last))
        .withColumn("copy", F.explode(F.sequence("from", "upto")))
        .drop("from", "upto")
    )
    each = few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.unionByName(many)


def _position(part: Column, start: Column, end: Column) -> Column:
    """t in [0, 1] at which the integral of a linear rate reaches `part` of its total.

    The rate is a + (b - a) t, scaled to integrate to 1: with a + b = 2 this solves
    a t + (b - a) t^2 / 2 = part, in the form that also holds for a = b.
    """
    a = start * 2 / (start + end)
    b = end * 2 / (start + end)
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) * part, F.lit(0.0)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * part / (a + root)))


def arrange(
    docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", partitions: int | None = None
) -> DataFrame:
    """The documents of the mix, one row per copy, range-sorted by training position.

    `docs` is the frame that was planned: rows are found again by id and content. They keep
    their columns. Equal positions are ordered by id, then by content.
    """
    key = ["__id", "__row"]
    taken = plan.where("copies > 0").select(
        F.col("doc_id").alias("__id"),
        F.col("row_key").alias("__row"),
        F.col("positions").alias("__positions"),
    )
    keyed = docs.withColumn("__key", row_key(docs))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row"))
    repeated = plan.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row"))
    repeated = materialize(
        repeated.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "mix-repeated"
    )
    if not repeated.isEmpty():
        # Of equal rows one meets the positions of all.
        narrow = broadcast_if_small(repeated)
        row = F.first(F.struct(*keyed.columns)).alias("row")
        once = keyed.join(narrow, same, "left_semi").groupBy(id_col, "__key").agg(row)
        keyed = keyed.join(narrow, same, "left_anti").unionByName(once.select("row.*"))
    placed = (
        keyed.join(taken, same)
        .withColumn("__position", F.explode("__positions"))
        .drop(*key, "__positions")
    )
    order = ["__position", id_col, "__key"]
    ranged = (
        placed.repartitionByRange(partitions, *order)
        if partitions
        else placed.repartitionByRange(*order)
    )
    return ranged.sortWithinPartitions(*order).drop("__position", "__key")
