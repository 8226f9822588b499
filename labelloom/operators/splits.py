"""Exact, reproducible splits, folds, balanced samples and simple samples.

All of them order the rows of a stratum by a seeded hash and cut that order at exact
positions. A stratum may hold most of the table, so it is never sorted as a whole:
rows are counted per (stratum, hash prefix), the prefix that contains each cut is
found from the counts, and only that prefix's hashes are ranked. The result is one
cut hash per position, against which each row is compared in place: the text itself
is not shuffled. `row_id` must be unique.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.ids import hash_order, stratum_key
from labelloom.operators.stats import fingerprint
from labelloom.session import materialize

# A hash prefix is made long enough to hold about this many rows.
PREFIX_ROWS = 10_000
_AFTER_ALL = "~"  # sorts after every hex digit


# From (stratum, n) to (stratum, positions): where to cut each stratum's hash order.
Positions = Callable[[DataFrame], DataFrame]


def cut_hashes(
    df: DataFrame, stratum: Column, order: Column, positions: Positions
) -> DataFrame:
    """(stratum, cuts): the hash at each 1-based position, one row per stratum.

    Position 0 cuts before every row; a position past the last row cuts after all.
    The result is written out, so later actions do not rank again.
    """
    keys = materialize(df.select(stratum.alias("stratum"), order.alias("h")), "order")
    largest = keys.groupBy("stratum").count().agg(F.max("count")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, largest) / PREFIX_ROWS, 16)))
    prefix = F.substring("h", 1, digits).alias("prefix")
    counts = keys.groupBy("stratum", prefix).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy("stratum").orderBy("prefix")
    totals = counts.withColumn("upto", F.sum("n").over(in_order))
    wanted = positions(sizes).select(
        "stratum", F.posexplode("positions").alias("part", "position")
    )
    holding = (
        wanted.join(totals, "stratum")
        .where(
            (F.col("position") > F.col("upto") - F.col("n"))
            & (F.col("position") <= F.col("upto"))
        )
        .select(
            "stratum",
            "prefix",
            "part",
            (F.col("position") - F.col("upto") + F.col("n")).alias("nth"),
        )
    )
    within = Window.partitionBy("stratum", "prefix", "part").orderBy("h")
    found = (
        keys.withColumn("prefix", prefix)
        .join(holding, ["stratum", "prefix"])
        .withColumn("place", F.row_number().over(within))
        .where("place = nth")
        .select("stratum", "part", F.col("h").alias("cut"))
    )
    edge = F.when(F.col("position") <= 0, "").otherwise(_AFTER_ALL)
    cuts = (
        wanted.join(found, ["stratum", "part"], "left")
        .groupBy("stratum")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("part", F.coalesce("cut", edge).alias("cut")))
            ).alias("cuts")
        )
        .select("stratum", F.col("cuts.cut").alias("cuts"))
    )
    return materialize(cuts, "cuts")


def assign_parts(
    df: DataFrame, *, stratum: Column, order: Column, positions: Positions, into: str
) -> DataFrame:
    """Add `into`: how many of its stratum's cuts lie before the row."""
    cuts = cut_hashes(df, stratum, order, positions)
    keyed = df.withColumn("_stratum", stratum).withColumn("_h", order)
    part = F.size(F.filter("cuts", lambda cut: cut < F.col("_h")))
    return (
        keyed.join(cuts.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
        .withColumn(into, part)
        .drop("_stratum", "_h", "cuts")
    )


def _take(df: DataFrame, quotas: Positions, stratum: Column, order: Column) -> DataFrame:
    """The first `quota` rows of each stratum in hash order."""

    def positions(sizes: DataFrame) -> DataFrame:
        return quotas(sizes).select("stratum", F.array("quota").alias("positions"))

    parts = assign_parts(
        df, stratum=stratum, order=order, positions=positions, into="_part"
    )
    return parts.where("_part = 0").drop("_part")


def proportional_quotas(sizes: DataFrame, total: Column) -> DataFrame:
    """Shares of `total` by stratum size: floors, then largest fractions, then name."""
    everything = Window.partitionBy()
    # One row per stratum from here on, so the global windows stay small.
    share = F.col("n") * F.col("total") / F.sum("n").over(everything)
    shares = (
        sizes.withColumn("total", total)
        .withColumn("share", share)
        .withColumn("floor", F.floor("share"))
    )
    by_fraction = Window.orderBy(F.desc(F.col("share") - F.col("floor")), "stratum")
    left = F.col("total") - F.sum("floor").over(everything)
    extra = F.when(F.row_number().over(by_fraction) <= left, 1).otherwise(0)
    return shares.withColumn("quota", F.col("floor") + extra).drop(
        "total", "share", "floor"
    )


def split_quotas(sizes: DataFrame, test_frac: float, val_frac: float) -> DataFrame:
    """(stratum, n, n_test, n_val); a stratum of one row cannot be split."""
    everything = Window.partitionBy()
    rows = F.sum("n").over(everything)
    checked = sizes.withColumn(
        "n",
        F.when(
            F.col("n") < 2,
            F.raise_error(
                F.concat(
                    F.lit("a stratum needs two rows or more: "), F.col("stratum")
                )
            ).cast("bigint"),
        ).otherwise(F.col("n")),
    )
    test = proportional_quotas(checked, F.ceil(rows * F.lit(test_frac)))
    rest = test.select(
        "stratum",
        F.col("n").alias("size"),
        F.col("quota").alias("n_test"),
        (F.col("n") - F.col("quota")).alias("n"),
    )
    val = proportional_quotas(rest, F.ceil(rows * F.lit(val_frac / (1 - test_frac))))
    return val.select(
        "stratum", F.col("size").alias("n"), "n_test", F.col("quota").alias("n_val")
    )


def stratified_split(
    df: DataFrame,
    *,
    test_frac: float = 0.15,
    val_frac: float = 0.15,
    seed: int = 42,
    stratum: Column | None = None,
) -> DataFrame:
    """Add `split`: test, val or train, with exact quotas per `{y}_{source}`."""
    stratum = stratum_key() if stratum is None else stratum

    def positions(sizes: DataFrame) -> DataFrame:
        last = F.col("n_test") + F.col("n_val")
        return split_quotas(sizes, test_frac, val_frac).select(
            "stratum", F.array(F.col("n_test"), last).alias("positions")
        )

    parts = assign_parts(
        df,
        stratum=stratum,
        order=hash_order(seed, "split"),
        positions=positions,
        into="_part",
    )
    names = F.array(F.lit("test"), F.lit("val"), F.lit("train"))
    return parts.withColumn("split", names[F.col("_part")]).drop("_part")


def _class_quota(target: Callable[[Column, Column], dict[int, Column]]) -> Positions:
    """Quotas per `{group}_{y}` stratum from the two class sizes of its group."""

    def quotas(sizes: DataFrame) -> DataFrame:
        group = Window.partitionBy(F.regexp_replace("stratum", "_[^_]*$", ""))
        y = F.substring_index("stratum", "_", -1)
        block = F.coalesce(F.sum(F.when(y == "1", F.col("n"))).over(group), F.lit(0))
        safe = F.coalesce(F.sum(F.when(y == "0", F.col("n"))).over(group), F.lit(0))
        targets = target(block, safe)
        # Rows with a label other than 0 and 1 belong to neither class.
        wanted = F.when(y == "1", targets[1]).when(y == "0", targets[0]).otherwise(0)
        return sizes.select("stratum", F.least(F.col("n"), wanted).alias("quota"))

    return quotas


def _balanced(ratio: float):
    def target(block: Column, safe: Column) -> dict[int, Column]:
        both = (F.least(block, safe) * F.lit(float(ratio))).cast("bigint")
        return {0: both, 1: both}

    return target


def _prevalent(block_frac: float):
    def target(block: Column, safe: Column) -> dict[int, Column]:
        total = block + safe
        wanted = F.bround(total * F.lit(float(block_frac))).cast("bigint")
        return {0: total - wanted, 1: wanted}

    return target


def _class_stratum(group: Column) -> Column:
    return F.concat_ws("_", group, F.coalesce(F.col("y").cast("string"), F.lit("null")))


def balance_classes(df: DataFrame, *, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Cut both classes to int(size of the smaller one * ratio)."""
    stratum = _class_stratum(F.lit("all"))
    quotas = _class_quota(_balanced(ratio))
    return _take(df, quotas, stratum, hash_order(seed, "balance"))


def fix_prevalence(
    df: DataFrame, *, block_frac: float = 0.5, seed: int = 42
) -> DataFrame:
    """Aim for `block_frac` blocked rows; a class that is too small keeps all its rows.

    Nothing is oversampled, so a short class lowers the total and moves the fraction.
    """
    stratum = _class_stratum(F.lit("all"))
    quotas = _class_quota(_prevalent(block_frac))
    return _take(df, quotas, stratum, hash_order(seed, "prevalence"))


def achieved_prevalence(df: DataFrame) -> DataFrame:
    """(n, block, block_frac) of the rows really kept."""
    block = F.count_if(F.col("y") == 1)
    return df.agg(
        F.count("*").alias("n"),
        block.alias("block"),
        F.try_divide(block, F.count("*")).alias("block_frac"),
    )


def assign_folds(
    df: DataFrame, *, k: int = 5, seed: int = 42, stratum: Column | None = None
) -> DataFrame:
    """Add `fold` 0..k-1; fold sizes differ by at most one, per stratum and overall."""
    stratum = stratum_key() if stratum is None else stratum
    before = F.sum("n").over(Window.orderBy("stratum")) - F.col("n")

    # Strata laid end to end deal their rows to the folds in turn, so the strata's
    # odd rows spread over all folds.
    def dealt(fold: int) -> Column:
        first = F.pmod(F.lit(fold) - F.col("before"), F.lit(k))
        return F.floor((F.col("n") - first + (k - 1)) / k)

    def positions(sizes: DataFrame) -> DataFrame:
        shares = sizes.withColumn("before", before)
        ends = list(itertools.accumulate(dealt(fold) for fold in range(k - 1)))
        return shares.select("stratum", F.array(*ends).alias("positions"))

    return assign_parts(
        df,
        stratum=stratum,
        order=hash_order(seed, "fold"),
        positions=positions,
        into="fold",
    )


def fold_frames(
    df: DataFrame, fold: int, *, ratio: float = 1.0, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one fold; only the training rows are balanced."""
    train = balance_classes(df.where(F.col("fold") != fold), ratio=ratio, seed=seed)
    return train, df.where(F.col("fold") == fold)


def sample_rows(
    df: DataFrame, *, n: int | None = None, frac: float | None = None, seed: int = 42
) -> DataFrame:
    """Exactly n rows, or round(frac * rows) of them, in seeded hash order."""
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    wanted = F.lit(n) if frac is None else F.bround(F.col("n") * F.lit(float(frac)))

    def quotas(sizes: DataFrame) -> DataFrame:
        quota = F.least(F.col("n"), wanted.cast("bigint"))
        return sizes.select("stratum", quota.alias("quota"))

    return _take(df, quotas, F.lit("all"), hash_order(seed, "sample"))


def sample_strata(
    df: DataFrame, *, frac: float, seed: int = 42, stratum: Column | None = None
) -> DataFrame:
    """A fraction of the table with every stratum in proportion."""
    stratum = stratum_key() if stratum is None else stratum

    def quotas(sizes: DataFrame) -> DataFrame:
        rows = F.sum("n").over(Window.partitionBy())
        return proportional_quotas(sizes, F.bround(rows * F.lit(float(frac))))

    return _take(df, quotas, stratum, hash_order(seed, "subsample"))


def shuffled(df: DataFrame, *, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order, for callers to whom the order matters."""
    return df.orderBy(hash_order(seed, "shuffle"), "row_id")


def split_counts(splits: DataFrame) -> DataFrame:
    """(split, n, block, safe)."""
    return splits.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y") == 1).alias("block"),
        F.count_if(F.col("y") == 0).alias("safe"),
    )


@dataclass(frozen=True)
class SplitSettings:
    test_frac: float = 0.15
    val_frac: float = 0.15
    block_frac: float = 0.5
    ratio: float = 1.0
    seed: int = 42


def make_splits(
    df: DataFrame,
    settings: SplitSettings = SplitSettings(),
    *,
    stratum: Column | None = None,
) -> DataFrame:
    """Stratified split, then train balanced and test brought to its prevalence.

    Both cuts are made in one pass, with the split and the label as the stratum.
    """
    splits = stratified_split(
        df,
        test_frac=settings.test_frac,
        val_frac=settings.val_frac,
        seed=settings.seed,
        stratum=stratum,
    )
    balanced = _class_quota(_balanced(settings.ratio))
    prevalent = _class_quota(_prevalent(settings.block_frac))

    def quotas(sizes: DataFrame) -> DataFrame:
        of_split = F.substring_index("stratum", "_", 1)
        return (
            balanced(sizes.where(of_split == "train"))
            .unionByName(prevalent(sizes.where(of_split == "test")))
            .unionByName(
                sizes.where(of_split == "val").withColumnRenamed("n", "quota")
            )
        )

    purpose = F.when(F.col("split") == "test", "prevalence").otherwise("balance")
    order = hash_order(settings.seed, purpose)
    return _take(splits, quotas, _class_stratum(F.col("split")), order)


def split_manifest(
    df: DataFrame, splits: DataFrame, settings: SplitSettings = SplitSettings()
) -> DataFrame:
    """One row: fingerprint of the input, the settings, and the counts."""

    def count(split: str, y: int | None = None) -> Column:
        chosen = F.col("split") == split
        return F.count_if(chosen if y is None else chosen & (F.col("y") == y))

    counts = splits.agg(
        count("train").alias("train"),
        count("val").alias("val"),
        count("test").alias("test"),
        count("train", 1).alias("train_block"),
        count("train", 0).alias("train_safe"),
        count("test", 1).alias("test_block"),
        count("test", 0).alias("test_safe"),
    )
    return counts.select(
        fingerprint(df).scalar().alias("content_hash"),
        F.lit(settings.seed).alias("seed"),
        F.lit(settings.test_frac).alias("test_frac"),
        F.lit(settings.val_frac).alias("val_frac"),
        F.lit(settings.block_frac).alias("block_frac"),
        F.lit(settings.ratio).alias("ratio"),
        "*",
    )
