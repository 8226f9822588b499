"""Classifier metrics over scored rows (y, y_pred, y_prob [, source, ...]).

Every metric takes `by`, a list of grouping columns, so that models, folds or sources
are scored in one pass. Without it the result is one row.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.ids import double_order_key
from labelloom.operators.joins import broadcast_if_few
from labelloom.session import materialize

FPR_TARGET = 0.05
FNR_TARGET = 0.10
THRESHOLDS = 200  # steps of 0.005 from 0 to 1
# Distinct scores are ranked in ranges of at most this many.
RANGE_ROWS = 20_000
# Bits by which a range with more is cut again.
RANGE_BITS = 4


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; rows with other labels or predictions do not count."""

    def count(y: int, y_pred: int, name: str) -> Column:
        return F.count_if((F.col("y") == y) & (F.col("y_pred") == y_pred)).alias(name)

    return df.groupBy(*by).agg(
        count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn"), count(1, 1, "tp")
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Add f1, precision, recall, accuracy, fpr, fnr; 0 where a divisor is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
            "fpr": _ratio(fp, fp + tn),
            "fnr": _ratio(fn, fn + tp),
        }
    )


def source_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., source, n, f1, fpr, fnr); rows without a source form a group."""
    rates = with_rates(confusion(df, [*by, "source"]))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return rates.select(*by, "source", n.alias("n"), "f1", "fpr", "fnr")


def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., p, pos, neg): rows per distinct score."""
    return df.groupBy(*by, _checked_score().alias("p")).agg(
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
    )


def ranking_metrics(
    df: DataFrame, by: Sequence[str] = (), *, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(by..., auroc, auprc), null when a group has one class only.

    AUROC counts ties half; AUPRC is step-wise average precision. Both need running
    totals by falling score. Scores may be as many as rows, so they are spread over ranges
    of at most `range_rows` scores (see `score_ranges`): range totals are accumulated
    first, then each range runs its own window from its starting total.
    """
    ranged = score_ranges(score_counts(df, by), by, range_rows=range_rows)
    totals = ranged.groupBy(*by, "range").agg(
        F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg")
    )
    higher = Window.partitionBy(*by).orderBy(F.desc("range"))
    group = Window.partitionBy(*by)
    starts = totals.select(
        *by,
        "range",
        (F.sum("range_pos").over(higher) - F.col("range_pos")).alias("pos_before"),
        (F.sum("range_neg").over(higher) - F.col("range_neg")).alias("neg_before"),
        F.sum("range_pos").over(group).alias("all_pos"),
        F.sum("range_neg").over(group).alias("all_neg"),
    )
    within = Window.partitionBy(*by, "range").orderBy(F.desc("p"))
    placed = _equi_join(ranged, starts, [*by, "range"])
    running = placed.withColumn(
        "tp", F.sum("pos").over(within) + F.col("pos_before")
    ).withColumn("fp", F.sum("neg").over(within) + F.col("neg_before"))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    won = F.col("neg") * (tp - F.col("pos") / 2)
    step = F.col("pos") * _ratio(tp, tp + fp)
    pos, neg = F.first("all_pos"), F.first("all_neg")
    both = (pos > 0) & (neg > 0)
    return running.groupBy(*by).agg(
        F.when(both, F.sum(won) / pos / neg).alias("auroc"),
        F.when(both, F.sum(step) / pos).alias("auprc"),
    )


def score_ranges(
    scores: DataFrame, by: Sequence[str] = (), *, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add `range`, rising with `p`, so that no (by..., range) has over `range_rows` rows.

    Scores are cut by prefixes of an integer that orders them as they compare. A range is
    named after the least integer with its prefix. Only heavy prefixes are cut again, by
    `RANGE_BITS` more, so that the table decides how deep it goes where: nothing about the
    distribution comes to the driver, and what is joined is one row per heavy prefix.
    """
    scores = materialize(scores.withColumn("key", double_order_key("p")), "scores")
    # Sign and exponent, and as much of the fraction as even ranges would need.
    bits = 12 + max(0, math.ceil(math.log2(max(1, scores.count()) / range_rows)))

    def start(depth: int) -> Column:
        dropped = 64 - min(depth, 64)
        shifted = F.shiftright("key", dropped)
        return F.shiftleft(shifted, dropped) if dropped else F.col("key")

    settled, waiting = [], scores
    while True:
        cut = waiting.withColumn("range", start(bits))
        sizes = cut.groupBy(*by, "range").agg(F.count("*").alias("n"))
        heavy = materialize(sizes.where(F.col("n") > range_rows).drop("n"), "heavy")
        if bits >= 64 or heavy.isEmpty():
            settled.append(cut)
            break
        heavy = broadcast_if_few(heavy)
        settled.append(_equi_join(cut, heavy, [*by, "range"], "left_anti"))
        waiting = materialize(
            _equi_join(cut, heavy, [*by, "range"], "left_semi").drop("range"), "waiting"
        )
        bits += RANGE_BITS
    return functools.reduce(DataFrame.unionByName, settled).drop("key")


def threshold_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., k, tn, fp, fn, tp) predicting 1 when the score is at least k * 0.005.

    One pass: each row goes to the highest threshold it reaches, and the 201 counts
    are accumulated from the top.
    """
    guess = F.greatest(F.lit(0), F.least(F.floor(F.col("p") / 0.005), F.lit(THRESHOLDS)))
    reached = (
        F.when(_threshold(F.col("guess")) > F.col("p"), F.col("guess") - 1)
        .when(
            (F.col("guess") < THRESHOLDS) & (_threshold(F.col("guess") + 1) <= F.col("p")),
            F.col("guess") + 1,
        )
        .otherwise(F.col("guess"))
    )
    # A score that is not a number reaches no threshold.
    counts = (
        df.select(*by, "y", _checked_score().alias("p"))
        .withColumn("guess", F.when(F.isnan("p"), F.lit(-1)).otherwise(guess.cast("int")))
        .withColumn("k", F.when(F.isnan("p"), F.lit(-1)).otherwise(reached))
        .groupBy(*by, "k")
        .agg(
            F.count_if(F.col("y") == 1).alias("pos"),
            F.count_if(F.col("y") == 0).alias("neg"),
        )
    )
    # Thresholds no row stops at still need a row of their own.
    grid = counts.groupBy(*by).agg(F.count("*")).select(
        *by, F.explode(F.sequence(F.lit(-1), F.lit(THRESHOLDS))).alias("k")
    )
    down = Window.partitionBy(*by).orderBy(F.desc("k"))
    group = Window.partitionBy(*by)
    filled = _equi_join(grid, counts, [*by, "k"], "left").fillna(0, ["pos", "neg"])
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    return filled.select(
        *by,
        "k",
        (F.sum("neg").over(group) - fp).alias("tn"),
        fp.alias("fp"),
        (F.sum("pos").over(group) - tp).alias("fn"),
        tp.alias("tp"),
    ).where("k >= 0")


def threshold_at_fpr(
    df: DataFrame, by: Sequence[str] = (), *, fpr_target: float = FPR_TARGET
) -> DataFrame:
    """(by..., threshold, f1, fnr): the best F1 among thresholds that meet the FPR.

    The lowest threshold wins ties; (0.5, 0, 1) when none has an F1 above 0.
    """
    rates = with_rates(threshold_counts(df, by))
    allowed = (F.col("fpr") <= F.lit(fpr_target)) & (F.col("f1") > 0)
    candidate = F.when(allowed, F.struct("f1", (-F.col("k")).alias("low"), "fnr"))
    best = rates.groupBy(*by).agg(F.max(candidate).alias("best"))
    found = F.col("best").isNotNull()
    return best.select(
        *by,
        F.when(found, _threshold(-F.col("best.low"))).otherwise(0.5).alias("threshold"),
        F.when(found, F.col("best.f1")).otherwise(0.0).alias("f1"),
        F.when(found, F.col("best.fnr")).otherwise(1.0).alias("fnr"),
    )


def binary_report(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    fpr_target: float = FPR_TARGET,
    fnr_target: float = FNR_TARGET,
) -> DataFrame:
    """One nested report row per group; `source_metrics` has the rows per source.

    Labels and scores are written once, as several parts of the report read them: a row is
    scored once, whatever makes its score.
    """
    written = materialize(df.select(*by, "y", "y_pred", "y_prob"), "scored")
    return report_of(written, by, fpr_target=fpr_target, fnr_target=fnr_target)


def report_of(
    written: DataFrame,
    by: Sequence[str] = (),
    *,
    fpr_target: float = FPR_TARGET,
    fnr_target: float = FNR_TARGET,
) -> DataFrame:
    """`binary_report` of scores that are in a table already."""
    counts = with_rates(confusion(written, by))
    ranking = ranking_metrics(written, by)
    best = threshold_at_fpr(written, by, fpr_target=fpr_target).select(
        *by,
        F.struct(
            F.lit(fpr_target).alias("fpr_target"), "threshold", "f1", "fnr"
        ).alias("threshold_at_fpr"),
    )
    report = _equi_join(_equi_join(counts, ranking, by, "left"), best, by, "left")
    return report.select(
        *by,
        "f1",
        "precision",
        "recall",
        "accuracy",
        "fpr",
        "fnr",
        "tp",
        "fp",
        "tn",
        "fn",
        "auroc",
        "auprc",
        "threshold_at_fpr",
        F.struct(
            (F.col("fpr") <= fpr_target).alias("fpr_ok"),
            (F.col("fnr") <= fnr_target).alias("fnr_ok"),
        ).alias("targets_met"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )


def comparison(
    reports: DataFrame, *, models: Sequence[str] | None = None
) -> DataFrame:
    """The latest report of each model, in the given order or by name.

    `reports` is an append-only table with `model` and `run_at`. A model without a
    report is left out; no report at all is an error.
    """
    latest = reports.groupBy("model").agg(
        F.max_by(F.struct(*reports.columns), "run_at").alias("report")
    ).select("report.*")
    if models is not None:
        latest = latest.where(F.col("model").isin(list(models)))
    if latest.isEmpty():
        raise ValueError("no reports to compare")
    order = (
        F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
        if models
        else F.col("model")
    )
    return latest.orderBy(order).select(
        "model",
        "f1",
        "precision",
        "recall",
        "fpr",
        F.col("targets_met.fpr_ok").alias("fpr_ok"),
        "fnr",
        F.col("targets_met.fnr_ok").alias("fnr_ok"),
        "auroc",
    )


def metric_series(
    table: DataFrame, *, fpr_target: float = FPR_TARGET, fnr_target: float = FNR_TARGET
) -> DataFrame:
    """(metric, model, value, target): the comparison as series for a chart."""
    target = F.when(F.col("metric") == "fpr", fpr_target).when(
        F.col("metric") == "fnr", fnr_target
    )
    return (
        table.select("model", "f1", "fpr", "fnr")
        .unpivot("model", ["f1", "fpr", "fnr"], "metric", "value")
        .select("metric", "model", "value", target.alias("target"))
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _threshold(index: Column) -> Column:
    return index * F.lit(0.005)


def _checked_score() -> Column:
    """The score as a double; a missing one is an error, not a silent gap."""
    return F.coalesce(
        F.col("y_prob").cast("double"),
        F.raise_error(F.lit("y_prob is null")).cast("double"),
    )


def _equi_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Null-safe join on `by`; without keys both sides are the one row of a total."""
    keys = list(by)
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_{key}")
    matches = [left[key].eqNullSafe(renamed[f"_{key}"]) for key in keys]
    condition = functools.reduce(Column.__and__, matches, F.lit(True))
    return left.join(renamed, condition, how).drop(*[f"_{key}" for key in keys])
