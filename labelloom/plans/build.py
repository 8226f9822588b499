"""Raw labelled rows to the unified table, with its statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.ids import with_row_id
from labelloom.functions.text import length_between, normalize_text
from labelloom.operators import similar, stats
from labelloom.operators.dedup import drop_leaked, exact_dedup, with_priority
from labelloom.operators.near_dup import (
    NearDuplicates,
    drop_near_duplicates,
    find_near_duplicates,
)
from labelloom.session import materialize
from labelloom.sources.sinks import write_document, write_table


@dataclass(frozen=True)
class BuildSettings:
    min_prompt_len: int = 5
    max_prompt_len: int = 20000
    threshold: float = 0.8
    num_perm: int = 128
    n_gram: int = 5
    verify: bool = False
    exact: bool = False
    prefer_label: int | None = None


@dataclass(frozen=True)
class BuildResult:
    unified: DataFrame
    funnel: DataFrame
    near: NearDuplicates

    def statistics(self) -> DataFrame:
        """(stage, key, value): the funnel, rows per source and label, quantiles."""
        key = F.concat_ws("/", "source", F.col("y").cast("string"))
        per_source = stats.count_by(self.unified, "source", "y").select(
            F.lit("per_source").alias("stage"), key.alias("key"), "n"
        )
        per_label = stats.count_by(self.unified, "y").select(
            F.lit("per_label").alias("stage"), F.col("y").cast("string").alias("key"), "n"
        )
        quantiles = stats.length_quantiles(self.unified)
        names = quantiles.columns
        lengths = quantiles.select(F.lit(1).alias("one"), "*").unpivot(
            "one", names, "key", "n"
        ).select(F.lit("length_quantiles").alias("stage"), "key", "n")
        rows = self.funnel.select("stage", F.lit("rows").alias("key"), F.col("n").alias("n"))
        parts = [rows, per_source, per_label, lengths]
        result = parts[0].withColumn("n", F.col("n").cast("double"))
        for part in parts[1:]:
            result = result.unionByName(part.withColumn("n", F.col("n").cast("double")))
        return result.withColumnRenamed("n", "value")


def normalized(
    raw: DataFrame, *, min_len: int = 5, max_len: int = 20000
) -> DataFrame:
    """Rows with `prompt_norm` of an allowed length."""
    named = with_row_id(raw).withColumn("prompt_norm", normalize_text("prompt"))
    return named.where(length_between("prompt_norm", min_len, max_len))


def deduplicated(
    raw: DataFrame, settings: BuildSettings = BuildSettings(), *, prompt: bool = True
) -> DataFrame:
    """Normalised rows, one per text, with `priority` and the group size `copies`.

    Without `prompt`, the text as it came is left out once it is normalised.
    """
    kept = normalized(
        raw, min_len=settings.min_prompt_len, max_len=settings.max_prompt_len
    )
    if not prompt:
        kept = kept.drop("prompt")
    # Written once: who stays is decided on hashes, and the rows are found again by them.
    kept = materialize(kept, "normalized")
    prioritised = with_priority(kept, prefer_label=settings.prefer_label)
    return exact_dedup(prioritised, copies="copies")


def build_dataset(raw: DataFrame, settings: BuildSettings = BuildSettings()) -> BuildResult:
    """Normalise, filter, drop exact and near duplicates, check for leaks.

    The text is shuffled once at most, by the exact dedup, whose result is written to the
    shared folder; near duplicates are decided on narrow rows.
    """
    exact = similar.numbered(deduplicated(raw, settings), "exact")
    near = find_near_duplicates(
        exact,
        threshold=settings.threshold,
        num_perm=settings.num_perm,
        n_gram=settings.n_gram,
        verify=settings.verify,
        exact=settings.exact,
    )
    distinct = materialize(drop_near_duplicates(exact, near), "distinct")
    unified = drop_leaked(distinct).drop(
        "prompt_norm", "priority", "copies", similar.NUMBER
    )
    # Written once: the statistics and the saved table both read it.
    unified = materialize(unified, "unified")
    return BuildResult(unified, stage_funnel(raw, exact, distinct, unified), near)


def stage_funnel(
    raw: DataFrame, exact: DataFrame, distinct: DataFrame, unified: DataFrame
) -> DataFrame:
    """(position, stage, n): rows in, rows each stage drops, rows out.

    Each count reads the narrowest table that knows it; no text is normalised again.
    """
    counts = (
        raw.agg(F.count("*").alias("raw"))
        .select(
            "raw",
            exact.agg(
                F.struct(
                    F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
                    F.count("*").alias("texts"),
                )
            )
            .scalar()
            .alias("exact"),
            distinct.agg(F.count("*")).scalar().alias("distinct"),
            unified.agg(F.count("*")).scalar().alias("unified"),
        )
    )
    texts = F.col("exact.texts")
    stages = [
        ("raw_total", F.col("raw")),
        ("dropped_length", F.col("raw") - F.col("exact.rows")),
        ("dropped_exact_dedup", F.col("exact.rows") - texts),
        ("dropped_minhash_dedup", texts - F.col("distinct")),
        ("dropped_leak_check", F.col("distinct") - F.col("unified")),
        ("total_after_dedup", F.col("unified")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), n.alias("n"))
            for i, (name, n) in enumerate(stages)
        ]
    )
    return counts.select(F.inline(rows))


def save_build(
    result: BuildResult,
    unified_path: str,
    statistics_path: str,
    *,
    sketches_path: str | None = None,
    digests_path: str | None = None,
) -> None:
    """Write the table and its statistics, and what later builds merge with.

    Sketches are per source and label, digests per source; both tables are appended to, so
    that they describe the union of all builds that wrote to them.
    """
    write_table(result.unified, unified_path)
    write_document(result.statistics(), statistics_path)
    if sketches_path is not None:
        write_table(stats.length_sketches(result.unified), sketches_path, mode="append")
    if digests_path is not None:
        write_table(stats.digests(result.unified, ["source"]), digests_path, mode="append")
