"""Counts, length statistics, histograms, fingerprints and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import preview, word_count

QUANTILES = (0.25, 0.50, 0.75, 0.95)
# Size of a quantile sketch: ranks within 0.6 % of the rows.
SKETCH_K = 800


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def source_pivot(df: DataFrame) -> DataFrame:
    """(source, safe, block), zero where a source lacks a label."""
    return (
        df.groupBy("source")
        .pivot("y", [0, 1])
        .agg(F.count(F.lit(1)))
        .select(
            "source",
            F.coalesce("0", F.lit(0)).alias("safe"),
            F.coalesce("1", F.lit(0)).alias("block"),
        )
    )


def length_counts(df: DataFrame, *by: str, text: str = "prompt") -> DataFrame:
    """Rows per character length: as small as there are distinct lengths."""
    return df.groupBy(*by, F.length(text).alias("length")).agg(F.count("*").alias("n"))


def length_quantiles(
    df: DataFrame,
    *,
    text: str = "prompt",
    quantiles: Sequence[float] = QUANTILES,
) -> DataFrame:
    """One row of exact, linearly interpolated quantiles p25, p50, ..."""
    counts = length_counts(df, text=text)
    values = counts.agg(
        F.percentile("length", list(quantiles), F.col("n")).alias("values")
    )
    return values.select(
        *[
            F.col("values")[i].alias(f"p{round(q * 100)}")
            for i, q in enumerate(quantiles)
        ]
    )


def length_histogram(
    df: DataFrame, *, text: str = "prompt", clip: float = 0.99, bins: int = 50
) -> DataFrame:
    """(y, bin, low, high, n): lengths clipped at a quantile, equal-width bins.

    Every bin has a row, empty ones with n = 0; the last one is closed. Works on the
    per-length counts, not on the rows.
    """
    counts = length_counts(df, "y", text=text)
    limits = counts.groupBy("y").agg(
        F.min("length").cast("double").alias("low"),
        F.percentile("length", clip, F.col("n")).alias("cap"),
    )
    clipped = counts.join(limits, "y").withColumn("x", F.least("length", "cap"))
    top = F.max("x").over(Window.partitionBy("y"))
    spread = clipped.withColumn("top", top).select(
        "y",
        "n",
        "x",
        # A single value gets a bin range of width one around it.
        F.when(F.col("top") == F.col("low"), F.col("low") - 0.5)
        .otherwise(F.col("low"))
        .alias("low"),
        F.when(F.col("top") == F.col("low"), F.col("top") + 0.5)
        .otherwise(F.col("top"))
        .alias("top"),
    )
    width = (F.col("top") - F.col("low")) / bins

    def edge(index: Column) -> Column:
        return F.col("low") + index * width

    guess = F.least(
        F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1)
    )
    # Division can land one bin off at an edge; the edges decide.
    exact = (
        F.when(F.col("x") < edge(F.col("bin")), F.col("bin") - 1)
        .when(
            (F.col("x") >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1),
            F.col("bin") + 1,
        )
        .otherwise(F.col("bin"))
    )
    filled = (
        spread.withColumn("bin", guess)
        .withColumn("bin", exact)
        .groupBy("y", "bin")
        .agg(F.sum("n").alias("n"))
    )
    every = (
        spread.groupBy("y")
        .agg(F.min("low").alias("low"), F.max("top").alias("top"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("bin", F.col("bin").cast("long"))
    )
    same = every["y"].eqNullSafe(filled["y"]) & (every["bin"] == filled["bin"])
    return every.join(filled, same, "left").select(
        every["y"],
        every["bin"],
        edge(every["bin"]).alias("low"),
        edge(every["bin"] + 1).alias("high"),
        F.coalesce(filled["n"], F.lit(0)).alias("n"),
    )


def describe_words(df: DataFrame, *, text: str = "prompt") -> DataFrame:
    """Per label: count, mean, sample deviation, min, quartiles, max of word counts."""
    words = df.select("y", word_count(text).alias("words"))
    quartiles = F.percentile("words", [0.25, 0.5, 0.75])
    return (
        words.groupBy("y")
        .agg(
            F.count("*").alias("count"),
            F.avg("words").alias("mean"),
            F.stddev_samp("words").alias("std"),
            F.min("words").alias("min"),
            quartiles.alias("quartiles"),
            F.max("words").alias("max"),
        )
        .select(
            "y",
            "count",
            "mean",
            "std",
            "min",
            F.col("quartiles")[0].alias("p25"),
            F.col("quartiles")[1].alias("p50"),
            F.col("quartiles")[2].alias("p75"),
            "max",
        )
    )


def length_sketches(
    df: DataFrame, by: Sequence[str] = ("source", "y"), *, text: str = "prompt", k: int = SKETCH_K
) -> DataFrame:
    """(by..., n, sketch): a mergeable quantile sketch (KLL) of the lengths of each group.

    A sketch has a few thousand numbers at most, so it can be stored with the statistics and
    merged with those of other builds. The rank of an estimate is off by no more than
    `sketch_error(k)` of the rows, with a confidence of 99 %; up to k rows it is exact.
    """
    length = F.length(text).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint(length, F.lit(k)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str], *, k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch) over coarser groups, or over the sketches of several builds."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")
    )


def sketch_quantiles(
    sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """(by..., n, p25, p50, ...): estimated lengths, each the length of some row."""
    return sketches.select(
        *by,
        "n",
        *[
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{round(q * 100)}")
            for q in quantiles
        ],
    )


def sketch_error(k: int = SKETCH_K) -> float:
    """Share of rows by which the rank of an estimate may be off, at 99 % confidence."""
    return 2.296 / k**0.9021


FINGERPRINTED = ("prompt", "y", "source", "subtype")


def digests(
    df: DataFrame, by: Sequence[str] = (), *, columns: Sequence[str] = FINGERPRINTED
) -> DataFrame:
    """(by..., n, total, mixed): count, sum and exclusive or of a 60-bit hash per row.

    All three add up over parts of a table and can be taken back, so digests stored with a
    table follow appends and deletions without a scan (see `combined_digests`).
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    word = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(word.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total"),
        F.coalesce(F.bit_xor(word), F.lit(0).cast("bigint")).alias("mixed"),
    )


def combined_digests(
    stored: DataFrame, by: Sequence[str] = (), *, without: DataFrame | None = None
) -> DataFrame:
    """Digests of the union of all given parts, less those of the rows taken away.

    The exclusive or of a part that comes and goes cancels out. Parts that are left with no
    row at all are dropped.
    """
    signed = stored.select(*by, "n", "total", "mixed")
    if without is not None:
        taken = without.select(*by, (-F.col("n")).alias("n"), (-F.col("total")).alias("total"), "mixed")
        signed = signed.unionByName(taken)
    summed = signed.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(38,0)").alias("total"),
        F.coalesce(F.bit_xor("mixed"), F.lit(0).cast("bigint")).alias("mixed"),
    )
    return summed.where((F.col("n") != 0) | (F.col("mixed") != 0)) if by else summed


def fingerprint_of(stored: DataFrame) -> DataFrame:
    """`fingerprint` from digests, of whatever parts."""
    summary = F.concat_ws(
        "|", F.col("n").cast("string"), F.col("total").cast("string"), F.col("mixed").cast("string")
    )
    return combined_digests(stored).select(
        F.substring(F.sha2(summary, 256), 1, 16).alias("content_hash")
    )


def fingerprint(df: DataFrame, *, columns: Sequence[str] = FINGERPRINTED) -> DataFrame:
    """One `content_hash` of 16 hex digits, the same under any row order."""
    return fingerprint_of(digests(df, columns=columns))


def longest(
    df: DataFrame, *, text: str = "prompt", over: int = 3000, n: int = 10
) -> DataFrame:
    """The n longest blocked prompts above a length: a top-k, not a full sort."""
    return (
        df.where(F.col("y") == 1)
        .select("row_id", "source", F.length(text).alias("char_len"))
        .where(F.col("char_len") > over)
        .orderBy(F.desc("char_len"), "row_id")
        .limit(n)
    )


def count_longer(df: DataFrame, *, text: str = "prompt", over: int = 3000) -> DataFrame:
    return df.where((F.col("y") == 1) & (F.length(text) > over)).agg(
        F.count("*").alias("n")
    )


def first_of_source(
    df: DataFrame, source: str, *, text: str = "prompt", n: int = 5, chars: int = 200
) -> DataFrame:
    """Previews of the first n rows of a source by row_id."""
    return (
        df.where(F.col("source") == source)
        .orderBy("row_id")
        .limit(n)
        .select("row_id", "source", preview(text, chars).alias("preview"))
    )


def error_listing(
    scored: DataFrame, *, text: str = "prompt", chars: int = 120
) -> DataFrame:
    """Wrong predictions with label, prediction, rounded score and preview."""
    return scored.where(F.col("y_pred") != F.col("y")).select(
        "row_id",
        "y",
        "y_pred",
        F.bround("y_prob", 3).alias("p"),
        preview(text, chars).alias("preview"),
    )

