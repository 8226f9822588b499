"""Scoring text with any model, and embeddings computed once."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import metrics
from labelloom.operators.joins import broadcast_if_few
from labelloom.session import materialize

# Buckets of an embedding cache. They must stay what they were when it was begun.
CACHE_BUCKETS = 64
CACHE_SCHEMA = "content_hash string, run string, embedding array<float>"

PredictFn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
Encoder = Callable[[list[str]], np.ndarray]


def score_text(df: DataFrame, predict: PredictFn, *, text: str = "prompt") -> DataFrame:
    """Add y_pred and y_prob from `predict(texts) -> (labels, probabilities)`.

    Runs per Arrow batch in the tasks; each row keeps its own columns, so nothing is
    aligned by position across batches.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("y_pred", T.IntegerType()),
            T.StructField("y_prob", T.DoubleType()),
        ]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, probabilities = predict(batch[text].tolist())
            yield batch.assign(
                y_pred=np.asarray(labels, dtype=np.int32),
                y_prob=np.asarray(probabilities, dtype=np.float64),
            )

    return df.mapInPandas(score, schema)


def evaluate(
    test: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    model: str,
    reports: str | None = None,
    source_reports: str | None = None,
    log: str | None = None,
    keep: Sequence[str] = (),
    fpr_target: float = metrics.FPR_TARGET,
    fnr_target: float = metrics.FNR_TARGET,
) -> DataFrame:
    """Score the test rows once and report; with `reports`, append to that table too.

    With `source_reports`, the rates per source are appended to that table under the same
    model and time, so that they can be read back without scoring again. What is scored
    is written once, without the text: labels, scores, source and the columns to `keep`.

    With `log`, a run's rows count only once its record stands in that table, which is
    written last: see `committed`.
    """
    scored = score(test)
    columns = ["y", "y_pred", "y_prob", *keep]
    if "source" in scored.columns:
        columns.append("source")
    scored = materialize(scored.select(*dict.fromkeys(columns)), "scored")
    run_id = uuid.uuid4().hex
    run = [
        F.lit(run_id).alias("run_id"),
        F.lit(model).alias("model"),
        F.lit(datetime.now(timezone.utc)).alias("run_at"),
    ]
    if source_reports is not None:
        per_source = metrics.source_metrics(scored).select(*run, "*")
        per_source.write.mode("append").parquet(source_reports)
    report = metrics.report_of(
        scored, fpr_target=fpr_target, fnr_target=fnr_target
    ).select(*run, "*")
    if reports is None:
        return report
    report.write.mode("append").parquet(reports)
    spark = test.sparkSession
    saved = spark.read.parquet(reports).where(F.col("run_id") == run_id)
    if log is not None:
        record = saved.select("run_id", "model", "run_at").coalesce(1)
        record.write.mode("append").parquet(log)
    return saved


def committed(table: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of runs that were finished: whose record is in the log.

    A run that broke off between two of its tables is seen in neither. The log has one row
    for each run and is broadcast while it is small.
    """
    runs = log.select("run_id").distinct()
    return table.join(broadcast_if_few(runs), "run_id", "left_semi")


def latest_source_metrics(source_reports: DataFrame) -> DataFrame:
    """(run_id, model, run_at, source, n, f1, fpr, fnr) of each model's latest run."""
    latest = source_reports.groupBy("model").agg(F.max("run_at").alias("run_at"))
    return source_reports.join(latest, ["model", "run_at"])


def join_scores(test: DataFrame, scores: DataFrame) -> DataFrame:
    """Add y_pred and y_prob computed elsewhere, matched by `row_id`.

    Every test row needs exactly one score: a missing or doubled one fails the job.
    """
    counted = scores.groupBy(F.col("row_id").alias("_of")).agg(
        F.count("*").alias("_n"),
        F.struct(F.max("y_pred").alias("y_pred"), F.max("y_prob").alias("y_prob")).alias("_s"),
    )
    fault = F.concat(
        F.lit("row_id "),
        F.coalesce(F.col("row_id").cast("string"), F.lit("null")),
        F.when(F.col("_n").isNull(), " has no score").otherwise(" has several scores"),
    )
    # Both columns come out of the check, so that pruning one cannot skip it.
    checked = F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.raise_error(fault))
    return (
        test.join(counted, F.col("row_id") == F.col("_of"), "left")
        .withColumn("_s", checked)
        .select(*test.columns, "_s.y_pred", "_s.y_prob")
    )


def content_hash(text: str | Column = "prompt") -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def embed_with_cache(
    df: DataFrame,
    encoder: Encoder,
    *,
    cache: str,
    model: str,
    text: str = "prompt",
    buckets: int = CACHE_BUCKETS,
) -> DataFrame:
    """Add `embedding`; texts already in the cache table are not encoded again.

    The cache is Parquet (content_hash, run, embedding) in a folder for each model, dealt
    into `buckets` by content hash: rows are shuffled to it, and its vectors stay where they
    are. Each missing text is encoded once however many rows carry it; null texts have no
    embedding.
    """
    # Written once: the input is read for the missing texts and for the join.
    keyed = materialize(df.withColumn("content_hash", content_hash(text)), "embed-rows")
    target = f"{cache.rstrip('/')}/model={model}"
    missing = keyed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(
        F.first(text).alias("text")
    )
    known = cached_vectors(df.sparkSession, target, buckets)
    missing = missing.join(known.select("content_hash"), "content_hash", "left_anti")
    run = uuid.uuid4().hex

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encoder(batch["text"].tolist()), dtype=np.float32)
            yield pd.DataFrame(
                {
                    "content_hash": batch["content_hash"],
                    "run": run,
                    "embedding": list(vectors),
                }
            )

    encoded = missing.mapInPandas(encode, CACHE_SCHEMA)
    with _cache_table(df.sparkSession, target, buckets) as table:
        encoded.write.insertInto(table)
    vectors = cached_vectors(df.sparkSession, target, buckets)
    return keyed.join(vectors, "content_hash", "left").drop("content_hash")


def cached_vectors(spark: SparkSession, target: str, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """(content_hash, embedding), one row a text: two runs at a time may both have encoded
    it. Grouped where the buckets lie, without a shuffle."""
    with _cache_table(spark, target, buckets) as table:
        entries = spark.table(table)
    return entries.groupBy("content_hash").agg(F.first("embedding").alias("embedding"))


def compact_cache(
    spark: SparkSession, target: str, into: str, buckets: int = CACHE_BUCKETS
) -> DataFrame:
    """The cache's table rewritten to a new folder: one file a bucket, each text once."""
    with _cache_table(spark, target, buckets) as table:
        entries = spark.table(table)
    once = entries.groupBy("content_hash").agg(
        F.min_by(F.struct("run", "embedding"), "run").alias("entry")
    )
    with _cache_table(spark, into, buckets) as table:
        once.select("content_hash", "entry.*").write.insertInto(table)
    return cached_vectors(spark, into, buckets)


@contextlib.contextmanager
def _cache_table(spark: SparkSession, target: str, buckets: int) -> Iterator[str]:
    """A name for the cache's folder, so that its buckets are known; the folder stays."""
    name = f"cache_{hashlib.md5(target.encode()).hexdigest()}"
    location = target.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (content_hash STRING, run STRING, "
        f"embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (content_hash) "
        f"INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def model_scores(
    df: DataFrame, models: Sequence[str], score: Callable[[str], Column]
) -> DataFrame:
    """(model, row) for several column-expression scorers in one scan."""
    scores = F.array(
        *[F.struct(F.lit(m).alias("model"), score(m).alias("y_prob")) for m in models]
    )
    exploded = df.select("*", F.explode(scores).alias("scored"))
    return exploded.select(*df.columns, "scored.*").withColumn(
        "y_pred", (F.col("y_prob") >= 0.5).cast("int")
    )
