"""One query per operator of the inventory, over the whole test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.ids import stratum_key
from labelloom.functions.minhash import minhash_signature
from labelloom.functions.text import (
    char_length,
    char_ngrams,
    head_tokens,
    normalize_text,
    preview,
    subtype_priority,
    word_count,
)
from labelloom.operators import (
    dedup,
    metrics,
    models,
    near_dup,
    scoring,
    similar,
    splits,
    stats,
)
from labelloom.plans.build import build_dataset, deduplicated, normalized
from labelloom.plans.split import save_splits
from labelloom.session import materialize, scratch_path
from labelloom.sources.loaders import (
    LoadResult,
    constant_source,
    filtered_source,
    label_mapped_source,
    load_all,
    taxonomy_source,
)
from labelloom.sources.sinks import as_json, read_table, write_document, write_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
# How far each model's score is pulled from noise towards the label.
MODELS = {"m1": 0.0, "m2": 0.25, "m3": 0.5, "m4": 0.75}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# Inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _labelled_documents(
    spark: SparkSession, sf_dir: str, *, spread: bool = False
) -> DataFrame:
    """Documents as a label-mapped source: toxic is y=1, unlabelled counts as benign."""
    labels = _table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "jailbreak").otherwise("Benign")
    documents = read_table(spark, f"{sf_dir}/documents.parquet", spread=spread)
    return label_mapped_source(
        documents.join(labels, "doc_id", "left").withColumn("type", kind),
        source=F.col("source"),
        text="text",
        row_id="doc_id",
    )


def _exact(spark: SparkSession, sf_dir: str, *, prompt: bool = False) -> DataFrame:
    """One row per text, in most queries without the text as it came."""
    return deduplicated(_labelled_documents(spark, sf_dir, spread=True), prompt=prompt)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the scores of four reproducible models."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    rows = (
        _table(spark, sf_dir, "documents")
        .join(labels, "doc_id")
        .withColumnsRenamed({"doc_id": "row_id", "text": "prompt"})
        .select("row_id", "y", "source", "prompt")
    )
    return scoring.model_scores(rows, list(MODELS), _hash_score)


def _hash_score(model: str) -> Column:
    return F.floor(_whole_score(model, 6) * 1000) / 1000.0


def _whole_score(model: str, digits: int = 13) -> Column:
    """Noise of so many hexadecimal digits, pulled towards the label."""
    digest = F.md5(F.concat_ws("|", F.lit(model), F.col("row_id").cast("string")))
    noise = F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / 16.0**digits
    pull = MODELS[model]
    return (noise + pull * F.col("y")) / (1.0 + pull)


def _sources(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> LoadResult:
    """Every source shape, plus one that is missing."""

    def table(name: str) -> DataFrame:
        heavy = spread and name == "documents"
        return read_table(spark, f"{sf_dir}/{name}.parquet", spread=heavy)

    def ids(prefix: str, *columns: str) -> Column:
        return F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") for c in columns])

    def labelled() -> DataFrame:
        kind = F.when(F.col("toxic") == 1, "Toxic").otherwise("BENIGN")
        rows = table("documents").join(table("labels"), "doc_id")
        return label_mapped_source(
            rows.withColumn("type", kind),
            source="labelled",
            text="text",
            row_id=ids("doc", "doc_id"),
        )

    def unlabelled() -> DataFrame:
        rows = table("documents").join(table("labels"), "doc_id", "left_anti")
        return constant_source(
            rows,
            y=0,
            source="unlabelled",
            subtype="safe",
            candidates=("prompt", "instruction", "input", "text"),
            row_id=ids("doc", "doc_id"),
        )

    return load_all(
        spark,
        {
            "benchmark": lambda: constant_source(
                table("benchmark"),
                y=1,
                source="benchmark",
                subtype="harmful",
                candidates=("prompt", "goal", "text"),
                row_id=ids("item", "item_id"),
            ),
            "labelled": labelled,
            "unlabelled": unlabelled,
            "turns": lambda: filtered_source(
                table("conversations"),
                source="turns",
                column="role",
                value="user",
                candidates=("redteam_query", "text"),
                row_id=ids("turn", "conv_id", "turn"),
            ),
            "languages": lambda: taxonomy_source(
                table("documents"),
                source="languages",
                candidates=("prompt", "text"),
                taxonomy=("category", "lang"),
                row_id=ids("lang", "doc_id"),
            ),
            "absent": lambda: constant_source(
                table("no_such_table"), y=1, source="absent", subtype="harmful"
            ),
        },
    )


# Sources and text functions


@_query
def load_all_counts(spark, sf_dir):
    return stats.count_by(_sources(spark, sf_dir).table, "source", "y", "subtype")


@_query
def load_status(spark, sf_dir):
    loaded = _sources(spark, sf_dir)
    return (
        loaded.status.select("source", "status")
        .join(loaded.counts(), "source", "left")
        .fillna(0, ["n"])
    )


@_query
def load_staged_status(spark, sf_dir):
    """A source that breaks off while it is read: reported and left out, others whole."""
    documents = _table(spark, sf_dir, "documents")
    last = documents.agg(F.max("doc_id")).first()[0]
    broken = F.when(F.col("doc_id") < last, F.col("text")).otherwise(
        F.raise_error(F.lit("the rest of the file cannot be read"))
    )

    def source(name: str, text: Column) -> Callable[[], DataFrame]:
        rows = documents.withColumn("text", text)
        return lambda: constant_source(
            rows, y=0, source=name, subtype="safe", candidates=("text",), row_id="doc_id"
        )

    loaded = load_all(
        spark,
        {"whole": source("whole", F.col("text")), "broken": source("broken", broken)},
        staged=True,
    )
    return (
        loaded.status.select("source", "status")
        .join(loaded.counts(), "source", "left")
        .fillna(0, ["n"])
    )


@_query
def normalized_texts(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    norm = documents.select("doc_id", "text", normalize_text("text").alias("norm"))
    return norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("norm_hash"),
        char_length("norm").alias("norm_length"),
        char_length("text").alias("raw_length"),
    )


@_query
def text_measures(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        word_count("text").alias("words"),
        preview("text", 120).alias("preview"),
        F.sha2(head_tokens("text", 512), 256).alias("head_hash"),
    )


@_query
def ngram_counts(spark, sf_dir):
    grams = _table(spark, sf_dir, "documents").select(
        "doc_id", char_ngrams("text", 5).alias("grams")
    )
    return grams.select(
        "doc_id",
        F.size("grams").alias("n_grams"),
        F.md5(F.array_join("grams", "|")).alias("grams_md5"),
    )


@_query
def subtype_priorities(spark, sf_dir):
    rows = _sources(spark, sf_dir).table
    return rows.groupBy("subtype", subtype_priority("subtype").alias("priority")).agg(
        F.count("*").alias("n")
    )


# Deduplication and leaks


@_query
def unify_counts(spark, sf_dir):
    return stats.count_by(_exact(spark, sf_dir), "source", "y")


@_query
def exact_dedup_rows(spark, sf_dir):
    kept = _exact(spark, sf_dir)
    return kept.select("row_id", "y", "subtype", "copies")


@_query
def exact_dedup_all_sources(spark, sf_dir):
    kept = deduplicated(_sources(spark, sf_dir, spread=True).table)
    return kept.select("row_id", "source", "y", "subtype", "copies")


@_query
def exact_dedup_prefer_label(spark, sf_dir):
    rows = materialize(normalized(_sources(spark, sf_dir, spread=True).table), "normalized")
    kept = dedup.exact_dedup(dedup.with_priority(rows, prefer_label=1))
    return kept.select("row_id", "source", "y", "subtype")


@_query
def leak_rows(spark, sf_dir):
    rows = materialize(normalized(_sources(spark, sf_dir, spread=True).table), "normalized")
    return dedup.leaked_rows(rows).select("row_id", "source", "subtype")


@_query
def leak_free_counts(spark, sf_dir):
    rows = materialize(normalized(_sources(spark, sf_dir, spread=True).table), "normalized")
    return stats.count_by(dedup.drop_leaked(rows), "source", "y")


@_query
def minhash_signatures(spark, sf_dir):
    rows = normalized(_labelled_documents(spark, sf_dir, spread=True))
    signed = rows.select("row_id", minhash_signature("prompt_norm").alias("signature"))
    return signed.select("row_id", F.array_join("signature", ",").alias("signature"))


@_query
def lsh_first_neighbours(spark, sf_dir):
    exact = _exact(spark, sf_dir)
    met = near_dup.first_neighbours(near_dup.row_buckets(exact))
    return met.select(
        F.col("rank.row_id").alias("row_id"),
        F.col("neighbour.row_id").alias("neighbour_id"),
        "shared",
    )


@_query
def near_dup_keep(spark, sf_dir):
    exact = materialize(_exact(spark, sf_dir), "exact")
    found = near_dup.find_near_duplicates(exact)
    return near_dup.drop_near_duplicates(exact, found).select("row_id", "source", "y")


@_query
def near_dup_keep_verified(spark, sf_dir):
    exact = similar.numbered(_exact(spark, sf_dir), "exact")
    found = near_dup.find_near_duplicates(exact, verify=True)
    return near_dup.drop_near_duplicates(exact, found).select("row_id", "source", "y")


@_query
def similar_keep(spark, sf_dir):
    """The keep rule over all similar rows, whether or not they share a band."""
    exact = similar.numbered(_exact(spark, sf_dir), "exact")
    found = near_dup.find_near_duplicates(exact, exact=True)
    return near_dup.drop_near_duplicates(exact, found).select("row_id", "source", "y")


@_query
def near_dup_listing(spark, sf_dir):
    exact = materialize(_exact(spark, sf_dir), "exact")
    found = near_dup.find_near_duplicates(exact)
    listed = near_dup.with_jaccard(materialize(found.listing(), "listing"), exact)
    return listed.withColumn("jaccard", F.round("jaccard", 6))


@_query
def stage_funnel(spark, sf_dir):
    return build_dataset(_labelled_documents(spark, sf_dir, spread=True)).funnel


@_query
def build_statistics(spark, sf_dir):
    built = build_dataset(_labelled_documents(spark, sf_dir, spread=True))
    return built.statistics().withColumn("value", F.round("value", 6))


# Statistics


@_query
def label_counts(spark, sf_dir):
    return stats.count_by(_labelled_documents(spark, sf_dir), "y")


@_query
def source_pivot(spark, sf_dir):
    return stats.source_pivot(_labelled_documents(spark, sf_dir))


@_query
def length_quantiles(spark, sf_dir):
    quantiles = stats.length_quantiles(_exact(spark, sf_dir, prompt=True))
    return quantiles.select(*[F.round(c, 6).alias(c) for c in quantiles.columns])


@_query
def length_sketches(spark, sf_dir):
    """Sketches of two builds, merged: are their estimates as near as they claim to be?"""
    rows = _labelled_documents(spark, sf_dir).withColumn("length", F.length("prompt"))
    half = F.pmod(F.xxhash64("row_id"), F.lit(2))
    path = scratch_path(spark, "sketches")
    for build in range(2):
        sketches = stats.length_sketches(rows.where(half == build))
        write_table(sketches, path, mode="append")
    merged = stats.merge_sketches(read_table(spark, path), ["source", "y"])
    estimates = stats.sketch_quantiles(merged, ["source", "y"])
    names = estimates.columns[3:]
    met = rows.select("source", "y", "length").join(estimates, ["source", "y"])
    ranks = [
        (F.avg((F.col("length") < F.col(c)).cast("double")), F.avg((F.col("length") <= F.col(c)).cast("double")))
        for c in names
    ]
    # Where quantiles fall between two rows, either is right.
    slack = F.lit(stats.sketch_error()) + 1 / F.count("*")
    near = functools.reduce(
        Column.__and__,
        [
            (below <= q + slack) & (upto >= q - slack)
            for q, (below, upto) in zip(stats.QUANTILES, ranks)
        ],
    )
    return met.groupBy("source", "y").agg(F.first("n").alias("n"), near.alias("near"))


@_query
def length_histogram(spark, sf_dir):
    bins = stats.length_histogram(_labelled_documents(spark, sf_dir))
    return bins.select(
        "y", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"
    )


@_query
def word_describe(spark, sf_dir):
    described = stats.describe_words(_labelled_documents(spark, sf_dir))
    return described.withColumns(
        {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    )


@_query
def content_fingerprint(spark, sf_dir):
    return stats.fingerprint(_labelled_documents(spark, sf_dir))


@_query
def stored_digests(spark, sf_dir):
    """The fingerprint from digests per source that followed an append and a deletion."""
    rows = _labelled_documents(spark, sf_dir)
    late = F.pmod(F.col("row_id").cast("bigint"), F.lit(10)) == 3
    stored = stats.digests(rows.where(~late), ["source"])
    stored = stats.combined_digests(
        stored.unionByName(stats.digests(rows.where(late), ["source"])), ["source"]
    )
    gone = stats.digests(rows.where("source = 'src3'"), ["source"])
    left = stats.combined_digests(stored, ["source"], without=gone)
    return stats.fingerprint_of(left)


@_query
def top_long(spark, sf_dir):
    return stats.longest(_labelled_documents(spark, sf_dir))


@_query
def long_count(spark, sf_dir):
    return stats.count_longer(_labelled_documents(spark, sf_dir))


@_query
def source_preview(spark, sf_dir):
    return stats.first_of_source(_labelled_documents(spark, sf_dir), "src3")


# Splits and samples


@_query
def split_assign(spark, sf_dir):
    rows = _labelled_documents(spark, sf_dir)
    return splits.stratified_split(rows, stratum=F.col("y").cast("string")).select(
        "row_id", "y", "split"
    )


@_query
def split_by_source(spark, sf_dir):
    rows = materialize(_sources(spark, sf_dir).table, "unified")
    return splits.stratified_split(rows).select(
        "row_id", stratum_key().alias("stratum"), "split"
    )


@_query
def split_counts(spark, sf_dir):
    rows = materialize(_sources(spark, sf_dir).table, "unified")
    return splits.split_counts(splits.make_splits(rows))


@_query
def split_manifest(spark, sf_dir):
    rows = materialize(_sources(spark, sf_dir).table, "unified")
    return splits.split_manifest(rows, splits.make_splits(rows))


@_query
def balanced_rows(spark, sf_dir):
    return splits.balance_classes(_labelled_documents(spark, sf_dir), ratio=1.0).select(
        "row_id", "y"
    )


@_query
def prevalence_rows(spark, sf_dir):
    rows = splits.fix_prevalence(_labelled_documents(spark, sf_dir), block_frac=0.02)
    return rows.select("row_id", "y")


@_query
def prevalence_achieved(spark, sf_dir):
    rows = splits.fix_prevalence(_labelled_documents(spark, sf_dir), block_frac=0.5)
    achieved = splits.achieved_prevalence(rows)
    return achieved.withColumn("block_frac", F.round("block_frac", 6))


@_query
def fold_assign(spark, sf_dir):
    return splits.assign_folds(_labelled_documents(spark, sf_dir), k=5).select(
        "row_id", stratum_key().alias("stratum"), "fold"
    )


@_query
def fold_train_balanced(spark, sf_dir):
    """Sizes of the balanced training rows and the validation rows of every fold."""
    folded = materialize(
        splits.assign_folds(_labelled_documents(spark, sf_dir).drop("prompt"), k=5), "folded"
    )
    parts = []
    for fold in range(5):
        train, held_out = splits.fold_frames(folded, fold)
        parts += [
            part.select(F.lit(fold).alias("of_fold"), F.lit(name).alias("part"), "y")
            for name, part in (("train", train), ("validation", held_out))
        ]
    return stats.count_by(functools.reduce(DataFrame.unionAll, parts), "of_fold", "part", "y")


@_query
def sample_n(spark, sf_dir):
    return splits.sample_rows(_labelled_documents(spark, sf_dir), n=50, seed=7).select(
        "row_id", "source"
    )


@_query
def sample_fraction(spark, sf_dir):
    return splits.sample_rows(_labelled_documents(spark, sf_dir), frac=0.10).select(
        "row_id", "source"
    )


@_query
def cv_subsample(spark, sf_dir):
    return splits.sample_strata(_labelled_documents(spark, sf_dir), frac=0.15).select(
        "row_id", stratum_key().alias("stratum")
    )


@_query
def shuffled_rows(spark, sf_dir):
    return splits.shuffled(_labelled_documents(spark, sf_dir)).select("row_id", "y")


# Metrics


@_query
def confusion_counts(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), ["model"])


@_query
def rate_metrics(spark, sf_dir):
    rates = metrics.with_rates(metrics.confusion(_scored(spark, sf_dir), ["model"]))
    names = ("f1", "precision", "recall", "accuracy", "fpr", "fnr")
    return rates.select("model", *_rounded(*names))


@_query
def ranking_by_model(spark, sf_dir):
    ranked = metrics.ranking_metrics(_scored(spark, sf_dir), ["model"])
    return ranked.select("model", *_rounded("auroc", "auprc"))


@_query
def ranking_exact_scores(spark, sf_dir):
    """Scores that are not rounded, of all documents, so that many ranges are crossed."""
    rows = _labelled_documents(spark, sf_dir).select("row_id", "y")
    scored = scoring.model_scores(rows, list(MODELS), _whole_score)
    ranked = metrics.ranking_metrics(scored, ["model"], range_rows=200)
    return ranked.select("model", *_rounded("auroc", "auprc"))


@_query
def threshold_scan(spark, sf_dir):
    best = metrics.threshold_at_fpr(_scored(spark, sf_dir), ["model"])
    return best.select("model", *_rounded("threshold", "f1", "fnr"))


@_query
def threshold_table(spark, sf_dir):
    return metrics.threshold_counts(_scored(spark, sf_dir), ["model"])


@_query
def per_source_by_model(spark, sf_dir):
    rows = metrics.source_metrics(_scored(spark, sf_dir), ["model"])
    return rows.select("model", "source", "n", *_rounded("f1", "fpr", "fnr"))


@_query
def report(spark, sf_dir):
    made = metrics.binary_report(_scored(spark, sf_dir), ["model"])
    return made.select(
        "model",
        *_rounded("f1", "precision", "recall", "accuracy", "fpr", "fnr", "auroc", "auprc"),
        "tp",
        "fp",
        "tn",
        "fn",
        F.round("threshold_at_fpr.threshold", 6).alias("threshold"),
        F.col("targets_met.fpr_ok").alias("fpr_ok"),
        F.col("targets_met.fnr_ok").alias("fnr_ok"),
    )


@_query
def model_comparison(spark, sf_dir):
    return _compared(spark, sf_dir).withColumns(
        {c: F.round(c, 6) for c in ("f1", "precision", "recall", "fpr", "fnr", "auroc")}
    )


@_query
def comparison_series(spark, sf_dir):
    series = metrics.metric_series(_compared(spark, sf_dir))
    return series.withColumn("value", F.round("value", 6))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison over an append-only reports table: the first of two runs per model
    predicts the opposite, and only the second may count."""
    path = scratch_path(spark, "reports")
    scored = _scored(spark, sf_dir)
    opposite = scored.withColumn("y_pred", 1 - F.col("y_pred"))
    for run_at, rows in (("2024-01-02", scored), ("2024-01-01", opposite)):
        made = metrics.binary_report(rows, ["model"])
        write_table(made.withColumn("run_at", F.lit(run_at)), path, mode="append")
    reports = read_table(spark, path)
    return metrics.comparison(reports, models=["m4", "m3", "m2", "m1", "m0"])


@_query
def error_rows(spark, sf_dir):
    scored = _scored(spark, sf_dir).where("model = 'm3'")
    return stats.error_listing(splits.sample_rows(scored, n=50, seed=7))


@_query
def scored_texts(spark, sf_dir):
    def predict(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        probability = np.array([len(text) % 97 / 96 for text in texts])
        return (probability >= 0.5).astype(int), probability

    rows = _labelled_documents(spark, sf_dir)
    scored = scoring.score_text(rows.select("row_id", "y", "prompt"), predict)
    return scored.select("row_id", "y", "y_pred", F.round("y_prob", 6).alias("y_prob"))


@_query
def evaluate_scorer(spark, sf_dir):
    def score(test: DataFrame) -> DataFrame:
        probability = (F.length("prompt") % 97) / 96
        return test.withColumn("y_prob", probability).withColumn(
            "y_pred", (probability >= 0.5).cast("int")
        )

    reported = scoring.evaluate(
        _labelled_documents(spark, sf_dir),
        score,
        model="length",
        reports=scratch_path(spark, "reports"),
    )
    return reported.select("model", "tp", "fp", "tn", "fn", *_rounded("f1", "auroc"))


@_query
def report_documents(spark, sf_dir):
    made = metrics.confusion(_scored(spark, sf_dir), ["model"])
    return as_json(made.select("model", "tn", "fp", "fn", "tp"))


def _rounded(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


# Features and models


@_query
def tfidf_terms(spark, sf_dir):
    terms = models.term_statistics(_labelled_documents(spark, sf_dir, spread=True))
    return terms.withColumn("idf", F.round("idf", 6))


def _length_score(rows: DataFrame) -> DataFrame:
    probability = (F.length("prompt") % 97) / 96
    return rows.withColumn("y_prob", probability).withColumn(
        "y_pred", (probability >= 0.5).cast("int")
    )


@_query
def stored_source_metrics(spark, sf_dir):
    """The rates per source that an evaluation stored, read back without scoring."""
    path = scratch_path(spark, "source-reports")
    rows = _labelled_documents(spark, sf_dir)
    for part in (rows.where("y = 1"), rows):  # the second run is the latest
        scoring.evaluate(
            part,
            _length_score,
            model="length",
            reports=scratch_path(spark, "reports"),
            source_reports=path,
        )
    latest = scoring.latest_source_metrics(spark.read.parquet(path))
    return latest.select("model", "source", "n", *_rounded("f1", "fpr", "fnr"))


@_query
def committed_runs(spark, sf_dir):
    """Reports and rates per source of finished runs only; a run that broke off between
    its two tables has left rows in one of them."""
    reports, rates, log = (scratch_path(spark, n) for n in ("reports", "rates", "log"))
    rows = _labelled_documents(spark, sf_dir)
    scoring.evaluate(
        rows, _length_score, model="length", reports=reports, source_reports=rates, log=log
    )
    broken_off = spark.read.parquet(rates).withColumn("run_id", F.lit("unfinished"))
    write_table(materialize(broken_off, "broken-off"), rates, mode="append")
    finished = spark.read.parquet(log)
    totals = scoring.committed(spark.read.parquet(rates), finished).groupBy("run_id").agg(
        F.sum("n").alias("rows"), F.count("*").alias("sources")
    )
    return scoring.committed(spark.read.parquet(reports), finished).join(
        totals, "run_id"
    ).select("model", "tp", "fp", "tn", "fn", "rows", "sources")


@_query
def external_scores(spark, sf_dir):
    """Scores made elsewhere, matched to the test rows by id, and their report."""
    rows = _labelled_documents(spark, sf_dir)
    scores = _length_score(rows).select("row_id", "y_pred", "y_prob")
    joined = scoring.join_scores(rows.drop("prompt"), scores)
    return metrics.with_rates(metrics.confusion(joined)).select(
        "tn", "fp", "fn", "tp", *_rounded("f1", "accuracy")
    )


@_query
def saved_splits_manifest(spark, sf_dir):
    """The manifest and the counts of splits that were saved, both read back."""
    rows = materialize(_sources(spark, sf_dir).table, "unified")
    splits_path, manifest = scratch_path(spark, "splits"), scratch_path(spark, "manifest")
    for _ in range(2):  # the second call finds them built
        saved = save_splits(rows, splits_path, manifest)
    written = spark.read.json(manifest).select("content_hash", "train", "val", "test")
    counts = saved.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    return written.join(counts)


@_query
def report_files(spark, sf_dir):
    """One JSON document per model in a file, read back."""
    path = scratch_path(spark, "documents")
    write_document(metrics.confusion(_scored(spark, sf_dir), ["model"]), path)
    return spark.read.json(path).select("model", "tn", "fp", "fn", "tp")


@_query
def embed_cache(spark, sf_dir):
    """Encode half of the rows first, then all: the second run reuses the cache."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array(
            [[len(t), t.count(" "), t.count("e")] for t in texts], dtype=np.float32
        )

    cache = scratch_path(spark, "embeddings")
    rows = _labelled_documents(spark, sf_dir).select("row_id", "y", "prompt")
    for part in (rows.where("y = 1"), rows):
        embedded = scoring.embed_with_cache(part, encode, cache=cache, model="counts")
    return embedded.select(
        "row_id",
        *[
            F.col("embedding")[i].cast("bigint").alias(name)
            for i, name in enumerate(("chars", "spaces", "letter_e"))
        ],
    )


@_query
def embed_reuse(spark, sf_dir):
    """Texts that each of three runs had to encode: the first, all of them, and all again."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[len(t)] for t in texts], dtype=np.float32)

    cache = scratch_path(spark, "embeddings")
    rows = _labelled_documents(spark, sf_dir).select("row_id", "y", "prompt")
    runs = []
    for number, part in enumerate((rows.where("y = 1"), rows, rows), 1):
        scoring.embed_with_cache(part, encode, cache=cache, model="length")
        entries = spark.read.parquet(f"{cache}/model=length")
        upto = entries.agg(F.lit(number).alias("run"), F.count("*").alias("upto"))
        runs.append(materialize(upto, "upto"))
    totals = functools.reduce(DataFrame.unionAll, runs)
    before = totals.select((F.col("run") + 1).alias("run"), F.col("upto").alias("known"))
    return totals.join(before, "run", "left").select(
        "run", (F.col("upto") - F.coalesce("known", F.lit(0))).alias("encoded")
    )


@_query
def class_weights(spark, sf_dir):
    weighted = models.with_balanced_weights(_labelled_documents(spark, sf_dir))
    return weighted.groupBy("y").agg(F.round(F.max("weight"), 6).alias("weight"))


@_query
def tfidf_lr(spark, sf_dir):
    rows = _labelled_documents(spark, sf_dir, spread=True)
    made = splits.make_splits(rows, stratum=F.col("y").cast("string"))
    made = materialize(made, "splits")
    model = models.fit_tfidf_classifier(made.where("split = 'train'"))
    return metrics.binary_report(model.score(made.where("split = 'test'")))


@_query
def tfidf_vectors(spark, sf_dir):
    """The entries of the vectors that the model reads, with a limit that binds."""
    rows = _labelled_documents(spark, sf_dir, spread=True)
    features = models.fit_text_features(rows, models.TfidfSettings(max_features=2000))
    return features.weights(rows).withColumn("weight", F.round("weight", 6))


@_query
def logistic_saturated(spark, sf_dir):
    """One indicator for each language and no penalty to speak of: the fitted chance is the
    weighted share of toxic documents. The rows of a language train as two rows."""
    rows = _table(spark, sf_dir, "documents").join(
        _table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    rows = rows.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("y"),
    )
    indexer = StringIndexer(inputCol="lang", outputCol="place", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCol="place", outputCol="features", dropLast=False)
    made = Pipeline(stages=[indexer, encoder]).fit(rows).transform(rows)
    model = models.fit_logistic(made, c=1e9, tol=1e-12, compress=True)
    kinds = made.groupBy("lang").agg(F.first("features").alias("features"))
    return models.predictions(model, kinds).select("lang", F.round("y_prob", 3).alias("p"))


@_query
def cv_closed_form(spark, sf_dir):
    """Naive Bayes on embeddings: five models from the statistics of one scan."""
    rows = _embedding_rows(spark, sf_dir).withColumn("source", F.lit("embeddings"))
    folded = materialize(splits.assign_folds(rows, k=5), "folded")
    parameters = models.naive_bayes_parameters(models.fold_statistics(folded), k=5)
    scored = models.naive_bayes_scores(folded, parameters)
    made = metrics.binary_report(scored, ["fold"])
    return made.select("fold", "tp", "fp", "tn", "fn", *_rounded("f1", "auroc"))


@_query
def mlp_head(spark, sf_dir):
    """The head's report on every fold, each held out once."""
    rows = _embedding_rows(spark, sf_dir)
    folded = splits.assign_folds(rows, k=5, stratum=F.col("y").cast("string"))

    def fit(train: DataFrame):
        head = models.fit_embedding_head(train)
        return lambda held_out: models.predictions(head, models.with_vector(held_out))

    return models.cross_validate(folded, fit, k=5)


@_query
def cv_report(spark, sf_dir):
    rows = _embedding_rows(spark, sf_dir)
    folded = splits.assign_folds(rows, k=3, stratum=F.col("y").cast("string"))

    def fit(train: DataFrame):
        model = models.fit_logistic(models.with_vector(train))
        return lambda held_out: models.predictions(model, models.with_vector(held_out))

    return models.cv_summary(models.cross_validate(folded, fit, k=3))


def _embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        "embedding",
    )
