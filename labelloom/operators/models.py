"""Baseline models on Spark ML: TF-IDF with logistic regression, and an embedding head."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import metrics
from labelloom.operators.selection import byte_keys, first_rows
from labelloom.operators.splits import fold_frames
from labelloom.session import materialize

# Fixed value: runs of two or more word characters, in any script.
WORD_PATTERN = r"(?U)\w\w+"


# Terms of lists that are looked up at one time.
SLICE_TERMS = 1 << 18
# The least variance that naive Bayes takes a dimension to have.
LEAST_VARIANCE = 1e-9


@dataclass(frozen=True)
class TfidfSettings:
    min_df: int = 3
    max_features: int = 200_000
    sublinear_tf: bool = True
    c: float = 1.0
    max_iter: int = 1000


def word_terms(df: DataFrame, *, text: str = "prompt") -> DataFrame:
    """Add `terms`: lower-case words followed by word pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    worded = df.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    return (
        pairs.transform(worded)
        .withColumn("terms", F.concat("_words", "_pairs"))
        .drop("_words", "_pairs")
    )


def term_statistics(
    df: DataFrame, *, text: str = "prompt", min_df: int = 3, max_features: int = 200_000
) -> DataFrame:
    """(term, tf, df, idf) of the vocabulary: the most frequent terms, ties by name."""
    terms = F.col("terms")

    def counting(terms: Column, tf: int, df: int) -> Column:
        return F.struct(terms.alias("terms"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))

    # Once with repeats for tf, once without for df: both are summed map-side, so only
    # distinct terms are shuffled, not (term, row) pairs.
    passes = F.array(counting(terms, 1, 0), counting(F.array_distinct(terms), 0, 1))
    exploded = (
        word_terms(df, text=text)
        .select(F.explode(passes).alias("counted"))
        .select(F.explode("counted.terms").alias("term"), "counted.tf", "counted.df")
    )
    totals = exploded.groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df")
    )
    rows = df.agg(F.count("*")).scalar()
    vocabulary = first_rows(
        totals.where(F.col("df") >= min_df),
        [-F.col("tf"), *byte_keys("term")],
        max_features,
        last="term",
    )
    return vocabulary.withColumn("idf", F.log((rows + 1) / (F.col("df") + 1)) + 1)


@dataclass(frozen=True)
class TextFeatures:
    """A vocabulary in order of its terms, and inverse document frequencies."""

    vocabulary: list[str] = field(repr=False)
    idf: np.ndarray = field(repr=False)
    sublinear_tf: bool = True

    def transform(self, df: DataFrame, *, text: str = "prompt") -> DataFrame:
        """Add `features`: (1 + ln tf) * idf, scaled to unit length.

        Rows meet the vocabulary where they are: it is a broadcast table of at most
        `max_features` terms, and no term of a row is shuffled.
        """
        shared = self._shared(df)
        size, sublinear = len(self.vocabulary), self.sublinear_tf

        @F.arrow_udf(VectorUDT())
        def weigh(terms: pa.Array) -> pa.Array:
            """Sparse vectors as structs."""
            ends, places, values = [np.zeros(1, np.int64)], [], []
            for part in _in_slices(terms):
                row, term, weight = _weights(part, *shared.value, sublinear)
                ends.append(np.bincount(row, minlength=len(part)))
                places.append(pa.array(term.astype(np.int32)))
                values.append(pa.array(weight))
            ends = pa.array(np.cumsum(np.concatenate(ends)).astype(np.int32))
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(len(terms), dtype=np.int8)),
                    pa.array(np.full(len(terms), size, dtype=np.int32)),
                    pa.ListArray.from_arrays(ends, _joined(places, pa.int32())),
                    pa.ListArray.from_arrays(ends, _joined(values, pa.float64())),
                ],
                names=["type", "size", "indices", "values"],
            )

        return word_terms(df, text=text).withColumn("features", weigh("terms")).drop("terms")

    def weights(self, df: DataFrame, *, text: str = "prompt") -> DataFrame:
        """(row_id, term, weight): the vectors of `transform`, a row for each entry."""
        shared, sublinear = self._shared(df), self.sublinear_tf

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, idf = shared.value
            for batch in batches:
                at = 0
                for part in _in_slices(batch.column(1)):
                    row, term, values = _weights(part, vocabulary, idf, sublinear)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + at)),
                            vocabulary.take(pa.array(term)),
                            pa.array(values),
                        ],
                        names=["row_id", "term", "weight"],
                    )
                    at += len(part)

        row_id = df.schema["row_id"].dataType.simpleString()
        return (
            word_terms(df, text=text)
            .select("row_id", "terms")
            .mapInArrow(rows, f"row_id {row_id}, term string, weight double")
        )

    def _shared(self, df: DataFrame) -> Broadcast:
        vocabulary = pa.array(self.vocabulary, pa.string())
        return df.sparkSession.sparkContext.broadcast((vocabulary, self.idf))


def _in_slices(terms: pa.Array) -> Iterator[pa.Array]:
    """Lists of terms in slices of about SLICE_TERMS; a longer list is one of its own."""
    ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    start, before = 0, 0
    while start < len(terms):
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_TERMS, "right")))
        yield terms.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _joined(parts: list[pa.Array], of: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], of)


def _weights(
    terms: pa.Array, vocabulary: pa.Array, idf: np.ndarray, sublinear: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of all entries of a batch of term lists, in order.

    Terms are looked up as Arrow holds them: no term becomes a Python string.
    """
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    found = pc.index_in(terms.flatten(), value_set=vocabulary)
    at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(vocabulary))
    known = at >= 0
    met = np.repeat(np.arange(len(terms)), lengths)[known] * size + at[known]
    cells, tf = np.unique(met, return_counts=True)
    row, term = cells // size, cells % size
    values = (1.0 + np.log(tf) if sublinear else tf) * idf[term]
    squares = np.bincount(row, values * values, minlength=len(terms))
    return row, term, values / np.sqrt(squares)[row]


def fit_text_features(
    df: DataFrame,
    settings: TfidfSettings = TfidfSettings(),
    *,
    text: str = "prompt",
) -> TextFeatures:
    """One pass over the terms; the driver holds the vocabulary, which is bounded."""
    terms = term_statistics(
        df, text=text, min_df=settings.min_df, max_features=settings.max_features
    )
    rows = sorted((r["term"], r["idf"]) for r in terms.select("term", "idf").collect())
    return TextFeatures(
        [term for term, _ in rows], np.array([idf for _, idf in rows]), settings.sublinear_tf
    )


def _training_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows written once, as every iteration reads them, and their number."""
    written = materialize(df, "training")
    return written, written.count()


def with_balanced_weights(df: DataFrame) -> DataFrame:
    """Add `weight` = rows / (2 * rows of the class)."""
    totals = df.agg(
        F.struct(
            F.count("*").alias("n"),
            F.count_if(F.col("y") == 1).alias("block"),
            F.count_if(F.col("y") == 0).alias("safe"),
        )
    ).scalar()
    of_class = F.when(F.col("y") == 1, totals["block"]).otherwise(totals["safe"])
    return df.withColumn("weight", totals["n"] / (2 * of_class))


def compressed(df: DataFrame, *, features: str = "features") -> DataFrame:
    """(y, features, weight, n): equal rows as one, with the sum of their weights.

    Rows are told apart by a 128-bit digest of the vector; tasks add up before they shuffle.
    """
    keyed = df.withColumn("_digest", _vector_digest(features))
    return (
        keyed.groupBy("y", "_digest")
        .agg(
            F.first(features).alias(features),
            F.sum("weight").alias("weight"),
            F.count("*").alias("n"),
        )
        .drop("_digest")
    )


@F.pandas_udf(T.BinaryType())
def _vector_digest(vectors: pd.DataFrame) -> pd.Series:
    """Of a vector's non-zero entries, so that dense and sparse forms agree."""

    def digest(size, indices, values) -> bytes:
        values = np.asarray(values, dtype=np.float64)
        at = np.arange(len(values)) if indices is None else np.asarray(indices)
        kept = values != 0
        parts = np.int64(size or len(values)), at[kept].astype(np.int64), values[kept]
        return hashlib.blake2b(b"".join(p.tobytes() for p in parts), digest_size=16).digest()

    size = vectors["size"].astype(object).where(vectors["size"].notna(), None)
    return pd.Series(
        [digest(*row) for row in zip(size, vectors["indices"], vectors["values"])]
    )


def fit_logistic(
    df: DataFrame,
    *,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
    features: str = "features",
    compress: bool = False,
):
    """L2 logistic regression with balanced classes; the penalty is 1 / (C * rows).

    With `compress`, rows with equal features and label become one weighted row first:
    every step then costs what the different rows cost.
    """
    train, rows = _training_rows(df.select("y", features))
    weighted = with_balanced_weights(train)
    if compress:
        weighted = materialize(compressed(weighted, features=features), "compressed")
    return LogisticRegression(
        featuresCol=features,
        labelCol="y",
        weightCol="weight",
        maxIter=max_iter,
        tol=tol,
        standardization=False,
        elasticNetParam=0.0,
        regParam=1.0 / (c * rows),
    ).fit(weighted)


def fit_embedding_head(
    df: DataFrame,
    *,
    hidden: int = 256,
    max_iter: int = 30,
    block_size: int = 64,
    seed: int = 42,
    embedding: str = "embedding",
):
    """One hidden layer on `embedding`; Spark's layer is sigmoid, without dropout."""
    train, _ = _training_rows(with_vector(df, embedding).select("y", "features"))
    size = train.first().features.size
    return MultilayerPerceptronClassifier(
        featuresCol="features",
        labelCol="y",
        layers=[size, hidden, 2],
        maxIter=max_iter,
        blockSize=block_size,
        seed=seed,
    ).fit(train)


def with_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


def predictions(model, df: DataFrame) -> DataFrame:
    """Rows with `features` to rows with y_pred and y_prob."""
    scored = model.transform(df)
    return scored.select(
        *[c for c in df.columns if c != "features"],
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_prob"),
    )


@dataclass(frozen=True)
class TfidfClassifier:
    features: TextFeatures
    model: object = field(repr=False)

    def score(self, df: DataFrame, *, text: str = "prompt") -> DataFrame:
        return predictions(self.model, self.features.transform(df, text=text))


def fit_tfidf_classifier(
    train: DataFrame,
    settings: TfidfSettings = TfidfSettings(),
    *,
    text: str = "prompt",
) -> TfidfClassifier:
    features = fit_text_features(train, settings, text=text)
    vectors = features.transform(train, text=text).select("y", "features")
    model = fit_logistic(vectors, c=settings.c, max_iter=settings.max_iter)
    return TfidfClassifier(features, model)


def cross_validate(
    folded: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    *,
    k: int = 5,
    ratio: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """A report row per fold. `fit(train)` returns a scorer for the fold's rows.

    Training rows are balanced, validation rows are not. The scored folds are
    reported on together, in one pass.
    """
    scored = []
    for fold in range(k):
        train, held_out = fold_frames(folded, fold, ratio=ratio, seed=seed)
        train = materialize(train, "fold")
        scored.append(fit(train)(held_out).select("fold", "y", "y_pred", "y_prob"))
    out_of_fold = scored[0]
    for frame in scored[1:]:
        out_of_fold = out_of_fold.unionByName(frame)
    return metrics.binary_report(out_of_fold, ["fold"])


def fold_statistics(folded: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(fold, y, dim, n, total, squares): all that Gaussian naive Bayes learns, in one scan.

    Sums of parts add up and subtract, so that every training set is the total less its
    fold. One row for each fold, label and dimension.
    """
    return (
        folded.select("fold", "y", F.posexplode(embedding).alias("dim", "x"))
        .withColumn("x", F.col("x").cast("double"))
        .groupBy("fold", "y", "dim")
        .agg(
            F.count("*").alias("n"),
            F.sum("x").alias("total"),
            F.sum(F.col("x") * F.col("x")).alias("squares"),
        )
    )


def naive_bayes_parameters(statistics: DataFrame, *, k: int = 5) -> DataFrame:
    """(fold, terms): the model that learned from all other folds, one row a fold.

    `terms` has the mean and the variance of both labels for each dimension.
    """
    statistics = materialize(statistics, "fold-statistics")
    names = ("n", "total", "squares")
    everything = statistics.groupBy("y", "dim").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    outside = (
        everything.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .join(statistics, ["fold", "y", "dim"], "left")
        .select(
            "fold",
            "y",
            "dim",
            *[(F.col(f"all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in names],
        )
    )
    mean = F.col("total") / F.col("n")
    of_label = F.struct(
        mean.alias("mean"),
        F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(LEAST_VARIANCE)).alias(
            "variance"
        ),
    )

    def given(y: int) -> Column:
        return F.max(F.when(F.col("y") == y, of_label)).alias(f"y{y}")

    by_dim = outside.where("n > 0").groupBy("fold", "dim").agg(given(0), given(1))
    return by_dim.groupBy("fold").agg(
        F.sort_array(F.collect_list(F.struct("dim", "y0", "y1"))).alias("terms")
    )


def naive_bayes_scores(
    folded: DataFrame, parameters: DataFrame, embedding: str = "embedding"
) -> DataFrame:
    """y_pred and y_prob of each row by the model that did not learn from its fold.

    Both labels count as equally likely, as in training on balanced classes. `parameters`
    has one row a fold and is broadcast.
    """

    def likelihood(x: Column, of: Column) -> Column:
        away = x - of["mean"]
        return -(F.log(of["variance"]) + away * away / of["variance"]) / 2

    odds = F.aggregate(
        F.zip_with(
            embedding,
            "terms",
            lambda x, t: likelihood(x.cast("double"), t["y1"])
            - likelihood(x.cast("double"), t["y0"]),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    return (
        folded.join(F.broadcast(parameters), "fold")
        .withColumn("y_prob", 1 / (1 + F.exp(-odds)))
        .withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
        .drop("terms")
    )


def cv_summary(reports: DataFrame) -> DataFrame:
    """(metric, mean, std) over the folds."""
    names = ["f1", "precision", "recall", "accuracy", "fpr", "fnr", "auroc", "auprc"]
    return (
        reports.select("fold", *[F.col(n).cast("double") for n in names])
        .unpivot("fold", names, "metric", "value")
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
