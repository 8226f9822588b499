"""Toxicity scores by non-negative positive-unlabelled learning.

`CLASSIFIERS` numpy classifiers are trained in as many tasks, each on its own bounded
sample: at most about `POSITIVES` confirmed toxic texts, and `UNLABELLED` of all texts
outside fold 0 with whatever labels they have left aside. No text counts as confirmed clean,
and a table in which every row is labelled is learned from like any other. With class prior p, the share of toxic rows among
all labelled training rows, each minimises

    p * R_p(+)  +  max(0, R_u(-) - p * R_p(-))

of the logistic loss; when the second term falls below zero, a step goes the other way.
Features are words and their beginnings of 3 to 7 letters, kept where they are clearly
more frequent in toxic than in unlabelled texts, as presence over the root of the number of
different words: a long clean text gathers chance hits, a toxic one gathers them densely.
A score is the mean of the classifiers' probabilities.

Defined cases: null and empty texts have no feature and get the bias's score; null ids are
scored and not held out; a label holds for every row of its id; repeated rows are scored
each; a very long text is scored whole, by its different words; equal scores are equal
results, as nothing is ranked; without toxic training texts every score is the prior (0
without labels); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fold, in_small_batches
from labelloom.llm.learning import label_rows, sample_ids, sample_rows, texts_of
from labelloom.session import materialize

CLASSIFIERS = 3
POSITIVES = 1500
UNLABELLED = 4000
MAX_FEATURES = 2000
CHANCE = 1e-3
FOLDS = 5
_STEPS = 60
_RATE = 0.1
_SHRINK = 1e-3
_KNOWN_WORDS = 500_000
# Everything in ASCII that is neither letter nor digit separates words.
_SEPARATE = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_MODEL = "classifier int, feature string, weight double"
_BIAS = ""


def text_words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_SEPARATE).split())


def word_features(word: bytes) -> list[str]:
    """The word, and its beginnings marked with a star."""
    letters = word.decode()
    return [letters, *(f"{letters[:k]}*" for k in range(3, 8) if len(letters) > k)]


def select_features(positive: list[set[str]], unlabelled: list[set[str]]) -> list[str]:
    """Features whose share is at least 3 times as high in toxic texts, beyond chance.

    The same bound holds for any number of texts: with as many features as are tested,
    chance alone lets one pass with probability `CHANCE` at most.
    """
    in_p = Counter(f for s in positive for f in s)
    in_u = Counter(f for s in unlabelled for f in s)
    n, m = len(positive), len(unlabelled)
    tested = sum(count >= 5 for count in in_p.values())
    least = NormalDist().inv_cdf(1 - CHANCE / max(1, tested))
    found = []
    for feature, count in in_p.items():
        if count < 5:
            continue
        p, u = count / n, (in_u[feature] + 1) / m
        sigma = np.sqrt(u * max(1 - u, 1e-3) * (1 / n + 1 / m))
        if p >= 3 * u and p - u > least * sigma:
            found.append(((p - u) / sigma, feature))
    found.sort(key=lambda x: (-x[0], x[1]))
    return [feature for _, feature in found[:MAX_FEATURES]]


def train(positive: list[str], unlabelled: list[str], prior: float) -> dict[str, float]:
    """Weights by feature; the bias under the empty name."""
    worded = [[text_words(t) for t in texts] for texts in (positive, unlabelled)]
    sets = [
        [{f for w in words for f in word_features(w)} for words in texts]
        for texts in worded
    ]
    names = select_features(*sets)
    index = {name: i for i, name in enumerate(names)}

    def matrix(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns, values = [], [], []
        for row, (features, words) in enumerate(zip(sets[part], worded[part])):
            hits = [index[f] for f in features if f in index]
            rows += [row] * len(hits)
            columns += hits
            values += [scale(len(words))] * len(hits)
        return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values)

    p, u = matrix(0), matrix(1)
    n, m = len(positive), len(unlabelled)
    weights = np.zeros(len(names) + 1)
    weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    moment, square = np.zeros_like(weights), np.zeros_like(weights)

    def margins(x, count: int) -> np.ndarray:
        return np.bincount(x[0], weights[:-1][x[1]] * x[2], count) + weights[-1]

    def gradient(x, slope: np.ndarray) -> np.ndarray:
        return np.append(
            np.bincount(x[1], slope[x[0]] * x[2], len(names)), slope.sum()
        )

    for step in range(1, _STEPS + 1):
        zp, zu = margins(p, n), margins(u, m)
        # d/dz of the loss as negative is sigmoid(z), as positive it is sigmoid(z) - 1.
        low_p, low_u = _sigmoid(zp) / n, _sigmoid(zu) / m
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if risk >= 0:
            slope = gradient(p, prior * (low_p - 1 / n) - prior * low_p)
            slope += gradient(u, low_u)
        else:
            slope = gradient(p, prior * low_p) - gradient(u, low_u)
        slope[:-1] += _SHRINK * weights[:-1]
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        weights -= (
            _RATE
            * (moment / (1 - 0.9**step))
            / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        )
    return dict(zip([*names, _BIAS], map(float, weights)))


def scale(words: int) -> float:
    """Value of a present feature in a text of that many different words."""
    return 4.0 / float(np.sqrt(words + 4.0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[dict[str, float]], float]:
    """The classifiers and the prior, from the folds other than 0."""
    known = materialize(label_rows(labels, "toxic"), "toxic-labels")
    learned = known.where(fold("doc_id", FOLDS) != 0)
    prior = learned.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    if not prior:
        return [], 0.0
    member = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CLASSIFIERS)).cast("int")
    positive, _ = sample_ids(
        learned.where("label = 1").select("doc_id"), F.lit("p"), POSITIVES * CLASSIFIERS, 1
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit("u").alias("kind"),
    ).where(F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != 0))
    unlabelled, _ = sample_rows(rows, "kind", UNLABELLED * CLASSIFIERS, 2)
    confirmed = texts_of(positive, docs, id_col, text_col)
    sample = (
        confirmed.select("doc_id", "text", F.lit(True).alias("toxic"))
        .unionByName(unlabelled.select("doc_id", "text", F.lit(False).alias("toxic")))
        .withColumn("classifier", member)
    )

    def train_one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        marked = sorted(set(zip(rows["toxic"].to_pylist(), rows["text"].to_pylist())))
        positive = [t for toxic, t in marked if toxic]
        unlabelled = [t for toxic, t in marked if not toxic]
        weights = train(positive, unlabelled, prior) if positive and unlabelled else {}
        return pa.table(
            {
                "classifier": pa.array([key[0].as_py()] * len(weights), pa.int32()),
                "feature": pa.array(list(weights), pa.string()),
                "weight": pa.array(list(weights.values()), pa.float64()),
            }
        )

    trained = sample.groupBy("classifier").applyInArrow(train_one, _MODEL)
    models: dict[int, dict[str, float]] = {}
    # At most CLASSIFIERS * (MAX_FEATURES + 1) rows.
    for row in trained.collect():
        models.setdefault(row["classifier"], {})[row["feature"]] = row["weight"]
    return [models[k] for k in sorted(models)], float(prior)


def score(
    docs: DataFrame,
    models: list[dict[str, float]],
    prior: float,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and score of every row."""
    names = sorted({f for m in models for f in m if f != _BIAS})
    index = {name: i for i, name in enumerate(names)}
    weights = np.array([[m.get(f, 0.0) for f in names] for m in models])
    biases = np.array([m[_BIAS] for m in models])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}

        def hits(word: bytes) -> list[int]:
            found = known.get(word)
            if found is None:
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                found = known[word] = [
                    index[f] for f in word_features(word) if f in index
                ]
            return found

        def one(text: str | None) -> float:
            if not models:
                return prior
            words = text_words(text or "")
            present = sorted({i for w in words for i in hits(w)})
            margins = biases + weights[:, present].sum(axis=1) * scale(len(words))
            return float(_sigmoid(margins).mean())

        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([one(t) for t in part.column(1).to_pylist()], pa.float64()),
                    ],
                    names=["doc_id", "score"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(rows, "doc_id bigint, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    models, prior = fit(docs, labels, **columns)
    return score(docs, models, prior, **columns).select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
