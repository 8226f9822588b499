"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; their 1- to 3-grams of letters and blanks are counted in `BUCKETS`
hash buckets, log(1 + count) times the inverse document frequency, scaled to length 1.
Document frequencies come from every training document, summed in each task before they
are shuffled. The regression is trained by follow-the-regularised-leader (proximal, with
a rate per coordinate) under an elastic net, whose first norm leaves most weights at zero,
on a bounded sample of about `PER_LANGUAGE` texts a language. A fifth of the sample is kept
from it to fit the temperature that divides the scores.

Defined cases: a null text or one without letters is `und` with score 0; null languages
teach nothing; null ids are predicted, not held out, and teach nothing; rows of one id each
teach their own language by their own text, equal rows once; a very long text is predicted
whole and learned as one vector; of equal scores the first language by code point holds;
with one language, that is predicted, and with none, `und`; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fold, in_small_batches
from labelloom.llm.learning import sample_rows

BUCKETS = 1 << 13
PER_LANGUAGE = 1500
FOLDS = 3
HELD_OUT = 1
UNKNOWN = "und"
EPOCHS = 4
# FTRL: rate, its offset, and the weights of the two norms.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(0x110000, dtype=np.uint8)  # 1: letter, 2: blank, filled when met
_SEEN = np.zeros(0x110000, dtype=bool)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts per bucket, or None where there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    new = np.unique(points[~_SEEN[points]])
    for point in new.tolist():
        _KIND[point] = chr(point).isalpha()
        _SEEN[point] = True
    letters = _KIND[points] == 1
    if not letters.any():
        return None
    # Whatever is no letter is one blank.
    marks = np.where(letters, points, 32)
    marks = marks[letters | np.append(True, letters[:-1])]
    marks = np.concatenate([[32], marks, [32]]).astype(np.uint64)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    value = np.full(len(marks), 0, dtype=np.uint64)
    for n in range(3):
        value = (value[: len(marks) - n] + marks[n:] + np.uint64(n + 1)) * _MIX
        value ^= value >> np.uint64(29)
        counts += np.bincount(
            (value >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS
        )
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's vector of length 1."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm > 0 else values


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse frequencies of the buckets over all rows of (text); one row per bucket
    comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, total = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text)
                if counts is not None:
                    present += counts > 0
                    total += 1
        at = np.flatnonzero(present)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at, -1).astype(np.int64)),
                pa.array(np.append(present[at], total).astype(np.int64)),
            ],
            names=["bucket", "n"],
        )

    counted = (
        texts.select("text")
        .mapInArrow(rows, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found = {row["bucket"]: row["n"] for row in counted}
    total = found.pop(-1, 0)
    frequencies = np.zeros(BUCKETS)
    frequencies[list(found)] = list(found.values())
    return np.log((1 + total) / (1 + frequencies)) + 1.0


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int
) -> np.ndarray:
    """FTRL-proximal weights (buckets, languages) after EPOCHS passes over the rows."""
    z = np.zeros((BUCKETS, languages))
    n = np.zeros((BUCKETS, languages))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, values, label = rows[k]
            zs, ns = z[at], n[at]
            w = _weights(zs, ns)
            p = _softmax(values @ w)
            p[label] -= 1.0
            gradient = values[:, None] * p
            squared = ns + gradient * gradient
            z[at] = zs + gradient - (np.sqrt(squared) - np.sqrt(ns)) / ALPHA * w
            n[at] = squared
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader under the elastic net: zero where |z| is within the first norm."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, on a grid of 0.05 to 5, with the least log loss."""
    if not len(scores):
        return 1.0
    grid = np.geomspace(0.05, 5.0, 80)
    rows = np.arange(len(labels))
    losses = [
        -np.log(_softmax(scores / t)[rows, labels] + 1e-12).mean() for t in grid
    ]
    return float(grid[int(np.argmin(losses))])


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict:
    """Languages, inverse frequencies, weights and temperature."""
    learned = docs.where(
        F.col(lang_col).isNotNull()
        & F.col(id_col).isNotNull()
        & (fold(id_col, FOLDS) != HELD_OUT)
    )
    rows = learned.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    sample, counts = sample_rows(rows, "lang", PER_LANGUAGE, 3)
    languages = sorted(counts)
    if not languages:
        return {"languages": []}
    idf = document_frequencies(rows.select("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text becomes the weights of at most BUCKETS buckets, however long it is."""
        for batch in batches:
            for part in in_small_batches(batch, 8 * BUCKETS):
                made = [
                    weigh(counts, idf) if (counts := gram_counts(t)) is not None else None
                    for t in part.column(2).to_pylist()
                ]
                digests = [xxhash.xxh3_64_intdigest(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([languages.index(x) for x in part.column(1).to_pylist()]),
                        pa.array(np.array(digests, np.uint64).view(np.int64)),
                        pa.array([m and m[0] for m in made], pa.list_(pa.int64())),
                        pa.array([m and m[1] for m in made], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "lang", "digest", "at", "weight"],
                )

    def train_one(rows: pa.Table) -> pa.Table:
        rows = rows.filter(rows["at"].is_valid()).sort_by(
            [(name, "ascending") for name in ("doc_id", "lang", "digest")]
        )
        marked = [
            (np.array(at), np.array(values), lang)
            for at, values, lang in zip(
                rows["at"].to_pylist(), rows["weight"].to_pylist(), rows["lang"].to_pylist()
            )
        ]
        keep = [v for i, v in enumerate(marked) if i % 5]
        rest = marked[::5]
        weights = train(keep, len(languages))
        scores = np.array([v @ weights[at] for at, v, _ in rest]).reshape(
            -1, len(languages)
        )
        temperature = fit_temperature(scores, np.array([v[2] for v in rest], dtype=int))
        flat = weights.astype("<f4").tobytes()
        return pa.table(
            {"weights": pa.array([flat], pa.binary()), "temperature": pa.array([temperature])}
        )

    # One bounded group: about PER_LANGUAGE vectors of each language.
    row = (
        sample.select("doc_id", "lang", "text")
        .mapInArrow(
            vectors,
            "doc_id bigint, lang bigint, digest bigint, at array<bigint>, weight array<double>",
        )
        .withColumn("part", F.lit(0))
        .groupBy("part")
        .applyInArrow(train_one, "weights binary, temperature double")
        .first()
    )
    weights = np.frombuffer(row["weights"], "<f4").reshape(BUCKETS, len(languages))
    return {
        "languages": languages,
        "idf": idf,
        "weights": weights,
        "temperature": row["temperature"],
    }


def predict(
    docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    languages = model["languages"]

    def one(text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at, values = weigh(counts, model["idf"])
        p = _softmax(values @ model["weights"][at] / model["temperature"])
        best = int(np.argmax(p))
        return languages[best], float(p[best])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                found = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(rows, "doc_id bigint, lang_pred string, score double")


def identify_languages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col=id_col, text_col=text_col).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
    )
