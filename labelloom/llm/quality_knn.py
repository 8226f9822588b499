"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, in `WORD_TERMS` hash buckets, and its surface: trigrams over
classes of characters (case, digit, blank, line end, each kind of sign), words that repeat
the word before, lines that repeat an earlier line, and being short. Term shares are weighted
by inverse document frequencies over all documents; words and surface are vectors of their
own, of which the words' has length `WORD_WEIGHT` and the surface's 1. A truncated singular value decomposition of the labelled sample gives
`LATENT` directions. The sample is bounded: about `PER_LABEL` texts of each label. Its
vectors are broadcast, every document's cosines with all of them are computed exactly in
blocks, and the `NEIGHBOURS` nearest vote with weight cosine^`SHARPNESS`. Votes of a label
of which only a part was drawn count for the rest as well.

Defined cases: null and empty texts have the single term of a short text and are voted on
like any other; null ids are scored and not held out; a label holds for every row of its
id; repeated rows are scored each; a very long text is one vector like any other; cosines
are compared to six digits, and of equally near neighbours those with the least id vote;
with no label, or one only, the score is that label's (0.5 without any); an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fold, in_small_batches
from labelloom.llm.learning import label_rows, sample_ids, texts_of
from labelloom.session import materialize

PER_LABEL = 3000
LATENT = 48
NEIGHBOURS = 15
SHARPNESS = 4
FOLDS = 5
THRESHOLD = 0.3
BLOCK = 256
_EXTRA = 4  # repeated words, repeated lines, shortness, any text
_CLASSES = 16
SURFACE_TERMS = _CLASSES**3 + _EXTRA
WORD_TERMS = 1 << 13
WORD_WEIGHT = 0.5
TERMS = SURFACE_TERMS + WORD_TERMS
_DIGITS = 6
_WORDS_KNOWN = 500_000
# Directions beyond LATENT, and rounds, of the randomised decomposition.
_BEYOND, _ROUNDS = 16, 5
# Everything in ASCII that is neither letter nor digit separates words.
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _class_table() -> np.ndarray:
    """Class of each byte; all bytes of other scripts are lower-case letters."""
    table = np.zeros(256, dtype=np.int64)
    kinds = ["A-Z", "0-9", " \t\v\f\r", "\n", ".", ",", "!?", "|", "#", "*", "$", "%", "&"]
    for number, kind in enumerate(kinds, start=1):
        if kind == "A-Z":
            table[65:91] = number
        elif kind == "0-9":
            table[48:58] = number
        else:
            table[list(kind.encode())] = number
    for byte in range(33, 127):
        if not table[byte] and not chr(byte).isalpha():
            table[byte] = len(kinds) + 1
    table[:32][table[:32] == 0] = len(kinds) + 2
    return table


_TABLE = _class_table()


class _WordTerms(dict):
    """Word to its bucket, started anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % WORD_TERMS
        return value


_BUCKETS = _WordTerms()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms, as a vector of TERMS numbers: the surface's, then the words'."""
    data = (text or "").encode()
    counts = np.zeros(TERMS)
    named = data.lower().translate(_SEPARATE).split()
    if named:
        at = np.fromiter(map(_BUCKETS.__getitem__, named), np.int64, len(named))
        counts[SURFACE_TERMS:] = np.bincount(at, minlength=WORD_TERMS)
    _count_surface(data, counts[:SURFACE_TERMS])
    return counts


def _count_surface(data: bytes, counts: np.ndarray) -> None:
    classes = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    if len(classes) > 2:
        codes = (classes[:-2] * _CLASSES + classes[1:-1]) * _CLASSES + classes[2:]
        counts[:-_EXTRA] = np.bincount(codes, minlength=len(counts) - _EXTRA)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    size = max(1, len(data))
    # Brought to the scale of the trigrams, as shares of words and lines.
    counts[-4] = size * sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    counts[-3] = size * (len(lines) - len(set(lines))) / max(1, len(lines))
    counts[-2] = size * max(0.0, 1 - len(words) / 20) * 0.1
    counts[-1] = 0.001 * size


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of root shares times idf, each part brought to its length."""
    parts = []
    for part, length in ((slice(0, SURFACE_TERMS), 1), (slice(SURFACE_TERMS, TERMS), WORD_WEIGHT)):
        own = counts[:, part]
        shares = own / np.maximum(own.sum(axis=1, keepdims=True), 1e-12)
        values = np.sqrt(shares) * idf[part]
        norms = np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)
        parts.append((values * (length / norms)).astype(np.float32))
    return np.hstack(parts)


def decompose(matrix: np.ndarray) -> np.ndarray:
    """The first LATENT right singular vectors, by randomised subspace iteration."""
    size = min(LATENT + _BEYOND, *matrix.shape)
    guess = np.random.default_rng(1).normal(size=(matrix.shape[1], size))
    for _ in range(_ROUNDS):
        guess, _ = np.linalg.qr(matrix.T @ (matrix @ guess.astype(np.float32)))
    _, _, turned = np.linalg.svd(matrix @ guess.astype(np.float32), full_matrices=False)
    return (guess @ turned.T)[:, :LATENT]


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all rows of (text), summed in each task; one row per term is collected."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, total = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                present[np.flatnonzero(term_counts(text))] += 1
                total += 1
        at = np.flatnonzero(present)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(present[at], total))],
            names=["term", "n"],
        )

    found = {
        row["term"]: row["n"]
        for row in texts.select("text")
        .mapInArrow(rows, "term bigint, n bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    total = found.pop(-1, 0)
    frequencies = np.zeros(TERMS)
    frequencies[list(found)] = list(found.values())
    return np.log((1 + total) / (1 + frequencies)) + 0.1


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """The latent directions, and the labelled vectors with their votes."""
    learned = materialize(
        label_rows(labels, "quality").where(fold("doc_id", FOLDS) != 0), "quality-labels"
    )
    sampled, counts = sample_ids(learned, F.col("label"), PER_LABEL, 5)
    if len(counts) < 2:
        return {"constant": float(next(iter(counts), 0.5))}
    idf = inverse_frequencies(docs.select(F.col(text_col).alias("text")))
    sample = texts_of(sampled, docs, id_col, text_col)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text becomes the weights of at most TERMS terms, however long it is."""
        for batch in batches:
            for part in in_small_batches(batch, 8 * TERMS):
                texts = part.column(2).to_pylist()
                rows = weigh(np.array([term_counts(t) for t in texts]), idf)
                at = [np.flatnonzero(row) for row in rows]
                digests = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array(digests.view(np.int64)),
                        pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                        pa.array([row[a] for row, a in zip(rows, at)], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "label", "digest", "at", "weight"],
                )

    def latent(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in ("doc_id", "digest")])
        labels = rows["label"].to_pylist()
        at, weight = rows["at"].combine_chunks(), rows["weight"].combine_chunks()
        matrix = np.zeros((len(labels), TERMS), dtype=np.float32)
        row = np.repeat(np.arange(len(labels)), np.diff(np.asarray(at.offsets)))
        matrix[row, np.asarray(at.flatten())] = np.asarray(weight.flatten())
        basis = decompose(matrix)  # uncentred, as usual for latent semantics
        vectors = _unit(matrix @ basis)
        return pa.table(
            {
                "kind": pa.array(["basis"] + ["vector"] * len(labels)),
                "label": pa.array([None, *labels], pa.int32()),
                "data": pa.array(
                    [basis.astype("<f4").tobytes()]
                    + [v.astype("<f4").tobytes() for v in vectors],
                    pa.binary(),
                ),
            }
        )

    # One bounded group: about PER_LABEL vectors of each label.
    rows = (
        sample.select("doc_id", "label", "text")
        .mapInArrow(
            weighed,
            "doc_id bigint, label int, digest bigint, at array<int>, weight array<float>",
        )
        .withColumn("part", F.lit(0))
        .groupBy("part")
        .applyInArrow(latent, "kind string, label int, data binary")
        .collect()
    )
    basis = next(r["data"] for r in rows if r["kind"] == "basis")
    vectors = [r for r in rows if r["kind"] == "vector"]
    drawn = {label: sum(r["label"] == label for r in vectors) for label in counts}
    return {
        "idf": idf,
        "basis": np.frombuffer(basis, "<f4").reshape(TERMS, -1).copy(),
        "vectors": np.array([np.frombuffer(r["data"], "<f4") for r in vectors]),
        "labels": np.array([r["label"] for r in vectors], dtype=np.float32),
        "votes": np.array(
            [counts[r["label"]] / max(1, drawn[r["label"]]) for r in vectors], np.float32
        ),
    }


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Scores of unit vectors: the share of votes for label 1 among the nearest."""
    cosines = np.round(vectors @ model["vectors"].T, _DIGITS)
    count = min(NEIGHBOURS, cosines.shape[1])
    least = -np.partition(-cosines, count - 1, axis=1)[:, count - 1 : count]
    nearer, level = cosines > least, cosines == least
    # The vectors stand in order of their ids.
    room = count - nearer.sum(axis=1, keepdims=True)
    chosen = nearer | (level & (np.cumsum(level, axis=1) <= room))
    nearest = np.nonzero(chosen)[1].reshape(len(cosines), count)
    weights = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 1e-6) ** SHARPNESS
    weights = weights * model["votes"][nearest]
    return (weights * model["labels"][nearest]).sum(axis=1) / weights.sum(axis=1)


def score(
    docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LABEL

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                if "constant" in own:
                    scores = np.full(part.num_rows, own["constant"])
                else:
                    counts = np.array([term_counts(t) for t in part.column(1).to_pylist()])
                    latent = weigh(counts, own["idf"]) @ own["basis"]
                    scores = vote(_unit(latent).astype(np.float32), own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.clip(scores, 0, 1).astype(np.float64))],
                    names=["doc_id", "score"],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(rows, "doc_id bigint, score double")


def score_quality(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, **columns), **columns).select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
