"""Secrets in texts: fixed rules, and a character network over everything that looks alike.

1. Rules find assignments, access keys and long hexadecimal runs. They are never dropped.
2. Candidates are all runs of at least `MIN_RUN` letters, digits and signs of base64 with a
   digit in them, and all runs of `LONG_RUN`. A window holds the run and its surrounding
   text; a longer run has as many windows as it needs, and the greatest score holds.
3. A numpy network scores every window: convolutions over its characters, rectified, pooled
   apart over the text before, the run and the text after, then a softmax over no secret
   and the kinds of the rules.
4. It learns from labelled findings: runs that a rule found, and runs that none did. Each
   found run with a digit is also learned behind another run's context, so that the value
   counts and not the key word alone. A part of the findings, dealt by hash of the window,
   sets the temperature of the softmax and, for each kind, the highest threshold that keeps
   `RECALL` of the held-out findings (never below even odds).

`find_secrets` learns from every finding of every document, in parts whose weights are
averaged (`fit_all`). `fit` learns in one task, from the bounded sample of `label_findings`:
about `SAMPLE_DOCS` documents, at most `PER_KIND` of each kind and `NEGATIVES` others. All weights are multiples of 1/1024, so that sums are the same
in any order and a score depends on nothing but its window.

Defined cases: a null text is the empty one and has no findings; null and repeated ids and
equal rows are rows each; a very long text is searched whole, in pieces cut between runs;
runs touching a rule's finding give no further finding; where a kind has too few held-out
findings the threshold of all kinds holds; without findings of any kind, or without other
candidates, the rules alone hold; an empty table gives an empty one; other columns are not
read. Bytes of other scripts count as one character class to the network.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import in_small_batches
from labelloom.session import materialize

RULES = ("assign", "access", "hex")
MODEL = "model"
MIN_RUN, LONG_RUN = 8, 20
SAMPLE_DOCS = 40_000
PER_KIND = 800
NEGATIVES = 4000
RECALL = 0.97
# Bytes of a window: before the run, of the run, after it.
LEFT, VALUE, RIGHT = 24, 64, 8
WIDTH = LEFT + VALUE + RIGHT
FILTERS, REACH = 16, 5
_STEP = 1024.0
_EPOCHS, _BATCH, _RATE, _SHRINK = 10, 128, 0.01, 1e-4
_HELD_OUT = 4
_TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0)
# Findings that one task learns from at a time, and rounds of averaging if there are more.
PART_ROWS = 8192
_ROUNDS, _ROUND_EPOCHS = 5, 4
# Weights and losses are summed in whole numbers of this unit.
_UNITS = float(1 << 20)
_LEAST_HELD = 5
# What is drawn over the limits, so that drawing by hash seldom falls short of them.
_MARGIN = 1.1
_PIECE = 1 << 22
_BLOCK = 256

# Searched in lower-cased bytes: lower-casing changes ASCII only and keeps all places.
_ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_OUTSIDE = re.compile(rb"[^A-Za-z0-9+/_.-]")

# 1 for characters of runs, 2 for digits among them.
_RUN = np.zeros(256, dtype=np.uint8)
_RUN[[b for b in range(128) if chr(b).isalnum() or chr(b) in "+/_.-"]] = 1
_RUN[48:58] = 2
# 0 is no character; printable ASCII has a code each.
_CODES = np.full(256, 96, dtype=np.uint8)
_CODES[32:127] = np.arange(1, 96)
_CODES[128:] = 97
_VOCABULARY = 98

Span = tuple[str, int, int]
_FOUND = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"
_FOUND_TYPE = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("score", pa.float64()),
        ]
    )
)


def rule_spans(data: bytes) -> list[tuple[Span, tuple[int, int]]]:
    """Spans of the rules in bytes, each with the span of its value."""
    found: list[tuple[Span, tuple[int, int]]] = []
    for m in _ASSIGN.finditer(data.lower()):
        if m.end(1) - m.start(1) >= 8:
            found.append((("assign", *m.span()), m.span(1)))
    # A run too short by the rule stays too short from any later place in it.
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [((kind, *m.span()), m.span()) for m in pattern.finditer(data)]
    return found


def run_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all candidate runs."""
    raw = np.frombuffer(data, np.uint8)
    all_starts, all_ends = [], []
    at = 0
    while at < len(data):
        border = _OUTSIDE.search(data, min(len(data), at + _PIECE))
        end = border.start() if border else len(data)
        kinds = _RUN[raw[at:end]]
        edges = np.flatnonzero(np.diff(kinds > 0, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= MIN_RUN
        starts, ends = starts[long], ends[long]
        digits = np.concatenate([[0], np.cumsum(kinds == 2, dtype=np.int32)])
        kept = (digits[ends] > digits[starts]) | (ends - starts >= LONG_RUN)
        all_starts.append(starts[kept] + at)
        all_ends.append(ends[kept] + at)
        at = end
    if not all_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_starts), np.concatenate(all_ends)


class Windows:
    """The windows of runs in one buffer, cut out a block at a time."""

    def __init__(self, data: bytes, starts, ends, lows, highs):
        """`lows` and `highs` bound the document of each run."""
        self._raw = np.frombuffer(data, np.uint8)
        pieces = -(-(ends - starts) // VALUE)
        self.owner = np.repeat(np.arange(len(starts)), pieces)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self._first = starts[self.owner] + number * VALUE
        self._last = np.minimum(self._first + VALUE, ends[self.owner])
        self._low, self._high = lows[self.owner], highs[self.owner]

    def blocks(self) -> Iterator[np.ndarray]:
        """Character codes, one window a row."""
        for k in range(0, len(self.owner), _BLOCK):
            part = slice(k, k + _BLOCK)
            first, last = self._first[part, None], self._last[part, None]
            left = first + np.arange(-LEFT, 0)
            value = first + np.arange(VALUE)
            right = last + np.arange(RIGHT)
            inside = np.hstack(
                [left >= self._low[part, None], value < last, right < self._high[part, None]]
            )
            at = np.clip(np.hstack([left, value, right]), 0, len(self._raw) - 1)
            yield np.where(inside, _CODES[self._raw[at]], 0).astype(np.uint8)


class Network:
    """Convolutions over characters, pooled by zone, and a softmax."""

    ZONES = (slice(0, LEFT), slice(LEFT, LEFT + VALUE), slice(LEFT + VALUE, WIDTH))

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.weights = {
            "tables": rng.normal(0, 0.1, (REACH, _VOCABULARY, FILTERS)),
            "shift": np.zeros(FILTERS),
            "dense": rng.normal(0, 0.1, (4 * FILTERS, 1 + len(RULES))),
            "bias": np.zeros(1 + len(RULES)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def rounded(self) -> Network:
        """A copy whose weights are multiples of 1/1024."""
        other = Network()
        other.weights = {
            k: (np.round(v * _STEP) / _STEP).astype(np.float32) for k, v in self.weights.items()
        }
        return other

    def _filtered(self, codes: np.ndarray) -> np.ndarray:
        """Rectified outputs [window, place, filter], 0 where there is no character."""
        wide = np.pad(codes, ((0, 0), (REACH // 2, REACH // 2)))
        out = np.broadcast_to(self.weights["shift"], (*codes.shape, FILTERS)).copy()
        for k in range(REACH):
            out += self.weights["tables"][k][wide[:, k : k + WIDTH]]
        return np.maximum(out, 0) * (codes != 0)[:, :, None]

    def _pooled(self, out: np.ndarray) -> np.ndarray:
        left, value, right = (out[:, zone] for zone in self.ZONES)
        return np.hstack(
            [left.max(axis=1), value.max(axis=1), value.sum(axis=1) / VALUE, right.max(axis=1)]
        )

    def logits(self, codes: np.ndarray) -> np.ndarray:
        pooled = self._pooled(self._filtered(codes)).astype(np.float64)
        return pooled @ self.weights["dense"].astype(np.float64) + self.weights["bias"]

    def gradients(self, codes, labels, weigh) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross entropy of a batch and its derivatives."""
        out = self._filtered(codes)
        pooled = self._pooled(out)
        p = softmax(pooled @ self.weights["dense"] + self.weights["bias"])
        rows = np.arange(len(codes))
        loss = float(-(np.log(np.maximum(p[rows, labels], 1e-12)) * weigh).sum() / weigh.sum())
        slope = p.copy()
        slope[rows, labels] -= 1
        slope *= (weigh / weigh.sum())[:, None]
        back = (slope @ self.weights["dense"].T).reshape(len(codes), 4, FILTERS)
        down = np.zeros_like(out)
        down[:, self.ZONES[1]] += back[:, 2, None] / VALUE
        for zone, part in zip(self.ZONES, (0, 1, 3)):
            top = out[:, zone].argmax(axis=1) + zone.start
            np.add.at(
                down,
                (rows[:, None], top, np.arange(FILTERS)[None]),
                back[:, part],
            )
        down *= out > 0
        wide = np.pad(codes, ((0, 0), (REACH // 2, REACH // 2)))
        ones = np.eye(_VOCABULARY, dtype=np.float32)[wide]
        flat = down.reshape(-1, FILTERS).astype(np.float32)
        tables = np.stack(
            [
                ones[:, k : k + WIDTH].reshape(-1, _VOCABULARY).T @ flat
                for k in range(REACH)
            ]
        )
        return loss, {
            "tables": tables,
            "shift": flat.sum(axis=0),
            "dense": pooled.T @ slope,
            "bias": slope.sum(axis=0),
        }

    def fit(
        self,
        codes: np.ndarray,
        labels: np.ndarray,
        seed: int = 4,
        *,
        epochs: int = _EPOCHS,
        shares: np.ndarray | None = None,
    ) -> None:
        """Adam over shuffled batches; every class has the same weight in sum.

        `shares` are the rows of each class, where these are a part of them.
        """
        rng = np.random.default_rng(seed)
        if shares is None:
            shares = np.bincount(labels, minlength=1 + len(RULES))
        weigh = (len(labels) / np.maximum(shares, 1) / np.count_nonzero(shares))[labels]
        moment = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), _BATCH):
                rows = order[at : at + _BATCH]
                step += 1
                _, slopes = self.gradients(codes[rows], labels[rows], weigh[rows])
                for name, slope in slopes.items():
                    slope = slope + _SHRINK * self.weights[name]
                    moment[name] = 0.9 * moment[name] + 0.1 * slope
                    square[name] = 0.999 * square[name] + 0.001 * slope * slope
                    change = (moment[name] / (1 - 0.9**step)) / (
                        np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8
                    )
                    self.weights[name] = (self.weights[name] - _RATE * change).astype(
                        np.float32
                    )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """A network with its temperature and the threshold of each kind."""

    def __init__(self, network: Network, temperature: float, thresholds: list[float]):
        self.network = network
        self.temperature, self.thresholds = temperature, thresholds

    def score(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of a secret, and the likeliest kind, of each window."""
        p = softmax(self.network.logits(codes) / self.temperature)
        return np.round(1 - p[:, 0], 6), p[:, 1:].argmax(axis=1)

    def dumps(self) -> bytes:
        file = io.BytesIO()
        np.savez(
            file,
            temperature=self.temperature,
            thresholds=np.array(self.thresholds),
            **self.network.weights,
        )
        return file.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Scorer:
        held = dict(np.load(io.BytesIO(data)))
        temperature, thresholds = held.pop("temperature"), held.pop("thresholds")
        network = Network()
        network.weights = held
        return cls(network, float(temperature), thresholds.tolist())


def train(codes: np.ndarray, labels: np.ndarray, held_out: np.ndarray) -> Scorer | None:
    """Fit, calibrate and set thresholds; None where one side has no findings.

    Label 0 is no secret, k + 1 the kind of rule k.
    """
    codes, labels, held_out = _moved(codes, labels, held_out)
    learned = ~held_out
    if not (labels[learned] == 0).any() or not (labels[learned] > 0).any():
        return None
    if not (labels[held_out] > 0).any():
        return None
    network = Network()
    network.fit(codes[learned], labels[learned])
    network = network.rounded()
    z, y = network.logits(codes[held_out]), labels[held_out]
    rows = np.arange(len(y))
    temperature = min(
        _TEMPERATURES,
        key=lambda t: -np.log(np.maximum(softmax(z / t)[rows, y], 1e-12)).mean(),
    )
    scorer = Scorer(network, temperature, [])
    scores, _ = scorer.score(codes[held_out])
    for kind in range(1, 1 + len(RULES)):
        own = scores[y == kind]
        own = np.sort(own if len(own) >= _LEAST_HELD else scores[y > 0])
        scorer.thresholds.append(max(0.5, float(own[int((1 - RECALL) * len(own))])))
    return scorer


def _moved(codes, labels, held_out):
    """With each found run with a digit a second time, behind the context of another."""
    digit = (codes[:, LEFT : LEFT + VALUE] > 16) & (codes[:, LEFT : LEFT + VALUE] < 27)
    found = np.flatnonzero((labels > 0) & digit.any(axis=1))
    parts = [(codes, labels, held_out)]
    for part in (False, True):
        own = found[held_out[found] == part]
        others = np.flatnonzero((labels == 0) & (held_out == part))
        if len(own) and len(others):
            again = codes[own].copy()
            again[:, :LEFT] = codes[others[np.arange(len(own)) % len(others)], :LEFT]
            parts.append((again, labels[own], held_out[own]))
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Slice:
    """A few texts joined by line ends, which no run and no rule crosses."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = b"\n".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.lows = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.highs = self.lows + lengths
        self.rules = [rule_spans(t) for t in texts]
        self.starts, self.ends = run_spans(self.data)
        self.row = np.searchsorted(self.lows, self.starts, "right") - 1
        self.windows = Windows(
            self.data, self.starts, self.ends, self.lows[self.row], self.highs[self.row]
        )

    def labels(self) -> np.ndarray:
        """0, or 1 + the rule whose value the run touches; of several the last one."""
        labels = np.zeros(len(self.starts), dtype=np.int64)
        for row, found in enumerate(self.rules):
            for kind, low, high in sorted(
                (RULES.index(span[0]), *value) for span, value in found
            ):
                labels[self._touching(row, low, high)] = kind + 1
        return labels

    def _touching(self, row: int, low: int, high: int) -> slice:
        low, high = self.lows[row] + low, self.lows[row] + high
        return slice(
            int(np.searchsorted(self.ends, low, "right")),
            int(np.searchsorted(self.starts, high, "left")),
        )

    def found(self, scorer: Scorer | None) -> list[list[dict]]:
        """Each text's findings in code points, by start, then kind."""
        extra: list[list[tuple[int, int, float]]] = [[] for _ in self.texts]
        if scorer and len(self.starts):
            scored = [scorer.score(codes) for codes in self.windows.blocks()]
            scores = np.concatenate([s for s, _ in scored])
            kinds = np.concatenate([k for _, k in scored])
            passed = scores >= np.array(scorer.thresholds)[kinds]
            best = np.zeros(len(self.starts))
            np.maximum.at(best, self.windows.owner[passed], scores[passed])
            for row, rules in enumerate(self.rules):
                for (_, low, high), _ in rules:
                    best[self._touching(row, low, high)] = 0
            for k in np.flatnonzero(best):
                row = self.row[k]
                low = self.lows[row]
                extra[row].append(
                    (int(self.starts[k] - low), int(self.ends[k] - low), float(best[k]))
                )
        return [
            _in_code_points(text, [span for span, _ in rules], more)
            for text, rules, more in zip(self.texts, self.rules, extra)
        ]


def _in_code_points(text: bytes, rules: list[Span], extra) -> list[dict]:
    order = {kind: k for k, kind in enumerate((*RULES, MODEL))}
    found = [(start, order[kind], end, kind, None) for kind, start, end in rules]
    found += [(start, order[MODEL], end, MODEL, score) for start, end, score in extra]
    found.sort(key=lambda f: f[:3])
    places, at, points = {}, 0, 0
    for offset in sorted({f[0] for f in found} | {f[2] for f in found}):
        part = np.frombuffer(text, np.int8, offset - at, at)
        points += int(np.count_nonzero(part >= -64))
        places[offset] = points
        at = offset
    return [
        {"kind": kind, "start": places[start], "end": places[end], "score": score}
        for start, _, end, kind, score in found
    ]


def _slices(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
            texts = part.column(column).cast(pa.binary()).to_pylist()
            yield part, _Slice([t or b"" for t in texts])


def all_findings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(label, codes) of all documents, each different window once, written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _slices(batches, 0):
            labels = part.labels()[part.windows.owner]
            at = 0
            for codes in part.windows.blocks():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(labels[at : at + len(codes)], pa.int32()),
                        pa.array([row.tobytes() for row in codes], pa.binary()),
                    ],
                    names=["label", "codes"],
                )
                at += len(codes)

    return materialize(
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(rows, "label int, codes binary")
        .groupBy("codes")
        .agg(F.max("label").alias("label")),
        "windows",
    )


def label_findings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(label, codes) of a bounded sample of documents, for `fit`: one task learns them."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 31)) / float(1 << 31)
    windows = all_findings(docs.where(draw < share), id_col=id_col, text_col=text_col)
    kept = F.lit(0.0)
    for row in windows.groupBy("label").count().collect():
        part = _limit(row["label"]) * _MARGIN / row["count"]
        kept = F.when(F.col("label") == row["label"], part).otherwise(kept)
    place = F.pmod(F.xxhash64("codes"), F.lit(1 << 31)) / float(1 << 31)
    return windows.where(place < kept).select("label", "codes")


def _limit(label: int) -> int:
    return PER_KIND if label else NEGATIVES


def bounded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of exactly as many rows as the limits allow, first by hash."""
    marked = sorted(
        (xxhash.xxh3_64_intdigest(codes), codes, label)
        for codes, label in zip(rows["codes"].to_pylist(), rows["label"].to_pylist())
    )
    left = {label: _limit(label) for _, _, label in marked}
    chosen = []
    for _, codes, label in marked:
        if left[label] > 0:
            left[label] -= 1
            chosen.append((codes, label))
    codes = np.frombuffer(b"".join(c for c, _ in chosen), np.uint8).reshape(-1, WIDTH)
    return codes, np.array([label for _, label in chosen], dtype=np.int64)


def fit(findings: DataFrame) -> Scorer | None:
    """A scorer trained in one task, on the bounded sample of `label_findings`."""

    def one(rows: pa.Table) -> pa.Table:
        codes, labels = bounded(rows)
        digests = [xxhash.xxh3_64_intdigest(row.tobytes(), seed=9) for row in codes]
        held_out = np.array([d % _HELD_OUT == 0 for d in digests], dtype=bool)
        scorer = train(codes, labels, held_out)
        return pa.table({"model": pa.array([scorer.dumps()] if scorer else [], pa.binary())})

    dealt = findings.withColumn("part", F.lit(0))
    trained = dealt.groupBy("part").applyInArrow(one, "model binary").collect()
    return Scorer.loads(trained[0]["model"]) if trained else None


def fit_all(windows: DataFrame) -> Scorer | None:
    """A scorer from every row of `all_findings`: no row is left out and no task has all.

    Rows are dealt by hash to parts of about `PART_ROWS`. In a round every part goes on from
    the same weights, and their average, weighted by rows, is the next round's start. The
    temperature and the thresholds come from the held-out findings of all parts. Sums are of
    whole numbers, so that reruns agree.
    """
    total = windows.count()
    parts = max(1, -(-total // PART_ROWS))
    place = F.pmod(F.xxhash64("codes"), F.lit(parts)).cast("int")
    held = F.pmod(F.xxhash64("codes", F.lit(9)), F.lit(_HELD_OUT)) == 0
    dealt = materialize(
        windows.select("label", "codes", held.alias("held"), place.alias("part")), "dealt"
    )
    counts = {
        (row["held"], row["label"] > 0): row["count"]
        for row in dealt.groupBy("held", (F.col("label") > 0).alias("label")).count().collect()
    }
    if not all(k in counts for k in ((False, False), (False, True), (True, True))):
        return None
    shares = np.zeros(1 + len(RULES))
    for row in dealt.where("NOT held").groupBy("label").count().collect():
        # Found runs come a second time, behind another context.
        shares[row["label"]] = row["count"] * (2 if row["label"] else 1)
    rounds, epochs = (1, _EPOCHS) if parts == 1 else (_ROUNDS, _ROUND_EPOCHS)
    network = Network()
    for number in range(rounds):
        network = _averaged(dealt, network, shares, epochs, seed=4 + number)
    return _calibrated(dealt, network.rounded())


def _part_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and held-out marks of a part, in the order of their codes, and moved."""
    rows = rows.sort_by("codes")
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    labels = rows["label"].to_numpy().astype(np.int64)
    return _moved(codes, labels, rows["held"].to_numpy())


_SUMMED = {"place": np.int32, "weight": np.int64, "n": np.int64}


def _averaged(
    dealt: DataFrame, network: Network, shares: np.ndarray, epochs: int, seed: int
) -> Network:
    """The average of what the parts make of the network in some epochs."""
    start = network.weights

    def one(rows: pa.Table) -> pa.Table:
        codes, labels, held = _part_of(rows)
        codes, labels = codes[~held], labels[~held]
        if not len(labels):
            return pa.table({name: np.zeros(0, kind) for name, kind in _SUMMED.items()})
        own = Network()
        own.weights = {name: values.copy() for name, values in start.items()}
        own.fit(codes, labels, seed, epochs=epochs, shares=shares)
        flat = np.concatenate([own.weights[name].ravel() for name in sorted(start)])
        weight = np.round(flat.astype(np.float64) * _UNITS).astype(np.int64) * len(labels)
        return pa.table(
            {
                "place": np.arange(len(flat), dtype=np.int32),
                "weight": weight,
                "n": np.full(len(flat), len(labels), dtype=np.int64),
            }
        )

    made = dealt.groupBy("part").applyInArrow(one, "place int, weight bigint, n bigint")
    totals = made.groupBy("place").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    rows = sorted(totals.collect())  # a row for each weight, whatever the table holds
    flat = np.array([row["weight"] / row["n"] / _UNITS for row in rows])
    other, at = Network(), 0
    for name in sorted(start):
        shape = start[name].shape
        size = int(np.prod(shape))
        other.weights[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return other


def _calibrated(dealt: DataFrame, network: Network) -> Scorer:
    """The temperature and the thresholds from all held-out findings."""

    def losses(rows: pa.Table) -> pa.Table:
        codes, labels, held = _part_of(rows)
        z, y = network.logits(codes[held]), labels[held]
        at = np.arange(len(y))
        sums = [
            -np.log(np.maximum(softmax(z / t)[at, y], 1e-12)) * _UNITS if len(y) else np.zeros(0)
            for t in _TEMPERATURES
        ]
        return pa.table(
            {
                "place": np.arange(len(sums), dtype=np.int32),
                "loss": np.array([np.round(x).astype(np.int64).sum() for x in sums], np.int64),
            }
        )

    by_part = dealt.groupBy("part").applyInArrow(losses, "place int, loss bigint")
    summed = by_part.groupBy("place").agg(F.sum("loss").alias("loss")).collect()
    best = min(summed, key=lambda row: (row["loss"], row["place"]))["place"]
    scorer = Scorer(network, _TEMPERATURES[best], [])
    model = scorer.dumps()

    def scores(rows: pa.Table) -> pa.Table:
        codes, labels, held = _part_of(rows)
        found = held & (labels > 0)
        values, _ = Scorer.loads(model).score(codes[found])
        return pa.table(
            {
                "label": labels[found],
                "score": np.round(values * 1e6).astype(np.int64),
            }
        )

    scored = materialize(
        dealt.groupBy("part").applyInArrow(scores, "label bigint, score bigint"), "scores"
    )
    numbers = {row["label"]: row["count"] for row in scored.groupBy("label").count().collect()}
    for kind in range(1, 1 + len(RULES)):
        own, n = scored.where(F.col("label") == kind), numbers.get(kind, 0)
        if n < _LEAST_HELD:
            own, n = scored, sum(numbers.values())
        scorer.thresholds.append(max(0.5, _nth(own, int((1 - RECALL) * n)) / 1e6))
    return scorer


def _nth(scored: DataFrame, n: int) -> int:
    """The score with n scores before it: the thousandth it is in, then the score itself."""
    bound, low, high = n, 0, 1_000_001
    for width in (1000, 1):
        bins = (
            scored.where(F.col("score").between(low, high - 1))
            .groupBy(F.expr(f"score div {width}").alias("bin"))
            .count()
            .collect()  # at most 1001 rows
        )
        for row in sorted(bins):
            if bound < row["count"]:
                break
            bound -= row["count"]
        low, high = row["bin"] * width, (row["bin"] + 1) * width
    return low


def scan(
    docs: DataFrame, scorer: Scorer | None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and the findings of every row: kind, start, end (exclusive) and score."""
    model = scorer.dumps() if scorer else None  # a few thousand weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer.loads(model) if model else None
        for batch, part in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(part.found(own), _FOUND_TYPE)],
                names=["doc_id", "findings"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(rows, f"doc_id bigint, findings {_FOUND}")


def find_secrets(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id and findings: those of the rules, and the network's, trained on `docs`."""
    return scan(docs, fit_all(all_findings(docs, **columns)), **columns)
