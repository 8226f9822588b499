"""Exact set similarity among texts: a join without buckets, and a keep rule in blocks.

*Who meets.* Sets are dealt to classes by size: a class ends where a set one gram larger
could no longer reach the threshold with the class's least, so that similar sets are of one
class or of neighbouring ones. Sets of two sizes that are similar differ in a bounded number
of grams (Arasu, Ganti, Kaushik 2006). The parities of the numbers of grams in each of 2^k
places differ at most as often, so they rule pairs out and lose no link, unlike bands of a
MinHash signature. They are as long as the set has grams, one to two bits each. Rows are cut
into blocks by size and leanings; two blocks in which these allow a similar pair are a cell,
which Spark deals to a task. A leaning is a sum over the grams of +1 or -1, so that similar
sets differ as little in it as in their grams. Which grams lean which way is learned from a
bounded sample (`leanings`), so that rows of another language or kind lie far apart; how
well it is learned decides how many blocks meet, and never what is found. In a cell a part
of the places, as long as the cell's own distances ask for, is compared by a product of
matrices, and all places for the pairs that are left. No gram and no text is shuffled for a
pair that they rule out, and nothing that grows with the grams is written. Comparing is
quadratic in the rows of a class and kind; blocks grow with the rows up to CELL_ROWS, which
keeps the cells few that the parities of a row are sent to.

*Who stays.* The rule of `near_dup`: by rank, a row is dropped when it is similar to a row
kept before it. Undecided rows similar to one that stays are dropped, with that row as their
link.

In lists (`settle_in_blocks`), a round takes the first `block` undecided rows of every list. A
row that is among them in all its lists has met everyone before it there: it stays if it is
similar to none of them. Only pairs with one of these rows are looked at, the block doubles
every round, and a list of n rows that are all unlike one another is settled in
log2(n / block) rounds.

Where all rows may meet (`settle_in_windows`), a round takes the first undecided rows of all.
Each is compared with the few first rows before it that it may be similar to: it stays if it
is similar to none, and waits for a later round if there are more of them than were looked at.
So copies of one text are never listed in pairs, and every pair of rows that stay is compared
once.

Only narrow rows are put in order of rank; texts stay where they were written, and are
written once more for the rows that met someone. A round moves the texts of its own pairs and
no others. Rows with many meetings are dealt to many tasks; gram sets are made where two texts
have come together.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.minhash import gram_codes
from labelloom.functions.text import in_slices
from labelloom.operators.joins import (
    FEW_ROWS,
    broadcast_if_few,
    hot_keys,
    join_dealing_hot_keys,
    join_splitting_hot_keys,
)
from labelloom.session import materialize

# Least number of parities of a set.
LEAST_BITS = 256
# Of a block's rows and parities the most; blocks are smaller where cells would be too few.
CELL_ROWS, CELL_BITS = 1 << 16, 1 << 27
LEAST_CELL_ROWS, CELLS_PER_CORE = 2048, 6
# Leanings of a set, the places of its grams that they are sums over, and the rows that tell
# which way a place leans.
LEANINGS, LEAN_PLACES, LEAN_SAMPLE = 4, 1 << 14, 512
# Pairs of rows for which a task is worth starting.
TASK_PAIRS = 1 << 22
# Rows by leaders that are compared at one time, and pairs.
_ROWS, _LEADERS, _PAIRS = 1024, 2048, 1 << 16
# First undecided rows of a list that the first round looks at.
BLOCK = 64
# First undecided rows of all, where rows meet by size, and how fast they grow by the round.
WINDOW, GROWTH = 1 << 16, 8
# Earlier rows of a block that a row of the window is compared with in one round.
EARLIEST = 4

# The column by which a row that has been written is found again.
NUMBER = "_number"

# Pairs (id, leader) to those of them that are similar.
Similar = Callable[[DataFrame], DataFrame]
# Memberships of rows and of leaders, and their number, to pairs (id, leader) of a list.
Meetings = Callable[..., DataFrame]


@dataclass(frozen=True)
class Settled:
    """The outcome of the keep rule for rows that met at least one other row."""

    decided: DataFrame  # (id, kept, leader)
    rounds: int


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The frame with a distinct NUMBER for each row, written once where the rows are."""
    return materialize(df.withColumn(NUMBER, F.monotonically_increasing_id()), name)


def in_rank_order(df: DataFrame, rank: Column, *columns: str) -> DataFrame:
    """(id, rank, columns): ids that rise with the rank, written once.

    Everything is sorted: `columns` should be narrow.
    """
    ranked = df.select(rank.alias("rank"), *columns).orderBy("rank")
    return materialize(
        ranked.select(F.monotonically_increasing_id().alias("id"), "*"), "ranked"
    )


def size_classes(threshold: float, largest: int = 1 << 31) -> list[int]:
    """The least size of each class."""
    starts = [1]
    while starts[-1] < largest:
        starts.append(math.floor(starts[-1] / threshold + 1e-9) + 1)
    return starts


def _class_bits(starts: list[int]) -> np.ndarray:
    """Parities of the sets of each class, a power of two that never falls."""
    return np.array([max(LEAST_BITS, 1 << (start - 1).bit_length()) for start in starts])


def parities(grams: np.ndarray, bits: int) -> bytes:
    """Whether the number of grams is odd, in each of `bits` places.

    Folding the halves onto one another gives the parities in half as many places.
    """
    mixed = (grams ^ (grams >> np.uint64(31))) * _MIX
    at = (mixed >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _lean_places(grams: np.ndarray) -> np.ndarray:
    mixed = (grams ^ (grams >> np.uint64(29))) * _MIX
    return ((mixed >> np.uint64(24)) & np.uint64(LEAN_PLACES - 1)).astype(np.int64)


def leanings(df: DataFrame, *, text: str, n_gram: int) -> np.ndarray:
    """+1 or -1 for each place by leaning: the signs of the sample's principal components.

    The sample is of at most LEAN_SAMPLE texts, of which the first characters are read.
    """
    share = LEAN_SAMPLE / max(1, df.count())
    order = F.xxhash64(F.lit(3), text)
    some = df.where(F.pmod(order, F.lit(1 << 20)) < F.lit(min(1.0, 2 * share) * (1 << 20)))
    texts = some.orderBy(order).limit(LEAN_SAMPLE).select(F.substring(text, 1, 20000)).collect()
    rows = np.zeros((max(1, len(texts)), LEAN_PLACES), dtype=np.float32)
    for i, (value,) in enumerate(texts):
        rows[i] = np.bincount(_lean_places(gram_codes(value or "", n_gram)), minlength=LEAN_PLACES)
        rows[i] /= np.linalg.norm(rows[i])
    rows -= rows.mean(axis=0)
    _, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    made = vectors[:, ::-1][:, :LEANINGS].T.astype(np.float32) @ rows
    made = np.vstack([made, np.zeros((LEANINGS - len(made), LEAN_PLACES), np.float32)])
    return np.where(made < 0, -1, 1).astype(np.int8)


_MIX = np.uint64(0x9E6C63D0676A9A99)
_SKETCHED = T.StructType(
    [
        T.StructField("size", T.IntegerType()),
        T.StructField("size_class", T.IntegerType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("lean", T.ArrayType(T.IntegerType())),
    ]
)


def sized(
    df: DataFrame,
    *,
    text: str,
    threshold: float,
    n_gram: int,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """(id, size, size_class, bits, lean) of (id, text), written once.

    `bits` has as many parities as the next class up compares. With `ranked`, which has id and
    NUMBER, the rows are (NUMBER, text) and get their id from there.
    """
    starts = size_classes(threshold)
    class_bits = _class_bits([*starts, starts[-1] + 1])
    signs = leanings(df, text=text, n_gram=n_gram)

    @F.arrow_udf(_SKETCHED)
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, classes, bits, lean = [], [], [], []
        for value in chain.from_iterable(part.to_pylist() for part in in_slices(texts)):
            grams = gram_codes(value or "", n_gram)
            own = int(np.searchsorted(starts, len(grams), "right"))
            sizes.append(len(grams))
            classes.append(own)
            # Class numbers begin at 1: this is the next class.
            bits.append(parities(grams, int(class_bits[own])))
            lean.append(signs[:, _lean_places(grams)].sum(axis=1, dtype=np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int32()),
                pa.array(classes, pa.int32()),
                pa.array(bits, pa.binary()),
                pa.array(lean, pa.list_(pa.int32())),
            ],
            names=["size", "size_class", "bits", "lean"],
        )

    key = "id" if ranked is None else NUMBER
    made = df.select(key, sketch.asNondeterministic()(F.col(text)).alias("made"))
    if ranked is not None:
        made = made.join(ranked.select("id", NUMBER), NUMBER)
    return materialize(made.select("id", "made.*"), "sized")


def size_lists(sized_rows: DataFrame) -> DataFrame:
    """(id, list, guest, size, place): each row in its own class and in the next one."""
    stays = F.array(
        *[
            F.struct((F.col("size_class") + k).alias("list"), F.lit(bool(k)).alias("guest"))
            for k in (0, 1)
        ]
    )
    return sized_rows.withColumn("stay", F.explode(stays)).select(
        "id", "stay.list", "stay.guest", "size", F.lit(None).cast("int").alias("place")
    )


@dataclass(frozen=True)
class _Block:
    """Rows of one size class that go to a cell together."""

    least: int  # sizes
    most: int
    low: np.ndarray  # leanings
    high: np.ndarray
    rows: int


def _banded(rows: DataFrame, apart: float) -> DataFrame:
    """Adds `band`: the size cut to its five leading bits, and leanings in steps of that size."""
    step = F.expr("shiftleft(1, greatest(length(bin(size)) - 5, 0))")
    cut = F.col("size") - F.col("size") % step
    wide = F.greatest(F.lit(1.0), cut * F.lit(3 * apart))
    steps = F.transform("lean", lambda x: F.round(x / wide).cast("int").cast("string"))
    return rows.withColumn(
        "band", F.concat_ws("/", steps, F.lpad(cut.cast("string"), 10, "0"))
    )


def _blocks(
    counted: list[Row], class_bits: np.ndarray, side: int
) -> tuple[list[_Block], list[tuple[int, str, int, int]]]:
    """Blocks of at most `side` rows, and (size_class, band, first block, blocks).

    A band with more rows than a block is dealt to several blocks. Bands of other leanings
    only share a block if it stays small.
    """
    blocks: list[_Block] = []
    places = []
    before = None
    for row in sorted(counted, key=lambda r: (r["size_class"], r["band"])):
        most = min(side, max(1, CELL_BITS // int(class_bits[row["size_class"]])))
        kind = row["size_class"], row["band"].rpartition("/")[0]
        low, high = np.array(row["low"]), np.array(row["high"])
        least, largest = row["least"], row["most"]
        parts = -(-row["n"] // most)
        number = len(blocks)
        if parts == 1 and before and before[0] == kind[0]:
            last = blocks[-1]
            if last.rows + row["n"] <= (most if before == kind else min(most, LEAST_CELL_ROWS)):
                number -= 1
                least, largest = min(least, last.least), max(largest, last.most)
                low, high = np.minimum(low, last.low), np.maximum(high, last.high)
                row_count = last.rows + row["n"]
                blocks[-1] = _Block(least, largest, low, high, row_count)
        if number == len(blocks):
            blocks += [_Block(least, largest, low, high, -(-row["n"] // parts))] * parts
        places.append((row["size_class"], row["band"], number, parts))
        before = kind
    return blocks, places


def _cells(
    blocks: list[_Block], others: list[_Block], threshold: float, same: bool
) -> list[tuple[int, int]]:
    """The numbers of two blocks in which sizes and leanings allow a similar pair.

    Once for two blocks if both sides are the same.
    """
    if not blocks or not others:
        return []
    apart = (1 - threshold) / (1 + threshold)
    least, most, low, high = (
        np.array([getattr(b, name) for b in others]) for name in ("least", "most", "low", "high")
    )
    cells = []
    for i, one in enumerate(blocks):
        meet = (one.most >= threshold * least - 1e-6) & (most >= threshold * one.least - 1e-6)
        gap = np.maximum(one.low - high, low - one.high).max(axis=1)
        meet &= gap <= apart * (one.most + most) + 1e-6
        if same:
            meet[i + 1 :] = False
        cells += [(i, int(j)) for j in np.flatnonzero(meet)]
    return cells


def by_parities(sized_rows: DataFrame, *, threshold: float) -> Meetings:
    """Meetings of rows whose sizes, leanings and parities allow that they are similar.

    Of `rows` and `leaders` only the id is used. With `most`, a row gets so many of the first
    leaders of a block, and the leader -1 besides if there are more.
    """
    class_bits = _class_bits([*(starts := size_classes(threshold)), starts[-1] + 1])
    apart = (1 - threshold) / (1 + threshold)

    def compare(left: pa.Table, right: pa.Table, same: bool, most: int) -> pa.Table:
        found = _Found(most)
        if left.num_rows and right.num_rows:
            a, b = _Side.of(left), _Side.of(right)
            largest = int(max(a.size.max(), b.size.max()))
            bits = max(LEAST_BITS, min(a.bits, b.bits, 1 << (largest - 1).bit_length()))
            a, b = a.folded(bits), b.folded(bits)
            # Two blocks of the same rows are compared once, whichever row is the first.
            either = same and not np.array_equal(a.id, b.id)
            for i, j in _close(a, b, apart, either):
                small, large = np.minimum(a.size[i], b.size[j]), np.maximum(a.size[i], b.size[j])
                ok = small >= threshold * large - 1e-6
                ids, leaders = a.id[i[ok]], b.id[j[ok]]
                if either:
                    ids, leaders = np.maximum(ids, leaders), np.minimum(ids, leaders)
                found.add(ids, leaders)
        return found.table()

    def meetings(
        rows: DataFrame, leaders: DataFrame, total: int, most: int = 0
    ) -> DataFrame:
        spark, same = rows.sparkSession, rows is leaders

        def side(frame: DataFrame) -> tuple[DataFrame, list[Row]]:
            ids = broadcast_if_few(materialize(frame.select("id").distinct(), "ids"))
            banded = _banded(sized_rows.join(ids, "id"), apart)
            counted = banded.groupBy("size_class", "band").agg(
                F.count("*").alias("n"),
                F.min("size").alias("least"),
                F.max("size").alias("most"),
                F.array(*[F.min(F.col("lean")[k]) for k in range(LEANINGS)]).alias("low"),
                F.array(*[F.max(F.col("lean")[k]) for k in range(LEANINGS)]).alias("high"),
            )
            # A few hundred rows for each size class: similar sizes, leanings in steps.
            return banded, counted.collect()

        left, left_counts = side(rows)
        right, right_counts = (left, left_counts) if same else side(leaders)
        cores, largest = spark.sparkContext.defaultParallelism, CELL_ROWS
        while True:
            blocks, places = _blocks(left_counts, class_bits, largest)
            others, other_places = _blocks(right_counts, class_bits, largest)
            cells = _cells(blocks, others, threshold, same)
            if len(cells) >= CELLS_PER_CORE * cores or largest <= LEAST_CELL_ROWS:
                break
            largest //= 2
        if not cells:
            return rows.select("id", F.col("id").alias("leader")).limit(0)

        pairs = sum(blocks[i].rows * others[j].rows for i, j in cells)
        tasks = min(len(cells), 8 * cores, 1 + pairs // TASK_PAIRS)

        def dealt(frame: DataFrame, places: list, column: int) -> DataFrame:
            of: dict[int, list[int]] = {}
            for cell, numbers in enumerate(cells):
                of.setdefault(numbers[column], []).append(cell)
            place = spark.createDataFrame(
                places, "size_class int, band string, first int, parts int"
            )
            cells_of = spark.createDataFrame(list(of.items()), "block int, cells array<int>")
            part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
            return (
                frame.join(F.broadcast(place), ["size_class", "band"])
                .withColumn("block", F.col("first") + part)
                .join(F.broadcast(cells_of), "block")
                .select("id", "size", "bits", F.explode("cells"))
                .toDF("id", "size", "bits", "cell")
                .repartition(tasks, "cell")
                .groupBy("cell")
            )

        met = dealt(left, places, 0).cogroup(dealt(right, other_places, 1))
        return met.applyInArrow(
            lambda a, b: compare(a, b, same, most), "id bigint, leader bigint"
        )

    return meetings


@dataclass(frozen=True)
class _Side:
    """The rows of a block by id, with parities in words of 64 bits."""

    id: np.ndarray
    size: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Side:
        blobs = table["bits"].combine_chunks()
        blobs = blobs.chunk(0) if isinstance(blobs, pa.ChunkedArray) else blobs
        ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset :][: len(blobs) + 1]
        held = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        # Rows of one size class have parities in as many places.
        words = held.reshape(len(blobs), -1)
        ids = table["id"].to_numpy()
        order = np.argsort(ids)
        words = np.ascontiguousarray(words[order]).view(np.uint64)
        return cls(ids[order], table["size"].to_numpy()[order].astype(np.int64), words)

    @property
    def bits(self) -> int:
        return self.words.shape[1] * 64

    def folded(self, bits: int) -> _Side:
        halves = self.words.reshape(len(self.words), -1, bits // 64)
        return _Side(self.id, self.size, np.bitwise_xor.reduce(halves, axis=1))

    def signs(self, rows: slice, bits: int, *more: np.ndarray | float) -> np.ndarray:
        """1 and -1 for the parities in the first places, and further columns."""
        words = np.ascontiguousarray(self.words[rows, : -(-bits // 64)])
        made = np.empty((len(words), bits + len(more)), np.float32)
        made[:, :bits] = np.unpackbits(words.view(np.uint8), axis=1, count=bits)
        made[:, :bits] *= 2
        made[:, :bits] -= 1
        for k, column in enumerate(more):
            made[:, bits + k] = column
        return made


class _Found:
    """Pairs (id, leader), of each id at most the `most` first leaders if it is not 0."""

    def __init__(self, most: int):
        self.most = most
        self.pairs = [np.zeros((2, 0), np.int64)]
        self.held, self.limit = 0, _PAIRS
        self.more = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, leaders: np.ndarray) -> None:
        self.pairs.append(np.stack([ids, leaders]))
        self.held += len(ids)
        if self.most and self.held > self.limit:
            self.cut()

    def cut(self) -> None:
        ids, leaders = np.concatenate(self.pairs, axis=1)
        order = np.lexsort((leaders, ids))
        ids, leaders = ids[order], leaders[order]
        turn = np.arange(len(ids)) - np.searchsorted(ids, ids)
        few = turn < self.most
        self.more = np.union1d(self.more, ids[~few])
        self.pairs = [np.stack([ids[few], leaders[few]])]
        self.held = int(few.sum())
        self.limit = max(_PAIRS, 2 * self.held)

    def table(self) -> pa.Table:
        if self.most:
            self.cut()
        ids, leaders = np.concatenate(self.pairs, axis=1)
        none = np.full(len(self.more), -1)
        return pa.table(
            {
                "id": np.concatenate([ids, self.more]),
                "leader": np.concatenate([leaders, none]),
            }
        )


def _close(
    a: _Side, b: _Side, apart: float, either: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of rows that differ in no more places than similar ones of their sizes can.

    Unless `either` of them may be the first, the row of `b` is.
    """
    few_a, few_b, bits = _screen(a, b, apart)
    # The product of two rows with their last columns is what the distance lacks, twice.
    slack = 0.5 + 1e-6 * (bits + a.size.max() + b.size.max())
    product = np.empty((_ROWS, _LEADERS), np.float32)
    left = np.empty(product.shape, bool)
    for k in range(0, len(b.id), _LEADERS):
        leaders = few_b.signs(slice(k, k + _LEADERS), bits, 1, 2 * apart * b.size[k : k + _LEADERS])
        for n in range(0, len(a.id), _ROWS):
            if not either and a.id[n : n + _ROWS][-1] <= b.id[k]:
                continue
            rows = few_a.signs(slice(n, n + _ROWS), bits, 2 * apart * a.size[n : n + _ROWS], 1)
            shape = len(rows), len(leaders)
            sums = product.ravel()[: shape[0] * shape[1]].reshape(shape)
            near = left.ravel()[: sums.size].reshape(shape)
            np.matmul(rows, leaders.T, out=sums)
            np.greater_equal(sums, bits - slack, out=near)
            for at in _slices(np.flatnonzero(near)):
                i, j = np.divmod(at, shape[1])
                i, j = i + n, j + k
                if not either:
                    after = a.id[i] > b.id[j]
                    i, j = i[after], j[after]
                far = np.bitwise_count(a.words[i] ^ b.words[j]).sum(axis=1, dtype=np.int64)
                ok = far <= (a.size[i] + b.size[j]) * apart + 1e-6
                yield i[ok], j[ok]


def _slices(found: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(found), _PAIRS):
        yield found[start : start + _PAIRS]


def _screen(a: _Side, b: _Side, apart: float) -> tuple[_Side, _Side, int]:
    """Both sides folded, and how many places at least tell most unlike rows apart.

    Found from pairs of the two blocks: it decides the time it takes, not what is found.
    """
    limit = apart * int(a.size.max() + b.size.max())
    best = a, b, a.bits
    while True:
        some_a, some_b = (x.words[:: -(-len(x.words) // 64)] for x in (a, b))
        far = np.bitwise_count(some_a[:, None] ^ some_b[None]).sum(axis=2, dtype=np.int64)
        share = float(np.quantile(far, 0.05)) / a.bits
        places = np.arange(32, a.bits, 32)
        enough = places * share - 3.3 * np.sqrt(places * share * (1 - share)) >= limit
        if enough.any() and places[enough.argmax()] < best[2]:
            best = a, b, int(places[enough.argmax()])
        if a.bits <= LEAST_BITS:
            return best
        a, b = a.folded(a.bits // 2), b.folded(b.bits // 2)


def by_jaccard(
    texts: DataFrame, ranked: DataFrame, *, text: str, threshold: float, n_gram: int
) -> Similar:
    """Compares pairs of rows on their whole gram sets.

    `texts` has NUMBER and the text, `ranked` the id of each NUMBER.
    """
    made: list[DataFrame] = []

    @F.arrow_udf(T.BooleanType())
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        found, start = [], 0
        for part in in_slices(left):
            others = right.slice(start, len(part)).to_pylist()
            start += len(part)
            known: dict[str, np.ndarray] = {}
            for pair in zip(part.to_pylist(), others):
                for value in pair:
                    if value not in known:
                        known[value] = gram_codes(value or "", n_gram)
                a, b = (known[value] for value in pair)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                found.append(shared / (len(a) + len(b) - shared) >= threshold)
                if len(known) > _KNOWN:
                    known.clear()
        return pa.array(found, pa.bool_())

    def texts_of(wanted: DataFrame, leads: bool) -> DataFrame:
        """(id, text) of one side of the pairs; where they are many, the join picks them out."""
        of = functools.reduce(DataFrame.unionAll, made).select("id", text)
        if wanted.count() > FEW_ROWS:
            return of
        ids = wanted.where(F.col("leads") == leads).select("id")
        return of.join(F.broadcast(ids), "id", "left_semi")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        sides = F.array(
            F.struct("id", F.lit(False).alias("leads")),
            F.struct(F.col("leader").alias("id"), F.lit(True).alias("leads")),
        )
        wanted = materialize(pairs.select(F.inline(sides)).distinct(), "wanted")
        fresh = wanted.select("id").distinct()
        if made:
            known = functools.reduce(DataFrame.unionAll, made).select("id")
            fresh = fresh.join(known, "id", "left_anti")
        fresh = ranked.select("id", NUMBER).join(
            broadcast_if_few(materialize(fresh, "fresh")), "id"
        )
        fresh = materialize(fresh, "fresh-numbers")
        met = texts.join(broadcast_if_few(fresh), NUMBER).select("id", text)
        made.append(materialize(met, "met-texts"))
        left = texts_of(wanted, False).withColumnRenamed(text, "a")
        right = texts_of(wanted, True).toDF("leader", "b")
        both = join_dealing_hot_keys(pairs, left, "id", "leader", hot_keys(pairs, "id"))
        both = join_dealing_hot_keys(
            both, right, "leader", "id", hot_keys(pairs, "leader")
        )
        compared = both.select("id", "leader", alike.asNondeterministic()("a", "b").alias("alike"))
        return materialize(compared.where("alike").select("id", "leader"), "alike")

    return similar


# Gram sets that are kept while a slice of pairs is compared.
_KNOWN = 64


def in_shared_lists(lists: DataFrame) -> DataFrame:
    """The memberships in lists of two rows or more, written once."""
    lists = materialize(lists, "lists")
    sizes = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    shared = join_splitting_hot_keys(lists, sizes, "list", lists.count()).drop("n")
    return materialize(shared, "shared")


def settle_in_blocks(
    lists: DataFrame,
    similar: Similar,
    *,
    threshold: float,
    block: int = BLOCK,
    meetings: Meetings | None = None,
) -> Settled:
    """The keep rule over (id, list, guest, size, place), in rounds until all is decided.

    `guest`, `size` and `place` may be null: such rows meet everyone in their lists, unless
    `meetings` picks out who does.
    """
    meetings = meetings or functools.partial(_meetings, threshold=threshold)
    undecided = in_shared_lists(lists)
    total = undecided.count()
    # Memberships of a row; they stay the same until the row is decided.
    degrees = materialize(undecided.groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    outcomes, rounds = [], 0
    while not undecided.isEmpty():
        outcome = _settle_block(undecided, degrees, similar, meetings, block, total)
        rest = undecided.join(outcome.select("id"), "id", "left_anti")
        undecided = materialize(rest, "undecided")
        outcomes.append(outcome)
        block *= 2
        rounds += 1
    if not outcomes:
        empty = undecided.select("id", F.lit(True).alias("kept"), F.col("id").alias("leader"))
        return Settled(empty, 0)
    return Settled(functools.reduce(DataFrame.unionAll, outcomes), rounds)


def settle_in_windows(
    lists: DataFrame, similar: Similar, meetings: Meetings, *, window: int = WINDOW
) -> Settled:
    """The keep rule over all rows that share a list, whatever lists they are in."""
    undecided = materialize(in_shared_lists(lists).select("id").distinct(), "undecided")
    left = undecided.count()
    outcomes, rounds = [], 0
    while left:
        outcome = _settle_window(undecided, left, similar, meetings, window)
        rest = undecided.join(outcome.select("id"), "id", "left_anti")
        undecided = materialize(rest, "undecided")
        left = undecided.count()
        outcomes.append(outcome)
        window *= GROWTH
        rounds += 1
    if not outcomes:
        empty = undecided.select("id", F.lit(True).alias("kept"), F.col("id").alias("leader"))
        return Settled(empty, 0)
    return Settled(functools.reduce(DataFrame.unionAll, outcomes), rounds)


def _settle_window(
    undecided: DataFrame, left: int, similar: Similar, meetings: Meetings, window: int
) -> DataFrame:
    """(id, kept, leader) of the rows that this round decides; the first row is one."""
    first = undecided
    if left > window:
        cut = undecided.agg(F.percentile_approx("id", window / left, 10000)).first()[0]
        first = materialize(undecided.where(F.col("id") <= cut), "first")
    met = materialize(meetings(first, first, left, EARLIEST), "met")
    before = similar(met.where("leader >= 0"))
    # A row with more rows before it than it was compared with is not settled yet.
    waiting = before.select("id").unionAll(met.where("leader < 0").select("id")).distinct()
    kept = materialize(first.join(waiting, "id", "left_anti"), "kept")
    links = similar(meetings(undecided.join(kept, "id", "left_anti"), kept, left))
    dropped = links.groupBy("id").agg(F.min("leader").alias("leader"))
    return materialize(
        kept.select("id", F.lit(True).alias("kept"), F.col("id").alias("leader")).unionAll(
            dropped.select("id", F.lit(False).alias("kept"), "leader")
        ),
        "outcome",
    )


def _settle_block(
    undecided: DataFrame,
    degrees: DataFrame,
    similar: Similar,
    meetings: Meetings,
    block: int,
    total: int,
) -> DataFrame:
    """(id, kept, leader) of the rows that this round decides."""
    in_list = Window.partitionBy("list").orderBy("id")
    first = materialize(
        undecided.withColumn("turn", F.row_number().over(in_list))
        .where(F.col("turn") <= block)
        .drop("turn"),
        "first",
    )
    seen = materialize(
        first.groupBy("id")
        .agg(F.count("*").alias("n"))
        .join(degrees, "id")
        .where("n = degree")
        .select("id"),
        "seen",
    )
    before = similar(meetings(first.join(seen, "id", "left_semi"), first, total))
    kept = materialize(
        seen.join(before.select("id").distinct(), "id", "left_anti"), "kept"
    )
    leaders = materialize(first.join(kept, "id", "left_semi"), "leaders")
    # The seen rows have been compared with everyone before them.
    unseen = undecided.join(seen, "id", "left_anti")
    among_seen = before.join(kept.withColumnRenamed("id", "leader"), "leader", "left_semi")
    links = similar(meetings(unseen, leaders, total)).unionAll(
        among_seen.select("id", "leader")
    )
    dropped = links.groupBy("id").agg(F.min("leader").alias("leader"))
    return materialize(
        kept.select("id", F.lit(True).alias("kept"), F.col("id").alias("leader")).unionAll(
            dropped.select("id", F.lit(False).alias("kept"), "leader")
        ),
        "outcome",
    )


def _meetings(
    rows: DataFrame, leaders: DataFrame, total: int, *, threshold: float
) -> DataFrame:
    """Different pairs (id, leader) of a list that could be similar, the leader first.

    `leaders` has at most a block of rows for each list; those of hot lists, of which there
    are few, are broadcast. The overlap is at most the grams from the common one on, if that
    is the first one, and the pair meets there too.
    """
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    renamed = leaders.select(
        "list",
        F.col("id").alias("leader"),
        F.col("guest").alias("leader_guest"),
        F.col("size").alias("leader_size"),
        F.col("place").alias("leader_place"),
    ).join(sizes, "list")
    met = join_splitting_hot_keys(rows, renamed, "list", total)
    left = F.least(F.col("size") - F.col("place"), F.col("leader_size") - F.col("leader_place"))
    possible = left / (F.col("size") + F.col("leader_size") - left)
    return (
        met.where(F.col("leader") < F.col("id"))
        .where(~F.coalesce(F.col("guest") & F.col("leader_guest"), F.lit(False)))
        .where(F.coalesce(possible >= F.lit(threshold - 1e-9), F.lit(True)))
        .select("id", "leader")
        .distinct()
    )
