"""Near-duplicate groups from one-permutation hashing and star-shaped candidate edges.

1. *Sketch.* A row's set holds the 64-bit hashes of its distinct word shingles. One
   permutation: the upper part of a hash names its bin, the least hash of a bin is its
   value. Optimal densification fills an empty bin from a filled one, chosen by a hash of
   (bin, attempt) that all rows share, so that two rows agree in a bin with the probability
   of their Jaccard similarity. `BANDS` bands of `BAND_BINS` bins give a row's buckets; at
   similarity 0.8 two rows share no bucket with probability (1 - 0.8^5)^40 = 1.3e-7.
2. *Classes.* Rows with equal sets (128-bit digest) are one class, for which the row with
   the least id speaks. A class has a number of its own, written once with it; numbers and
   not ids are what links join, so different texts under one id stay apart. Whatever a group of copies holds, one row per class goes on.
3. *Stars.* Each bucket links its members to two centres, its least and its greatest id:
   at most two edges per member and bucket, however large the bucket is.
4. *Confirm* every edge on the full sets, find connected components.
5. *Rest.* A bucket whose members are still in several components is open. In it, each
   member outside the largest component meets all members of other components, in blocks
   inside tasks, without listing pairs. Pairs are settled by their sizes, or by parity bits
   that differ in more places than a pair at the threshold can have single shingles; the
   bits grow with the set, sets of different sizes are compared on the bits of the smaller
   one, and no link is lost by either. Of the others a task hands out a spanning forest
   only, and the connected ids are a cluster. Then each cluster's full sets meet, again
   in blocks: every pair of different components that passes the screen is compared on
   the full sets there, unless links found before already join the two, and a forest of
   the links comes out. So every pair that shares a bucket is decided on its sets, and
   buckets have no cap. A block holds `BLOCK` members, so that a bucket of n rows sends
   n / `BLOCK` times as many to its tasks as it has; what no link spares is quadratic in the
   members that the screen cannot tell apart, in compute alone.

A star's centre can have edges to any part of the table. Wherever edges meet sets or labels,
the ids with more than a `HOT_SHARE`th of all edges are dealt by the other end as well.

Defined cases: a null text and one without words have the empty set, which is linked with
nothing; fewer words than a shingle has make one shingle; null ids are never linked and
have a null component; rows that share an id are judged each by its own text; equal rows
share a class, and `drop_near_copies` keeps one of them, whatever types its columns have,
and links null ids too; a very long text has a sketch like any other and parity bits in
proportion to its shingles; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import broadcast_if_small, in_small_batches, row_key
from labelloom.operators.joins import join_splitting_hot_keys
from labelloom.session import materialize, settle

WORDS = 5
PERCENT = 80
BANDS = 40
BAND_BINS = 5
BINS = BANDS * BAND_BINS
# Rows, and shingles or their parity bits, of a block of members in one task.
BLOCK = 8192
BLOCK_SHINGLES = 2_000_000
BLOCK_BITS = 1 << 25
# Parity bits of the smallest sets; larger ones have two to four for each shingle.
PARITY_BITS = 1024
# An id with more than this part of all edges is hot; there are at most twice as many.
HOT_SHARE = 1000
_WORDS_KNOWN = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Word to hash, started anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the lower-cased text.

    Only A-Z is lowered and only ASCII white space separates words, as `bytes` does it.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    hashes = np.fromiter(
        map(known.__getitem__, parts), dtype=np.uint64, count=len(parts)
    )
    width = min(words, len(parts))
    count = len(parts) - width + 1
    value = np.full(count, width, dtype=np.uint64)
    for j in range(width):
        value = _mixed(value * _MIX + hashes[j : j + count])
    return np.unique(value)


def _probes() -> np.ndarray:
    """Bin tried by each empty bin at each attempt, the same for all rows."""
    attempts = 8 * BINS
    cells = np.arange(BINS * attempts, dtype=np.uint64) + np.uint64(1)
    return (_mixed(cells * _MIX) % np.uint64(BINS)).astype(np.int64).reshape(BINS, attempts)


_PROBES = _probes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation sketch of a non-empty sorted set."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    filled = np.zeros(BINS, dtype=bool)
    values = np.zeros(BINS, dtype=np.uint64)
    held = bins[first].astype(np.int64)
    filled[held] = True
    values[held] = hashes[first]
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        if attempt < _PROBES.shape[1]:
            tried = _PROBES[empty, attempt]
        else:  # go round the bins: ends for certain
            tried = (empty + attempt) % BINS
        met = filled[tried]
        values[empty[met]] = values[tried[met]]
        empty = empty[~met]
        attempt += 1
    return values


def buckets(values: np.ndarray) -> np.ndarray:
    """One hash per band of the sketch."""
    banded = values.reshape(BANDS, BAND_BINS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_BINS):
        out = _mixed(out * _MIX + banded[:, j])
    return out.view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each of 2^k places, two to four a shingle.

    Folding the halves onto one another gives the parities in half as many places.
    """
    places = max(PARITY_BITS, 1 << (2 * max(1, len(hashes)) - 1).bit_length())
    at = (_mixed(hashes * _MIX) & np.uint64(places - 1)).astype(np.int64)
    bits = np.bincount(at, minlength=places) & 1 == 1
    return np.packbits(bits).tobytes()


_SKETCHED = (
    "doc_id bigint, key bigint, n_shingles bigint, digest binary, bits binary, "
    "buckets array<bigint>"
)


def _sketcher(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in in_small_batches(batch, 800):
                sets = [shingles(t, words, known) for t in part.column(1).to_pylist()]
                sketches = [sketch(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                            pa.binary(),
                        ),
                        pa.array(
                            [parity(s) if len(s) else None for s in sets], pa.binary()
                        ),
                        pa.array(
                            [[] if v is None else buckets(v) for v in sketches],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    names=[c.split()[0] for c in _SKETCHED.split(", ")],
                )

    return rows


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    return _decided(docs, id_col, text_col, words, percent, block, F.col("doc_id").isNotNull()).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def _decided(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int, linked
) -> DataFrame:
    """As `near_duplicates`, with `key`, a hash of the text; only `linked` rows are linked."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("key"),
    )
    sketched = materialize(texts.mapInArrow(_sketcher(words), _SKETCHED), "near-sketches")
    total = sketched.count()
    speaker = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # One row a class: a text that fills a third of the table leaves one row a task.
    classes = (
        sketched.where(linked & (F.col("n_shingles") > 0))
        .groupBy("digest")
        .agg(
            F.min_by(F.struct(speaker.alias("rep"), "buckets", "bits", "n_shingles"), speaker)
            .alias("best"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            F.monotonically_increasing_id().alias("id"),
            F.col("digest").alias("of"),
            "best.*",
            "n",
        )
    )
    speaking = materialize(classes, "near-classes")
    classes = speaking.select("id", "of", "rep", "n")
    # Buckets that more than one class is in.
    banded = materialize(
        speaking.select("id", F.explode("buckets").alias("bucket")), "near-banded"
    )
    shared = banded.groupBy("bucket").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")
    ).where("first < last")
    met = join_splitting_hot_keys(
        banded, materialize(shared, "near-shared"), "bucket", banded.count()
    )
    met = materialize(met.drop("n"), "near-buckets")
    stars = (
        met.select("id", F.explode(F.array("first", "last")).alias("centre"))
        .where("id <> centre")
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        .distinct()
    )
    stars = materialize(stars, "near-stars")
    sets = _Sets(texts, classes, words)
    links = confirm(stars, sets, percent)
    found = components(links)
    more = _rest(met, found, speaking, sets, block, percent)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # Classes that stand alone are not in `found`.
    labelled = found.join(classes, "id").select("of", "rep", "component")
    tops = materialize(
        labelled.groupBy(F.col("component").alias("label")).agg(F.min("rep").alias("top")),
        "near-tops",
    )
    placed = (
        classes.join(found, "id", "left")
        .join(broadcast_if_small(tops), F.col("component") == F.col("label"), "left")
        .select("of", F.coalesce("top", "rep").alias("top"), "n")
    )
    placed = materialize(placed, "near-placed")
    alone = F.col("of").isNull() | ~linked
    # Rows without words have no class, and classes of many rows are few.
    many = F.col("n") * HOT_SHARE > F.lit(total)
    same = F.col("digest") == F.col("of")
    empty = F.col("n_shingles") == 0
    hot = F.broadcast(placed.where(many).drop("n"))
    wordless = [F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema.fields]
    rest = sketched.where(~empty).join(hot.select("of"), same, "left_anti")
    met_again = (
        rest.join(placed.where(~many).drop("n"), same, "left")
        .unionByName(sketched.where(~empty).join(hot, same))
        .unionByName(sketched.where(empty).select("*", *wordless))
    )
    return met_again.select(
        "doc_id",
        "key",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
        (
            alone
            | (
                F.col("doc_id").eqNullSafe(F.col("top.doc_id"))
                & (F.col("key") == F.col("top.key"))
            )
        ).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows that stay, one of each group, with the columns of the input.

    Rows are told apart by id and text; of rows that repeat both one stays.
    """
    chosen = {"words": WORDS, "percent": PERCENT, "block": BLOCK} | options

    def marked() -> DataFrame:
        decided = _decided(docs, id_col, text_col, **chosen, linked=F.lit(True))
        return (
            decided.where("n_shingles > 0")
            .groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
            .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
            .where("NOT __kept OR __n > 1")
        )

    marks = settle(docs.sparkSession, "near-dropped", marked)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (
        F.col("__row_key") == F.col("__key")
    )
    keyed = docs.withColumn("__row_key", F.xxhash64(text_col))
    left = keyed.join(broadcast_if_small(marks.where("NOT __kept")), same, "left_anti")
    several = marks.where("__kept")
    if several.isEmpty():
        return left.drop("__row_key")
    several = broadcast_if_small(several)
    row = F.min_by(F.struct(*docs.columns), row_key(docs)).alias("row")
    again = left.join(several, same, "left_semi").groupBy(id_col, "__row_key").agg(row)
    return left.join(several, same, "left_anti").drop("__row_key").unionByName(
        again.select("row.*")
    )


class _Sets:
    """Full sets of the classes asked for so far, each made once and written."""

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int):
        self._texts, self._classes, self._words = texts, classes, words
        self._made: DataFrame | None = None

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, set) of at least these ids."""
        if self._made is not None:
            ids = ids.join(self._made.select("id"), "id", "left_anti")
        wanted = materialize(
            ids.join(self._classes, "id").select(
                "id", F.col("rep.doc_id").alias("of_id"), F.col("rep.key").alias("of_key")
            ),
            "near-ids",
        )
        needed = self._texts.join(
            broadcast_if_small(wanted),
            F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")),
        ).select("id", "text")
        made = materialize(
            needed.mapInArrow(self._maker(), "id bigint, set array<bigint>"), "near-sets"
        )
        if made.count() > wanted.count():  # rows that repeat id and text
            made = materialize(made.dropDuplicates(["id"]), "near-sets")
        self._made = made if self._made is None else self._made.unionByName(made)
        return self._made

    def _maker(self):
        words = self._words

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _WordHashes()
            for batch in batches:
                for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                    sets = [
                        shingles(t, words, known).view(np.int64)
                        for t in part.column(1).to_pylist()
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(sets, pa.list_(pa.int64()))],
                        names=["id", "set"],
                    )

        return rows


def confirm(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The written pairs (a, b) whose full sets are similar enough, written once."""
    full = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    inter = F.size(F.array_intersect("set_a", "set_b"))
    both = F.size("set_a") + F.size("set_b") - inter
    hot = hot_ids(pairs)
    with_a = _with_sets(pairs, full, hot, "a", "b")
    return materialize(
        _with_sets(with_a, full, hot, "b", "a")
        .where(100 * inter >= percent * both)
        .select("a", "b")
        .distinct(),
        "near-links",
    )


def hot_ids(edges: DataFrame) -> DataFrame:
    """(hot, parts): ids with over a HOT_SHARE-th of the edges, and into how many parts
    their edges are to be dealt. At most 2 * HOT_SHARE rows, written once."""
    total = edges.count()
    degrees = edges.select(F.explode(F.array("a", "b")).alias("hot")).groupBy("hot").count()
    parts = F.ceil(F.col("count") * HOT_SHARE / F.lit(max(1, total)))
    return materialize(
        degrees.where(F.col("count") * HOT_SHARE > F.lit(total))
        .select("hot", parts.cast("int").alias("parts"))
        .where("parts > 1"),
        "near-hot",
    )


def _with_sets(pairs: DataFrame, full: DataFrame, hot: DataFrame, end: str, other: str):
    """The pairs with the set of one end; edges of a hot id are dealt by the other end."""
    hot = F.broadcast(hot)
    dealt = F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64(other), F.col("parts"))
    ).otherwise(0)
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    copies = full.join(hot, F.col("id") == F.col("hot"), "left").select(
        F.col("id").alias(end),
        F.explode(parts).alias("part"),
        F.col("set").alias(f"set_{end}"),
    )
    return (
        pairs.join(hot, F.col(end) == F.col("hot"), "left")
        .withColumn("part", dealt.cast("int"))
        .drop("hot", "parts")
        .join(copies, [end, "part"])
        .drop("part")
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that has a link; the component is its least id.

    Ids point to their least neighbour; followed to their ends, these pointers are labels.
    Each round points the greater label of a link to the least one it meets and follows the
    pointers again, so that chains shorten by more than half. Links whose ends have one label
    are left behind. Every round is written. The labels of ids with many links, of which
    there are few, reach the links by broadcast.
    """
    hot = F.broadcast(hot_ids(links).select("hot"))
    edges = links.select("a", "b")
    ends = F.array(*[F.struct(F.col(x).alias("id"), F.col(y).alias("to")) for x, y in ("ab", "ba")])
    pointers = edges.select(F.inline(ends)).groupBy("id").agg(
        F.least(F.col("id"), F.min("to")).alias("component")
    )
    labels = _followed(materialize(pointers, "near-pointers"))
    for end in ("a", "b"):
        edges = edges.join(
            hot.select(F.col("hot").alias(end), F.lit(True).alias(f"hot_{end}")), end, "left"
        ).fillna(False, [f"hot_{end}"])
    while True:
        over = _with_labels(_with_labels(edges, labels, hot, "b"), labels, hot, "a")
        apart = materialize(
            over.where("of_a <> of_b").withColumns(
                {"low": F.least("of_a", "of_b"), "high": F.greatest("of_a", "of_b")}
            ),
            "near-apart",
        )
        if apart.isEmpty():
            return labels
        hooks = apart.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("to"))
        pointers = labels.join(hooks, "id", "left").select(
            "id", F.least("component", "to").alias("component")
        )
        labels = _followed(materialize(pointers, "near-pointers"))
        edges = apart.select("a", "b", "hot_a", "hot_b")


def _with_labels(edges: DataFrame, labels: DataFrame, hot: DataFrame, end: str) -> DataFrame:
    """The edges with the label of one end."""
    of = labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    few = of.join(hot.select(F.col("hot").alias(end)), end, "left_semi")
    return (
        edges.where(~F.col(f"hot_{end}"))
        .join(of, end)
        .unionByName(edges.where(f"hot_{end}").join(F.broadcast(few), end))
    )


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers followed to their ends: ids that point to themselves."""
    while True:
        inner = pointers.where("id <> component")
        ends = inner.select(F.col("id").alias("component"))
        if inner.join(ends, "component", "left_semi").isEmpty():
            return pointers
        pointers = materialize(_jumped(pointers), "near-labels")


def _jumped(labels: DataFrame) -> DataFrame:
    """Jumping: take over the label of the label. Labels of many ids are broadcast."""
    up = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
    total = labels.count()
    sizes = labels.groupBy("component").count().where(F.col("count") * HOT_SHARE > F.lit(total))
    # At most HOT_SHARE rows.
    top = F.broadcast(materialize(up.join(sizes.drop("count"), "component"), "near-tops"))
    cold = labels.join(top.select("component"), "component", "left_anti")
    return (
        cold.join(up, "component", "left")
        .select("id", F.least("component", "next").alias("component"))
        .unionByName(
            labels.join(top, "component").select(
                "id", F.least("component", "next").alias("component")
            )
        )
    )


def _rest(
    met: DataFrame,
    found: DataFrame,
    speaking: DataFrame,
    sets: _Sets,
    block: int,
    percent: int,
) -> DataFrame:
    """Links (a, b) between components, within buckets that are still open."""
    members = _open(
        _labelled(met.select("bucket", "id"), found),
        "bucket",
        speaking.select("id", (4 * F.col("n_shingles") + PARITY_BITS).alias("n_shingles")),
    )
    known = (
        speaking.select("id", "bits", "n_shingles")
        .join(members.select("id").distinct(), "id", "left_semi")
    )
    known = materialize(known, "near-open-sketches")
    alike = (
        _blocks(members, "bucket", block, BLOCK_BITS)
        .join(known, "id")
        .groupBy("bucket", "column", "row")
        .applyInArrow(_screener(percent), "a bigint, b bigint")
    )
    clusters = components(materialize(alike, "near-alike")).withColumnRenamed(
        "component", "cluster"
    )
    members = _open(_labelled(clusters, found), "cluster", known)
    full = sets.of(members.select("id"))
    return materialize(
        _blocks(members, "cluster", block, BLOCK_SHINGLES)
        .join(known, "id")
        .join(full, "id")
        .groupBy("cluster", "column", "row")
        .applyInArrow(_comparer(percent), "a bigint, b bigint"),
        "near-more",
    )


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def _open(members: DataFrame, group: str, known: DataFrame) -> DataFrame:
    """Members of groups with several components, with what deals them into blocks.

    `weight` is the sum of the group's `n_shingles` in `known`; `outside` tells who is not
    in the group's largest component (the least of them, when several are largest).
    """
    members = materialize(
        members.join(known.select("id", "n_shingles"), "id"), "near-members"
    )
    sizes = members.groupBy(group, "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")
    )
    totals = (
        sizes.groupBy(group)
        .agg(
            F.max("n").alias("most"),
            F.sum("n").alias("rows"),
            F.sum("weight").alias("weight"),
            F.count(F.lit(1)).alias("parts"),
        )
        .where("parts > 1")
    )
    main = (
        sizes.select(group, "component", "n")
        .join(totals, group)
        .where("n = most")
        .groupBy(group, "rows", "most", "weight")
        .agg(F.min("component").alias("main"))
    )
    return materialize(
        members.join(main, group).select(
            group,
            "id",
            "component",
            (F.col("component") != F.col("main")).alias("outside"),
            "rows",
            (F.col("rows") - F.col("most")).alias("few"),
            "weight",
        ),
        "near-open",
    )


def _blocks(members: DataFrame, group: str, block: int, weight: int) -> DataFrame:
    """Rows by (group, column, row): each block of outsiders beside each of members."""
    parts = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("weight") / weight))
    few = F.ceil(F.col("few") * parts / F.col("rows"))
    cell = F.xxhash64("id", group)
    everyone = F.sequence(F.lit(0).cast("long"), few - 1)
    as_member = members.select(
        group,
        F.pmod(cell, parts).alias("column"),
        F.explode(everyone).alias("row"),
        "id",
        "component",
        F.lit(False).alias("outside"),
    )
    as_outsider = members.where("outside").select(
        group,
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("column"),
        F.pmod(cell, few).alias("row"),
        "id",
        "component",
        "outside",
    )
    return as_member.unionByName(as_outsider)


class _Forest:
    """Disjoint sets of labels; `join` tells whether the two were apart."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self._up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self._up[max(x, y)] = min(x, y)
        return x != y


class _Parities:
    """Parity bits of a group's rows, compared at the size of the smaller set's."""

    def __init__(self, held: list[bytes]):
        words = [np.frombuffer(bits, np.uint64) for bits in held]
        self.sizes = np.array([len(w) for w in words])
        # At each size: the rows with at least as many bits, folded to it.
        self._rows: dict[int, np.ndarray] = {}
        self._tables: dict[int, np.ndarray] = {}
        for size in sorted(set(self.sizes.tolist())):
            rows = np.flatnonzero(self.sizes >= size)
            self._rows[size] = rows
            self._tables[size] = np.array([self._folded(words[i], size) for i in rows])

    @staticmethod
    def _folded(words: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)

    def _at(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self._tables[size][np.searchsorted(self._rows[size], rows)]

    def differing(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Places in which row x differs from each of the rows."""
        out = np.zeros(len(rows), dtype=np.int64)
        least = np.minimum(self.sizes[rows], self.sizes[x])
        for size in np.unique(least).tolist():
            at = np.flatnonzero(least == size)
            apart = self._at(rows[at], size) ^ self._at(np.array([x]), size)
            out[at] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
        return out


def _passing(group: pa.Table, percent: int):
    """(outsider, members that pass its screen, most alike first), as row numbers."""
    flags = group["outside"].to_numpy(zero_copy_only=False).astype(bool)
    parts = group["component"].to_numpy()
    n = group["n_shingles"].to_numpy()
    parities = _Parities(group["bits"].to_pylist())
    columns = np.flatnonzero(~flags)
    for x in np.flatnonzero(flags):
        size = n[columns]
        fits = (parts[columns] != parts[x]) & (
            100 * np.minimum(size, n[x]) >= percent * np.maximum(size, n[x])
        )
        near, both = columns[fits], size[fits] + n[x]
        # Bits differ at most at the shingles that only one of the two has.
        single = parities.differing(x, near)
        passed = (100 + percent) * single <= (100 - percent) * both
        near, alike = near[passed], 1 - single[passed] / both[passed]
        yield x, near[np.argsort(-alike, kind="stable")]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table(
        {
            "a": pa.array([min(p) for p in found], pa.int64()),
            "b": pa.array([max(p) for p in found], pa.int64()),
        }
    )


def _screener(percent: int):
    def screened(group: pa.Table) -> pa.Table:
        ids = group["id"].to_pylist()
        forest = _Forest()
        return _pairs(
            [
                (ids[x], ids[y])
                for x, others in _passing(group, percent)
                for y in others.tolist()
                if forest.join(ids[x], ids[y])
            ]
        )

    return screened


def _comparer(percent: int):
    def compared(group: pa.Table) -> pa.Table:
        ids = group["id"].to_pylist()
        parts = group["component"].to_pylist()
        column = group["set"].combine_chunks()
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        sets = [np.sort(values[ends[i] : ends[i + 1]]) for i in range(len(ids))]
        forest, links = _Forest(), []
        for x, others in _passing(group, percent):
            for y in others.tolist():
                if forest.top(parts[x]) == forest.top(parts[y]):
                    continue
                a, b = sets[x], sets[y]
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                shared = int((a[at] == b).sum())
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    forest.join(parts[x], parts[y])
                    links.append((ids[x], ids[y]))
        return _pairs(links)

    return compared
