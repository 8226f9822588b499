"""Exact deduplication as a Grace hash join of the table with itself.

Texts are equal when they are identical after all ASCII white space is deleted.

1. *Collapse.* Each task runs its rows through an open-addressing table, which is emptied
   whenever it holds `flush_bytes`. What leaves it is one fragment per text: the content,
   the best row, and the ids of the rows that have it. Fragments are written once; a text
   that fills a third of the table leaves few and short ones.
2. *Partition.* Contents are dealt to buckets by digits of their hash. Buckets over
   `bucket_bytes` are dealt again by the next digits, and so on, until each fits or holds
   a single hash. The sizes of distinct hashes decide this tree before any content moves,
   so each content is written to one spill file (of Spark's shuffle) only.
3. *Build.* One task reads one bucket into an open-addressing table that compares complete
   contents on each hash hit, and gives each fragment its text's best row and count.
4. Fragments hand the result to their ids, joined by fragment, never by text.

The row with the most code points in the original text stays, then the smallest id.

Defined cases: a null text equals the empty one; null ids come last and are null in the
result; rows that repeat id and text are copies of one another, of which exactly one has
`kept`; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import SPACES, broadcast_if_small, in_small_batches
from labelloom.session import materialize, settle

FLUSH_BYTES = 24 << 20
FLUSH_ROWS = 100_000
BUCKET_BYTES = 48 << 20
FAN_OUT = 16
_NO_ID = np.iinfo(np.int64).max

_FRAGMENT_SQL = (
    "hash bigint, content binary, size bigint, text_sha256 string, points bigint, "
    "best_id bigint, place int, n bigint, ids array<bigint>"
)


class OpenTable:
    """Contents to dense numbers: linear probing over (hash, complete content)."""

    def __init__(self, slots: int = 1024):
        self._slots = np.full(slots, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def number(self, key: int, content: bytes) -> int:
        """The content's number, given at its first visit."""
        if 2 * len(self.contents) >= len(self._slots):
            self._grow()
        slots, mask = self._slots, len(self._slots) - 1
        at = key & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return int(entry)
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content)
        return len(self.contents) - 1

    def _grow(self) -> None:
        size = 2 * len(self._slots)
        slots = np.full(size, -1, dtype=np.int64)
        for entry, key in enumerate(self.hashes):
            at = key & (size - 1)
            while slots[at] >= 0:
                at = (at + 1) & (size - 1)
            slots[at] = entry
        self._slots = slots


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    flush_bytes: int = FLUSH_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    fragments = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
        ).mapInArrow(_collapser(flush_bytes), _FRAGMENT_SQL).select(
            F.monotonically_increasing_id().alias("fragment"), "*"
        ),
        "exact-fragments",
    )
    contents = fragments.select(
        "fragment", "hash", "content", "points", "best_id", "place", "n"
    )
    buckets, bucket = bucket_tree(fragments.select("hash", "size"), bucket_bytes)
    settled = contents.repartitionById(buckets, bucket).mapInArrow(
        _build,
        "fragment bigint, keep_id bigint, keep_fragment bigint, keep_place int, "
        "group_size bigint",
    )
    members = fragments.select(
        "fragment", "text_sha256", F.posexplode("ids").alias("at", "doc_id")
    )
    kept = (F.col("fragment") == F.col("keep_fragment")) & (
        F.col("at") == F.col("keep_place")
    )
    return members.join(settled, "fragment").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )


def drop_exact_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows that stay, with the columns of the input.

    Copies are taken out by an anti join on (id, digest) with the dropped rows, which is
    the smaller side; of rows that repeat both the longest stays.
    """
    groups = settle(
        docs.sparkSession,
        "exact-groups",
        lambda: exact_groups(docs, id_col=id_col, text_col=text_col),
    )
    repeated_ids = groups.groupBy("doc_id").count().where("count > 1")
    if repeated_ids.isEmpty():
        gone = groups.where("NOT kept").select(F.col("doc_id").alias("__id"))
        return docs.join(
            broadcast_if_small(gone), F.col(id_col).eqNullSafe(F.col("__id")), "left_anti"
        )
    copies = groups.groupBy(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    ).agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, "")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_sha") == F.col("__sha"))
    left = docs.withColumn("__row_sha", F.sha2(text, 256)).join(
        copies.where("NOT __kept"), same, "left_anti"
    )
    several = copies.where("__kept AND __n > 1")
    once = left.join(several, same, "left_anti")
    longest = Window.partitionBy(id_col, "__row_sha").orderBy(F.length(text_col).desc())
    again = (
        left.join(several, same, "left_semi")
        .withColumn("__at", F.row_number().over(longest))
        .where("__at = 1")
        .drop("__at")
    )
    return once.unionByName(again).drop("__row_sha")


def bucket_tree(sizes: DataFrame, bucket_bytes: int, fan_out: int = FAN_OUT):
    """(number of buckets, bucket of a row), from the `size` of each `hash`.

    Level 0 has as many buckets as the average needs. Every further level looks only at
    the buckets that are too large; the driver holds one number for each of those.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    first = max(1, math.ceil(2 * total / bucket_bytes))
    level = F.pmod(F.col("hash"), F.lit(first)).cast("int")
    distinct = sizes.groupBy("hash").agg(F.max("size").alias("size"))
    buckets, depth = first, 0
    while True:
        large = [
            row["bucket"]
            for row in distinct.groupBy(level.alias("bucket"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("hashes"))
            .where((F.col("bytes") > bucket_bytes) & (F.col("hashes") > 1))
            .select("bucket")
            .collect()
        ]
        if not large:
            return buckets, level
        starts = F.create_map(
            *[
                F.lit(x)
                for i, b in enumerate(sorted(large))
                for x in (b, buckets + i * fan_out)
            ]
        )
        depth += 1
        digit = F.pmod(F.xxhash64("hash", F.lit(depth)), F.lit(fan_out)).cast("int")
        level = F.when(
            level.isin(large), F.element_at(starts, level) + digit
        ).otherwise(level)
        buckets += fan_out * len(large)


def _collapser(flush_bytes: int):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, members = OpenTable(), [], []
        rows = 0
        for batch in batches:
            for doc_id, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ):
                text = text or ""
                content = text.encode().translate(None, b" \t\n\x0b\x0c\r")
                at = table.number(xxhash.xxh3_64_intdigest(content), content)
                key = (-len(text), _NO_ID if doc_id is None else doc_id)
                if at == len(best):
                    best.append((key, 0))
                    members.append([doc_id])
                else:
                    if key < best[at][0]:
                        best[at] = (key, len(members[at]))
                    members[at].append(doc_id)
                rows += 1
                if table.bytes >= flush_bytes or rows >= FLUSH_ROWS:
                    yield from _fragments(table, best, members)
                    table, best, members, rows = OpenTable(), [], [], 0
        if len(table):
            yield from _fragments(table, best, members)

    return collapse


def _fragments(table: OpenTable, best, members) -> Iterator[pa.RecordBatch]:
    step = 512
    for start in range(0, len(table), step):
        part = slice(start, start + step)
        contents = table.contents[part]
        yield from in_small_batches(
            pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(table.hashes[part], dtype=np.uint64).view(np.int64)),
                    pa.array(contents, pa.large_binary()).cast(pa.binary()),
                    pa.array([len(c) for c in contents], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in contents]),
                    pa.array([-key[0] for key, _ in best[part]], pa.int64()),
                    pa.array([key[1] for key, _ in best[part]], pa.int64()),
                    pa.array([place for _, place in best[part]], pa.int32()),
                    pa.array([len(ids) for ids in members[part]], pa.int64()),
                    pa.array(members[part], pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in _FRAGMENT_SQL.split(", ")],
            ),
            sum(map(len, contents)) / len(contents),
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: number the contents, keep each one's best fragment and count.

    Of the fragments only (fragment, number) is held, 16 bytes each.
    """
    table, best, counts = OpenTable(), [], []
    names, numbers = [], []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        fragments = columns[0].to_numpy(zero_copy_only=False)
        seen = np.empty(batch.num_rows, dtype=np.int64)
        narrow = zip(*[c.to_pylist() for c in columns])
        for row, (fragment, key, content, points, best_id, place, n) in enumerate(narrow):
            at = table.number(key, content)
            rank = (-points, best_id, fragment, place)
            if at == len(best):
                best.append(rank)
                counts.append(n)
            else:
                best[at] = min(best[at], rank)
                counts[at] += n
            seen[row] = at
        names.append(fragments)
        numbers.append(seen)
    if not names:
        return
    chosen = np.array([(b[1], b[2], b[3]) for b in best], dtype=np.int64)
    totals = np.array(counts, dtype=np.int64)
    for fragments, seen in zip(names, numbers):
        picked = chosen[seen]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(fragments),
                pa.array(picked[:, 0], mask=picked[:, 0] == _NO_ID),
                pa.array(picked[:, 1]),
                pa.array(picked[:, 2].astype(np.int32)),
                pa.array(totals[seen]),
            ],
            names=["fragment", "keep_id", "keep_fragment", "keep_place", "group_size"],
        )
