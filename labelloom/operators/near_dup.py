"""Near duplicates: MinHash bands and the greedy keep rule.

The rule visits rows by priority, and inside a priority in the order of a seeded hash of
row_id, and drops a row when it shares a band bucket with a row already kept. A dropped
row does not drop others, so this is a maximal independent set in visiting order, not a
clustering. It is computed in rounds (Blelloch, Fineman, Shun 2012): the first undecided
row of *all* its buckets is kept, and undecided rows in a bucket of a kept row are dropped.
In a random order chains of rows that wait for one another are short, so the rounds grow
with the logarithm of the rows, whatever the buckets look like.

Work is on (row, bucket) membership, never on pairs, so a bucket with a third of the
table costs what its rows cost. Joins on the bucket split such hot buckets off.

With `verify`, sharing a bucket is not enough: the exact similarity must reach the threshold.
With `exact`, rows meet by size and parities (see `similar`) instead of through buckets, so
that no similar row is missed. Both settle a block of rows of every bucket or list in a round.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.ids import hash_order
from labelloom.functions.minhash import gram_set, minhash_signature
from labelloom.functions.text import jaccard
from labelloom.operators import similar
from labelloom.operators.joins import (
    hot_keys,
    join_dealing_hot_keys,
    join_splitting_hot_keys,
)
from labelloom.session import materialize


def lsh_bands(threshold: float = 0.8, num_perm: int = 128) -> tuple[int, int]:
    """(bands, rows per band) minimising the two error areas of the S-curve."""
    similarity = (np.arange(2000) + 0.5) / 2000
    below = similarity < threshold
    best, best_error = (1, num_perm), np.inf
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            found = 1 - (1 - similarity**rows) ** bands
            error = np.where(below, found, 1 - found).mean()
            if error < best_error:
                best, best_error = (bands, rows), error
    return best


def band_buckets(signature: Column | str, bands: int, rows: int) -> Column:
    """One 128-bit bucket key per band of the signature."""
    signature = F.col(signature) if isinstance(signature, str) else signature
    return F.array(
        *[
            F.struct(
                F.lit(band).alias("band"),
                F.xxhash64(F.lit(0), part).alias("h1"),
                F.xxhash64(F.lit(1), part).alias("h2"),
            )
            for band in range(bands)
            for part in [F.slice(signature, band * rows + 1, rows)]
        ]
    )


def visiting_rank(seed: int = 42) -> Column:
    """Priority first, then a seeded random order."""
    turn = F.substring(hash_order(seed, "near_dup"), 1, 16)
    return F.struct("priority", turn.alias("turn"), "row_id")


def row_buckets(
    df: DataFrame,
    *,
    text: str = "prompt_norm",
    rank: Column | None = None,
    threshold: float = 0.8,
    num_perm: int = 128,
    n_gram: int = 5,
) -> DataFrame:
    """(rank, bucket), one row per band; `rank` orders by (priority, row_id) by default."""
    bands, rows = lsh_bands(threshold, num_perm)
    signed = df.select(
        (F.struct("priority", "row_id") if rank is None else rank).alias("rank"),
        minhash_signature(text, num_perm, n_gram).alias("signature"),
    )
    return signed.select(
        "rank", F.explode(band_buckets("signature", bands, rows)).alias("bucket")
    )


def first_neighbours(members: DataFrame) -> DataFrame:
    """(rank, neighbour, shared): the first earlier row each row meets, one per row.

    `shared` is the number of buckets whose first row is that neighbour.
    """
    members = materialize(members, "buckets")
    total = members.count()
    firsts = members.groupBy("bucket").agg(
        F.min("rank").alias("neighbour"), F.count("*").alias("n")
    )
    met = join_splitting_hot_keys(
        members, firsts.where("n > 1"), "bucket", total
    ).where(
        F.col("neighbour") < F.col("rank")
    )
    per_pair = met.groupBy("rank", "neighbour").agg(F.count("*").alias("shared"))
    return per_pair.groupBy("rank").agg(
        F.min(F.struct("neighbour", "shared")).alias("first")
    ).select("rank", "first.*")


@dataclass(frozen=True)
class NearDuplicates:
    """The outcome of the greedy rule for rows that met at least one other row."""

    decided: DataFrame  # (rank, kept, leader)
    rounds: int
    # (rank, bucket, degree) where meeting in a bucket decides, and how many they are.
    members: DataFrame | None = None
    total: int = 0

    @property
    def dropped(self) -> DataFrame:
        """(row_id) of the rows the rule removes."""
        return self.decided.where(~F.col("kept")).select("rank.row_id")

    def listing(self) -> DataFrame:
        """(dropped_id, kept_id): each dropped row with the first kept row it meets."""
        if self.members is None:
            meetings = self.decided.where(~F.col("kept")).select("rank", "leader")
        else:
            kept = self.decided.where("kept").select("rank")
            keepers = self.members.join(kept, "rank", "left_semi")
            # A bucket holds at most one kept row.
            sizes = self.members.groupBy("bucket").agg(F.count("*").alias("n"))
            keepers = keepers.select("bucket", F.col("rank").alias("leader"))
            meetings = join_splitting_hot_keys(
                self.members, keepers.join(sizes, "bucket"), "bucket", self.total
            )
        met = meetings.where(F.col("leader") < F.col("rank"))
        return met.groupBy("rank").agg(F.min("leader").alias("leader")).select(
            F.col("rank.row_id").alias("dropped_id"),
            F.col("leader.row_id").alias("kept_id"),
        )


def find_near_duplicates(
    df: DataFrame,
    *,
    text: str = "prompt_norm",
    threshold: float = 0.8,
    num_perm: int = 128,
    n_gram: int = 5,
    verify: bool = False,
    exact: bool = False,
    seed: int = 42,
) -> NearDuplicates:
    """Decide every row of `df(row_id, priority, <text>)`; row_id must be unique.

    With `verify`, two rows of a bucket are neighbours only when the exact Jaccard
    similarity of their n-gram sets reaches the threshold; with `exact`, any two rows are.
    Both read texts several times and write them once, unless `df` is a table that
    `similar.numbered` has written.
    """
    rank = visiting_rank(seed)
    bands = {"threshold": threshold, "num_perm": num_perm, "n_gram": n_gram}
    if not (verify or exact):
        return greedy_keep(row_buckets(df, text=text, rank=rank, **bands))
    if similar.NUMBER not in df.columns:
        df = similar.numbered(df.select("row_id", "priority", text), "texts")
    ranked = similar.in_rank_order(df, rank, similar.NUMBER)
    alike = {"text": text, "threshold": threshold, "n_gram": n_gram}
    by_jaccard = similar.by_jaccard(df, ranked, **alike)
    if exact:
        sized = similar.sized(df, ranked=ranked, **alike)
        meetings = similar.by_parities(sized, threshold=threshold)
        settled = similar.settle_in_windows(similar.size_lists(sized), by_jaccard, meetings)
    else:
        nothing = F.lit(None).cast("int")
        buckets = row_buckets(df, text=text, rank=F.col(similar.NUMBER), **bands)
        shared = similar.in_shared_lists(buckets.toDF(similar.NUMBER, "list"))
        lists = shared.join(ranked, similar.NUMBER).select(
            "id",
            "list",
            F.lit(None).cast("boolean").alias("guest"),
            nothing.alias("size"),
            nothing.alias("place"),
        )
        settled = similar.settle_in_blocks(lists, by_jaccard, threshold=threshold)
    return NearDuplicates(_with_ranks(settled.decided, ranked), settled.rounds)


def _with_ranks(decided: DataFrame, ranked: DataFrame) -> DataFrame:
    """(rank, kept, leader) for (id, kept, leader) by number."""
    of = ranked.select("id", "rank")
    leaders = ranked.select(F.col("id").alias("leader"), F.col("rank").alias("leader_rank"))
    decided = materialize(decided, "decided")
    hot = hot_keys(decided, "leader")
    return join_dealing_hot_keys(decided.join(of, "id"), leaders, "leader", "id", hot).select(
        "rank", "kept", F.col("leader_rank").alias("leader")
    )


def greedy_keep(members: DataFrame) -> NearDuplicates:
    """The keep rule over (rank, bucket), in rounds until no row is undecided."""
    members = materialize(members, "buckets")
    total = members.count()
    shared = _shared_buckets(members, total)
    undecided, rounds, outcomes = shared, 0, []
    while not undecided.isEmpty():
        outcome = materialize(_decide(undecided, total), "outcome")
        rest = undecided.join(outcome.select("rank"), "rank", "left_anti")
        undecided = materialize(rest, "undecided")
        outcomes.append(outcome)
        rounds += 1
    decided = (
        functools.reduce(DataFrame.union, outcomes)
        if outcomes
        else _decide(undecided, total)
    )
    return NearDuplicates(decided, rounds, shared, total)


def drop_near_duplicates(df: DataFrame, found: NearDuplicates) -> DataFrame:
    return df.join(found.dropped, "row_id", "left_anti")


def with_jaccard(
    listing: DataFrame, df: DataFrame, *, text: str = "prompt_norm", n_gram: int = 5
) -> DataFrame:
    """Add the exact similarity of each listed pair; one pair per dropped row."""
    dropped = df.select(F.col("row_id").alias("dropped_id"), F.col(text).alias("a"))
    kept = df.select(F.col("row_id").alias("kept_id"), F.col(text).alias("b"))
    # Texts are too wide to broadcast: adaptive execution splits a hot keeper.
    return listing.join(dropped, "dropped_id").join(kept, "kept_id").select(
        "kept_id",
        "dropped_id",
        jaccard(gram_set("a", n_gram), gram_set("b", n_gram)).alias("jaccard"),
    )


def _shared_buckets(members: DataFrame, total: int) -> DataFrame:
    """Memberships in buckets of two rows or more, with the row's number of them."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = join_splitting_hot_keys(members, sizes, "bucket", total)
    per_row = shared.groupBy("rank").agg(
        F.collect_list("bucket").alias("buckets")  # at most one per band
    )
    return materialize(
        per_row.select(
            "rank",
            F.size("buckets").alias("degree"),
            F.explode("buckets").alias("bucket"),
        ),
        "shared",
    )


def _decide(undecided: DataFrame, total: int) -> DataFrame:
    """(rank, kept, leader) for the rows this round settles."""
    firsts = undecided.groupBy("bucket").agg(
        F.min(F.struct("rank", "degree")).alias("first"), F.count("*").alias("n")
    )
    winners = (
        firsts.groupBy("first")
        .agg(F.collect_list(F.struct("bucket", "n")).alias("won"))
        .where(F.size("won") == F.col("first.degree"))
        .select(F.col("first.rank").alias("leader"), F.explode("won").alias("won"))
        .select("leader", "won.*")
    )
    met = join_splitting_hot_keys(undecided, winners, "bucket", total).select("rank", "leader")
    return (
        met.groupBy("rank")
        .agg(F.min("leader").alias("leader"))
        .select("rank", (F.col("rank") == F.col("leader")).alias("kept"), "leader")
    )
