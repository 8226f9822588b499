"""The exact similarity join and the keep rule in blocks, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import near_dup, similar

TEXTS = "row_id bigint, priority int, prompt_norm string"
LISTS = "id bigint, list int"


def grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)} or {text}


def alike(a, b, t):
    return len(a & b) / len(a | b) >= t


def sequential(rows, meet):
    """Rows in order of rank; the first kept row that each dropped one meets."""
    kept, links = [], {}
    for row in rows:
        found = [k for k in kept if meet(k, row)]
        if found:
            links[row] = found[0]
        else:
            kept.append(row)
    return links


def families(seed, count, size, length=200):
    """Texts with an edit here and there, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        base = [rng.choice("abcdefgh ") for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            texts.append("".join(copy[: len(copy) - rng.choice([0, 0, 3, 20])]))
    rng.shuffle(texts)
    return texts


def by_rank(df, seed=42):
    rows = df.select("row_id", near_dup.visiting_rank(seed).alias("rank"), "prompt_norm")
    return sorted(rows.collect(), key=lambda r: tuple(r["rank"]))


@pytest.mark.parametrize("threshold, n_gram", [(0.8, 3), (0.6, 2), (0.95, 5)])
def test_exact_join_equals_brute_force(spark, threshold, n_gram):
    texts = families(1, 12, 9) + families(2, 5, 6, length=30) + ["", "a", "ab", "abc"]
    df = spark.createDataFrame(
        [(i, i % 2, t) for i, t in enumerate(dict.fromkeys(texts))], TEXTS
    ).repartition(4)
    found = near_dup.find_near_duplicates(
        df, threshold=threshold, n_gram=n_gram, exact=True
    )
    rows = by_rank(df)
    sets = {r["row_id"]: grams(r["prompt_norm"], n_gram) for r in rows}
    links = sequential(
        [r["row_id"] for r in rows], lambda a, b: alike(sets[a], sets[b], threshold)
    )
    assert {r["row_id"] for r in found.dropped.collect()} == set(links) and links
    # One link for each dropped row, to the first kept row that is similar to it.
    assert {r["dropped_id"]: r["kept_id"] for r in found.listing().collect()} == links
    assert found.decided.count() == found.decided.select("rank").distinct().count()


def test_links_that_bands_miss(spark):
    """Pairs just above the threshold: a few bands of many rows each seldom meet."""
    texts = families(5, 150, 2)
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], TEXTS)
    settings = {"threshold": 0.8, "n_gram": 3, "num_perm": 16}
    rows = by_rank(df)
    sets = {r["row_id"]: grams(r["prompt_norm"], 3) for r in rows}
    links = sequential([r["row_id"] for r in rows], lambda a, b: alike(sets[a], sets[b], 0.8))
    banded = near_dup.find_near_duplicates(df, verify=True, **settings)
    whole = near_dup.find_near_duplicates(df, exact=True, **settings)
    assert whole.dropped.count() == len(links) > banded.dropped.count()


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_blocks_equal_the_sequential_rule(spark, seed):
    """Random lists and a random similarity, settled two rows of a list at a time."""
    rng = random.Random(seed)
    size = rng.randrange(10, 60)
    lists = {
        i: {rng.randrange(rng.choice([3, 30])) for _ in range(rng.randrange(1, 4))}
        for i in range(size)
    }
    links = {(a, b) for a in range(size) for b in range(a) if rng.random() < 0.4}
    linked = spark.createDataFrame(sorted(links), "id bigint, leader bigint")

    def chosen(pairs):
        return pairs.join(linked, ["id", "leader"])

    settled = similar.settle_in_blocks(frame(spark, lists), chosen, threshold=0.8, block=2)
    want = sequential(range(size), lambda a, b: lists[a] & lists[b] and (b, a) in links)
    got = {r["id"]: r["leader"] for r in settled.decided.collect() if not r["kept"]}
    assert got == want


def frame(spark, lists):
    rows = [(i, x) for i, own in lists.items() for x in own]
    null = F.lit(None).cast("int")
    return spark.createDataFrame(rows, LISTS).select(
        "id", "list", F.lit(None).cast("boolean").alias("guest"), null.alias("size"),
        null.alias("place"),
    )


def test_a_list_of_unlike_rows_takes_few_rounds_and_no_pair_twice(spark):
    """1000 rows in one list, no two alike: blocks of 64, 128, ... settle them."""
    asked = []

    def none(pairs):
        asked.append(pairs.count())
        return pairs.limit(0)

    settled = similar.settle_in_blocks(
        frame(spark, {i: {0} for i in range(1000)}), none, threshold=0.8
    )
    assert settled.rounds <= 5
    assert settled.decided.where("kept").count() == 1000
    assert sum(asked) <= 1000 * 999 / 2


def test_many_copies_leave_one_link_each(spark):
    """A group that fills most of the table: pairs with the row that stays, no others."""
    asked = []

    def every(pairs):
        asked.append(pairs.count())
        return pairs

    settled = similar.settle_in_blocks(
        frame(spark, {i: {0, 1 + i % 2} for i in range(2000)}), every, threshold=0.8
    )
    assert settled.rounds == 1
    assert settled.decided.where("NOT kept").count() == 1999
    assert sum(asked) <= 2000 + 3 * 64 * 64


def test_classes_never_part_similar_sizes():
    for t in (0.5, 0.8, 0.95):
        starts = similar.size_classes(t, 5000)
        place = [sum(s <= n for s in starts) for n in range(1, 4000)]
        for n in range(1, 3000):
            most = min(3998, math.floor(n / t + 1e-9))
            assert place[most - 1] - place[n - 1] <= 1


def test_ids_rise_with_the_rank(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("r")).repartition(7)
    ranked = similar.in_rank_order(df, F.struct("r"))
    rows = ranked.orderBy("id").collect()
    assert [r["rank"]["r"] for r in rows] == list(range(3000))


def test_empty_table(spark):
    found = near_dup.find_near_duplicates(spark.createDataFrame([], TEXTS), exact=True)
    assert found.dropped.count() == 0 and found.rounds == 0


def test_parities_rule_out_unlike_rows_and_no_similar_one(spark):
    """Texts of the same few words share most lists of an index of grams, and none is alike."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(120)]
    texts += [t[: len(t) - rng.randrange(80)] + "xyz" for t in texts[:30]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    sized = similar.sized(df, text="t", threshold=0.8, n_gram=5)
    assert max(len(r["bits"]) * 8 for r in sized.collect()) <= 2048
    lists = similar.size_lists(sized)
    met = similar.by_parities(sized, threshold=0.8)(lists, lists, 0)
    pairs = {(r["id"], r["leader"]) for r in met.collect()}
    sets = [grams(t, 5) for t in texts]
    links = {(a, b) for a in range(150) for b in range(a) if alike(sets[a], sets[b], 0.8)}
    assert links and links <= pairs
    assert len(pairs) <= 2 * len(links)


def test_a_round_moves_the_texts_of_its_own_pairs(spark, monkeypatch):
    """Several rounds in one bucket: no text is sorted, and none moves without a pair."""
    texts = [t for t in dict.fromkeys(families(3, 2, 130, length=60))]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], TEXTS)
    settings = {"threshold": 0.8, "n_gram": 3, "num_perm": 8}
    moved, written = [], []
    join, write = similar.join_dealing_hot_keys, similar.materialize

    def watched_join(left, right, key, other, hot):
        moved.append((right.count(), left.select(key).distinct().count()))
        return join(left, right, key, other, hot)

    def watched_write(frame, name):
        if "prompt_norm" in frame.columns:
            written.append(name)
        return write(frame, name)

    monkeypatch.setattr(similar, "join_dealing_hot_keys", watched_join)
    monkeypatch.setattr(similar, "materialize", watched_write)
    exact = similar.numbered(df, "exact")
    found = near_dup.find_near_duplicates(exact, verify=True, **settings)
    assert found.rounds >= 2 and len(moved) > 2
    assert all(texts == keys for texts, keys in moved)
    assert set(written) == {"exact", "met-texts"}

    buckets = {}
    for r in near_dup.row_buckets(df, **settings).select("rank.row_id", "bucket").collect():
        buckets.setdefault(r["row_id"], set()).add(r["bucket"])
    rows = by_rank(df)
    sets = {r["row_id"]: grams(r["prompt_norm"], 3) for r in rows}
    links = sequential(
        [r["row_id"] for r in rows],
        lambda a, b: buckets[a] & buckets[b] and alike(sets[a], sets[b], 0.8),
    )
    assert {r["row_id"] for r in found.dropped.collect()} == set(links) and links


def test_rows_that_share_a_row_id_are_compared_as_rows(spark):
    """Rows are found again by number, so that ids that repeat or are null mix up no texts."""
    base = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(7, 0, base), (7, 0, "unlike " * 30), (8, 0, base + "x"), (None, 0, "q" * 90)]
    df = spark.createDataFrame(rows, TEXTS)
    for how in ({"verify": True}, {"exact": True}):
        found = near_dup.find_near_duplicates(df, **how)
        decided = [r for r in found.decided.collect() if not r["kept"]]
        assert len(decided) == 1
        assert {decided[0]["rank"]["row_id"], decided[0]["leader"]["row_id"]} == {7, 8}


def test_rows_meet_in_one_round_and_copies_with_few_others(spark, monkeypatch):
    """400 copies among 1000 rows of one size: no listing of their pairs, and no round a block."""
    rng = random.Random(4)
    base = [rng.choice("abcdefgh ") for _ in range(300)]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(600)]
    for i in range(400):
        texts.append("".join([*base[: i % 300], chr(0x4E00 + i), *base[i % 300 + 1 :]]))
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], TEXTS)
    asked, by_jaccard = [], similar.by_jaccard

    def watched(*args, **settings):
        whole = by_jaccard(*args, **settings)

        def compared(pairs):
            asked.append(pairs.count())
            return whole(pairs)

        return compared

    monkeypatch.setattr(similar, "by_jaccard", watched)
    found = near_dup.find_near_duplicates(df, exact=True)
    rows = [r["row_id"] for r in by_rank(df)]
    first = next(r for r in rows if r >= 600)
    assert {r["dropped_id"]: r["kept_id"] for r in found.listing().collect()} == {
        r: first for r in range(600, 1000) if r != first
    }
    assert found.rounds == 1
    assert sum(asked) <= (similar.EARLIEST + 1) * 400


def test_rows_with_more_rows_before_them_than_are_compared_wait(spark):
    """One place in the order after another is decided, whatever the others turn out to be."""
    n = 40
    lists = frame(spark, {i: {0} for i in range(n)})

    def all_meet(rows, leaders, total, most=0):
        ids = sorted(r["id"] for r in rows.select("id").collect())
        others = sorted(r["id"] for r in leaders.select("id").collect())
        pairs = []
        for i in ids:
            before = [j for j in others if j < i]
            pairs += [(i, j) for j in (before[:most] if most else before)]
            pairs += [(i, -1)] if most and len(before) > most else []
        return spark.createDataFrame(pairs, "id bigint, leader bigint")

    def alike(pairs):
        return pairs.where((F.col("id") - F.col("leader")) % 7 == 0)

    settled = similar.settle_in_windows(lists, alike, all_meet, window=8)
    got = {r["id"]: r["leader"] for r in settled.decided.collect() if not r["kept"]}
    assert got == {i: i % 7 for i in range(7, n)}
    assert settled.decided.where("kept").count() == 7


def test_blocks_cut_by_size_meet_all_similar_rows(spark, monkeypatch):
    """Blocks of a few rows, and bands of more rows than a block: every link is met once."""
    monkeypatch.setattr(similar, "CELL_ROWS", 16)
    texts = list(dict.fromkeys(families(7, 20, 9) + families(8, 8, 9, length=40)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    sized = similar.sized(df, text="t", threshold=0.8, n_gram=3)
    lists = similar.size_lists(sized)
    meet = similar.by_parities(sized, threshold=0.8)
    sets = [grams(t, 3) for t in texts]
    n = len(texts)
    links = {(a, b) for a in range(n) for b in range(a) if alike(sets[a], sets[b], 0.8)}
    every = [(r["id"], r["leader"]) for r in meet(lists, lists, 0).collect()]
    assert links <= set(every) and len(every) == len(set(every))
    even = meet(lists.where("id % 2 = 1"), lists.where("id % 2 = 0"), 0)
    some = [(r["id"], r["leader"]) for r in even.collect()]
    assert {(a, b) for a, b in links if a % 2 and not b % 2} <= set(some)
    assert all(a > b and a % 2 and not b % 2 for a, b in some) and len(some) == len(set(some))
    few = [(r["id"], r["leader"]) for r in meet(lists, lists, 0, 2).collect()]
    cut = {a for a, b in few if b < 0}
    assert {(a, b) for a, b in every if a not in cut} <= set(few)


def test_rows_of_another_kind_do_not_meet(spark, monkeypatch):
    """Two alphabets: blocks of one are not dealt to the cells of the other."""
    monkeypatch.setattr(similar, "CELL_ROWS", 16)
    monkeypatch.setattr(similar, "LEAST_CELL_ROWS", 1)
    rng = random.Random(6)
    kinds = ["abcdefgh ", "qrstuvwx "]
    texts = ["".join(rng.choice(kinds[i % 2]) for _ in range(200)) for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    sized = similar.sized(df, text="t", threshold=0.8, n_gram=3)
    seen, cells = [], similar._cells

    def watched(blocks, others, threshold, same):
        seen.append((len(blocks), cells(blocks, others, threshold, same)))
        return seen[-1][1]

    monkeypatch.setattr(similar, "_cells", watched)
    lists = similar.size_lists(sized)
    assert similar.by_parities(sized, threshold=0.8)(lists, lists, 0).count() == 0
    n, made = seen[0]
    assert len(made) <= 0.75 * n * (n + 1) / 2
