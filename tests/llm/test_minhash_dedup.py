import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.llm import minhash_dedup
from labelloom.llm.minhash_dedup import (
    BINS,
    components,
    drop_near_copies,
    near_duplicates,
    sketch,
    shingles,
)

SCHEMA = "doc_id bigint, text string"


def brute_force(rows, words, percent):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        n = min(words, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def family(size, length, edits, seed, start=0):
    """Copies of one text with a few words of each changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    rows = []
    for i in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
        rows.append((start + i, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_families_equal_brute_force(spark, words):
    rows = family(120, 60, 6, 1) + family(60, 9, 1, 2, 200) + family(40, 300, 40, 3, 300)
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "É x"), (505, "é x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_duplicates(df, words=words)) == brute_force(rows, words, 80)


def test_links_that_no_star_finds(spark):
    """A chain of copies: most pairs of a bucket are too far apart, neighbours are not."""
    text = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[random.Random(i).randrange(100)] = f"y{i}a"
        text[random.Random(1000 + i).randrange(100)] = f"y{i}b"
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_force(rows, 2, 80)
    assert found(near_duplicates(df, words=2, block=7)) == want
    assert len({r[2] for r in want}) < 5


def test_a_shared_passage_does_not_link(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [
        (i, shared + " " + " ".join(f"d{i}x{j}" for j in range(30))) for i in range(80)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, words=2).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (None, text), (2, text), (2, text), (1, text)], SCHEMA)
    rows = near_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [
        (0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)
    ]


def test_empty_table_and_carried_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and drop_near_copies(empty).collect() == []
    df = spark.createDataFrame(
        [(1, "a b c d e", True, 7), (2, "a b c d e", True, 8), (3, None, None, None)],
        "doc_id bigint, text string, kept boolean, component_id int",
    )
    assert sorted(tuple(r) for r in drop_near_copies(df).collect()) == [
        (1, "a b c d e", True, 7), (3, None, None, None)
    ]


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + " tail")], SCHEMA)
    assert [r["component_id"] for r in near_duplicates(df).collect()] == [1, 1]


def test_bins_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(5)
    for size in (4, 40, 4000):
        shares = []
        for _ in range(60):
            both = rng.integers(0, 2**63, size * 4, dtype=np.uint64)
            only = rng.integers(0, 2**63, size, dtype=np.uint64)
            a = sketch(np.unique(both))
            b = sketch(np.unique(np.concatenate([both, only])))
            shares.append((a == b).mean())
        assert abs(np.mean(shares) - 0.8) < 0.06


def test_sketch_of_one_shingle_fills_all_bins():
    values = sketch(shingles("alone", 5))
    assert len(values) == BINS and len(set(values.tolist())) == 1


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "_WORDS_KNOWN", 3)
    text = " ".join(f"w{i % 50}" for i in range(500))
    known = minhash_dedup._WordHashes()
    assert (shingles(text, 5, known) == shingles(text, 5)).all() and len(known) <= 3


@pytest.mark.parametrize("size", [5, 60, 199, 200, 210, 1000, 5000])
def test_no_pair_at_the_threshold_is_settled_by_the_screen(size):
    """Pairs at similarity 0.8 exactly, by removal or by exchange, pass at every size."""
    rng = np.random.default_rng(size)
    for _ in range(20):
        whole = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        removed = np.delete(whole, rng.choice(len(whole), len(whole) // 5, replace=False))
        swapped = np.unique(np.concatenate([
            np.delete(whole, rng.choice(len(whole), len(whole) // 9, replace=False)),
            rng.integers(0, 2**63, len(whole) // 9, dtype=np.uint64),
        ]))
        sets = [whole, removed, swapped]
        for other in (1, 2):
            pair = [sets[0], sets[other]]
            shared = len(np.intersect1d(*pair))
            assert 100 * shared >= 80 * (len(pair[0]) + len(pair[1]) - shared)
            table = group(pair)
            assert all(len(found) for _, found in minhash_dedup._passing(table, 80))


def group(sets):
    """The first set as an outsider, the others as members."""
    return pa.table(
        {
            "outside": [True] + [False] * (len(sets) - 1),
            "component": list(range(len(sets))),
            "n_shingles": [len(h) for h in sets],
            "bits": [minhash_dedup.parity(h) for h in sets],
        }
    )


def test_the_screen_settles_pairs_far_from_the_threshold():
    rng = np.random.default_rng(1)
    for size in (30, 300, 3000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        others = [
            np.unique(np.concatenate([base[: size // 2], rng.integers(0, 2**63, size // 2, dtype=np.uint64)]))
            for _ in range(50)
        ]
        (_, found), = minhash_dedup._passing(group([np.unique(base), *others]), 80)
        assert len(found) <= 2


def test_parities_fold():
    rng = np.random.default_rng(2)
    small = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    large = np.unique(np.concatenate([small, rng.integers(0, 2**63, 30, dtype=np.uint64)]))
    held = [minhash_dedup.parity(h) for h in (small, large)]
    assert len(held[1]) == 2 * len(held[0])
    parities = minhash_dedup._Parities(held)
    for x, y in ((0, 1), (1, 0)):
        (apart,) = parities.differing(x, np.array([y]))
        assert len(large) - len(small) - 8 <= apart <= len(large) - len(small)


def test_rows_of_a_bucket_of_texts_apart_are_bounded(spark):
    """20,000 members of one bucket, all apart: blocks keep the copies few."""
    members = spark.range(20_000).select(
        F.lit(1).alias("bucket"), "id", F.col("id").alias("component")
    )
    known = spark.range(20_000).select("id", F.lit(1000).cast("long").alias("n_shingles"))
    opened = minhash_dedup._open(members, "bucket", known)
    rows = minhash_dedup._blocks(opened, "bucket", minhash_dedup.BLOCK, minhash_dedup.BLOCK_BITS)
    assert rows.count() <= 6 * 20_000
    largest = rows.groupBy("column", "row").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * minhash_dedup.BLOCK


def test_a_hot_centre_is_dealt_to_many_tasks(spark):
    """Edges and sets of an id that is in half of all edges are split by the other end."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(3000, 6000)]
    pairs = spark.createDataFrame(edges, "a bigint, b bigint")
    hot = minhash_dedup.hot_ids(pairs)
    assert [(r["hot"], r["parts"]) for r in hot.collect()] == [(0, 500)]
    full = spark.range(6001).select("id", F.array("id").alias("set"))
    joined = minhash_dedup._with_sets(pairs, full, hot, "a", "b")
    assert sorted((r["a"], r["b"], r["set_a"]) for r in joined.collect()) == [
        (a, b, [a]) for a, b in sorted(edges)
    ]
    plan = joined._jdf.queryExecution().toString()
    assert "part" in plan.split("SortMergeJoin")[1].split("\n")[0] or "BroadcastHashJoin" in plan


def test_map_columns_and_hot_copies(spark):
    """A column that cannot be hashed as it is, and one text in most of the rows."""
    rows = [(1, "a b c d e f", {"k": 1})] * 40 + [(i, "", {}) for i in range(20)]
    rows += [(100 + i, "a b c d e f", {"k": i}) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", m map<string, int>")
    got = drop_near_copies(df).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*range(20), 1])


def test_two_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a + " tail"), (5, b), (9, b + " tail"), (7, c), (7, c + " tail")]
    rows += [(None, "n " + c.upper()), (None, "q r s t u v"), (2, "x y z"), (2, "x y z")]
    got = sorted(map(tuple, drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert (3, a) in got and (5, b) in got and (None, "q r s t u v") in got
    assert got.count((2, "x y z")) == 1
    assert sum(i == 7 for i, _ in got) == 1 and len(got) == 5
