import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import dedup, near_dup
from labelloom.operators.dedup import drop_leaked, leaked_rows
from labelloom.plans import BuildSettings, build_dataset, save_build
from labelloom.plans.build import deduplicated, normalized

SMALL = BuildSettings(num_perm=64, n_gram=3)


def plain_unify(rows, least, most):
    """(prompt, y, subtype) that are left, one text at a time, without near duplicates."""
    rank = {"harmful": 0, "jailbreak": 1, "safe": 2}
    best = {}
    for row_id, (prompt, y, _, subtype) in enumerate(rows):
        norm = " ".join(prompt.lower().split())
        if least <= len(norm) <= most:
            best.setdefault(norm, []).append((rank.get(subtype, 3), row_id, prompt, y, subtype))
    return sorted(min(group)[2:] for group in best.values())


def test_build_equals_plain_python(labelled):
    """Texts are numbers in words, so different ones share few characters in a row."""
    rng = random.Random(21)
    digits = "zero one two three four five six seven eight nine".split()
    rows = []
    for _ in range(80):
        words = [digits[int(d)] for d in f"{rng.randrange(40) * 7919 % 100_000:05d}"]
        prompt = rng.choice([" ", "  ", "\n"]).join(words)
        if rng.random() < 0.5:
            prompt = prompt.upper()
        subtype, y = rng.choice([("harmful", 1), ("jailbreak", 1), ("safe", 0), ("O7", 1)])
        rows.append((prompt, y, rng.choice("pq"), subtype))
    rows += [("six", 1, "p", "harmful"), ("7 " * 400, 0, "q", "safe")]
    settings = BuildSettings(num_perm=64, n_gram=3, min_prompt_len=6, max_prompt_len=500)
    exact = deduplicated(labelled(rows), settings)
    got = sorted(tuple(r) for r in exact.select("prompt", "y", "subtype").collect())
    assert got == plain_unify(rows, 6, 500)
    unified = build_dataset(labelled(rows), settings).unified
    assert sorted(unified.columns) == ["prompt", "row_id", "source", "subtype", "y"]
    assert {tuple(r) for r in unified.select("prompt", "y", "subtype").collect()} <= set(got)


def test_unlisted_subtype_loses_unless_the_label_is_preferred(labelled):
    raw = labelled([("Tea at four", 1, "tax", "O1"), ("tea at  four", 0, "b", "safe")])
    assert deduplicated(raw).first().subtype == "safe"
    assert deduplicated(raw, BuildSettings(prefer_label=1)).first().subtype == "O1"


def test_leaks_before_dedup(labelled):
    raw = labelled(
        [("shared text", 1, "a", "harmful")]
        + [("Shared  text", 0, "b", "safe")] * 20
        + [("only safe", 0, "b", "safe")] * 3
    )
    rows = normalized(raw)
    assert leaked_rows(rows).count() == 20
    left = drop_leaked(rows).collect()
    assert sorted(r.y for r in left) == [0, 0, 0, 1]


def test_dedup_is_idempotent_and_partition_invariant(labelled):
    rng = random.Random(1)
    rows = [
        (f"text number {rng.randrange(30)}", rng.randrange(2), "s", rng.choice(["safe", "harmful", "x"]))
        for _ in range(200)
    ]
    raw = labelled(rows)
    want = sorted(deduplicated(raw).drop("copies").collect())
    for df in (raw.repartition(1), raw.repartition(17), raw.orderBy(F.desc("row_id"))):
        assert sorted(deduplicated(df).drop("copies").collect()) == want
    columns = ["row_id", "prompt", "y", "source", "subtype"]
    again = deduplicated(deduplicated(raw).select(columns)).drop("copies")
    assert sorted(again.collect()) == want
    assert deduplicated(raw).agg(F.sum("copies")).first()[0] == 200


def sequential(buckets):
    """The plain visiting rule over {row: set of buckets}."""
    taken, dropped = set(), set()
    for row in sorted(buckets):
        if buckets[row] & taken:
            dropped.add(row)
        else:
            taken |= buckets[row]
    return dropped


def members_of(spark, buckets):
    rows = [(i, b) for i, row in buckets.items() for b in row]
    df = spark.createDataFrame(rows, "row_id bigint, b int")
    return df.select(
        F.struct(F.lit(0).alias("priority"), "row_id").alias("rank"),
        F.struct(F.col("b").alias("band")).alias("bucket"),
    )


def test_chain_keeps_both_ends(spark):
    members = members_of(spark, {1: {1}, 2: {1, 2}, 3: {2}})
    found = near_dup.greedy_keep(members)
    assert [r.row_id for r in found.dropped.collect()] == [2]


def test_a_long_chain_in_random_order_takes_few_rounds(spark):
    order = list(range(5000))
    random.Random(5).shuffle(order)
    buckets = {place: {i, i + 1} for i, place in enumerate(order)}
    found = near_dup.greedy_keep(members_of(spark, buckets))
    assert {r.row_id for r in found.dropped.collect()} == sequential(buckets)
    assert 1 < found.rounds < 20


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    size = rng.randrange(5, 50)
    buckets = {
        i: {rng.randrange(rng.choice([3, 40])) for _ in range(rng.randrange(1, 4))}
        for i in range(size)
    }
    found = near_dup.greedy_keep(members_of(spark, buckets).repartition(5))
    assert {r.row_id for r in found.dropped.collect()} == sequential(buckets)
    listed = {r.dropped_id: r.kept_id for r in found.listing().collect()}
    kept = set(buckets) - sequential(buckets)
    assert listed == {
        d: min(k for k in kept if k < d and buckets[k] & buckets[d])
        for d in sequential(buckets)
    }


def test_one_bucket_with_most_rows_is_split_off(spark):
    buckets = {i: {0, i + 1} for i in range(3000)}
    buckets.update({i: {10_000 + i // 2} for i in range(3000, 6000)})
    found = near_dup.greedy_keep(members_of(spark, buckets))
    assert {r.row_id for r in found.dropped.collect()} == sequential(buckets)


def text_family(rng, size):
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    texts = []
    for _ in range(size):
        at = rng.randrange(250)
        texts.append(base[:at] + rng.choice("xyz") * rng.choice([1, 20]) + base[at + 5 :])
    return texts


def test_verified_greedy_equals_brute_force(labelled):
    rng = random.Random(9)
    texts = [t for _ in range(4) for t in text_family(rng, 8)]
    raw = labelled([(t, 0, "s", "safe") for t in texts])
    exact = deduplicated(raw)
    found = near_dup.find_near_duplicates(exact, num_perm=64, n_gram=3, verify=True)
    buckets = {}
    bands = near_dup.row_buckets(exact, num_perm=64, n_gram=3)
    for r in bands.select("rank.row_id", "bucket").collect():
        buckets.setdefault(r.row_id, set()).add(r.bucket)
    ranks = exact.select("row_id", near_dup.visiting_rank().alias("rank")).collect()
    rank = {r.row_id: tuple(r["rank"]) for r in ranks}
    norm = {r.row_id: r.prompt_norm for r in exact.collect()}
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in norm.items()}

    def alike(a, b):
        return len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8

    kept = []
    for i in sorted(buckets, key=rank.get):
        if not any(buckets[i] & buckets[k] and alike(i, k) for k in kept):
            kept.append(i)
    dropped = {r.row_id for r in found.dropped.collect()}
    assert dropped == set(buckets) - set(kept) and dropped
    listed = near_dup.with_jaccard(found.listing(), exact, n_gram=3).collect()
    assert {r.dropped_id for r in listed} == dropped
    assert all(r.jaccard >= 0.8 for r in listed)


def test_near_duplicates_in_the_build(labelled, tmp_path, spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(1000)) for _ in range(200))
    raw = labelled(
        [
            (text + " end", 1, "a", "jailbreak"),
            (text + " fin", 1, "b", "harmful"),
            ("something else entirely", 0, "c", "safe"),
            ("no", 0, "c", "safe"),
        ]
    )
    built = build_dataset(raw, SMALL)
    assert sorted(r.source for r in built.unified.collect()) == ["b", "c"]
    assert {r.stage: r.n for r in built.funnel.collect()} == {
        "raw_total": 4,
        "dropped_length": 1,
        "dropped_exact_dedup": 0,
        "dropped_minhash_dedup": 1,
        "dropped_leak_check": 0,
        "total_after_dedup": 2,
    }
    save_build(built, str(tmp_path / "unified"), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "unified")).count() == 2
    saved = spark.read.json(str(tmp_path / "stats"))
    assert saved.where("stage = 'per_source' AND key = 'b/1'").first().value == 1


def test_nothing_to_compare(labelled):
    built = build_dataset(labelled([("a single prompt", 1, "a", "harmful")]), SMALL)
    assert built.unified.count() == 1 and built.near.listing().count() == 0


@pytest.mark.parametrize("num_perm, bands", [(128, (9, 13)), (64, (5, 11))])
def test_bands(num_perm, bands):
    assert near_dup.lsh_bands(0.8, num_perm) == bands


def test_a_text_in_a_third_of_the_rows_is_not_shuffled_by_its_hash(spark, labelled):
    """Safe rows no blocked row can match pass by; a hot conflict is met by broadcast."""
    rows = [("both ways", 0, "s", "safe")] * 400 + [("both ways", 1, "b", "harmful")]
    rows += [(f"safe text {i}", 0, "s", "safe") for i in range(800)]
    rows += [(f"bad text {i}", 1, "b", "harmful") for i in range(30)] + [("bad text 3", 0, "s", "safe")]
    df = labelled(rows).withColumnRenamed("prompt", "prompt_norm")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        leaked = dedup.leaked_rows(df)
        assert leaked.count() == 401 and leaked.columns == df.columns
        left = dedup.drop_leaked(df)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 800 + 31 and left.where("y = 0").count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Filter on both sides and hot conflicts are broadcast, one join is shuffled.
    assert plan.count("BroadcastHashJoin") >= 3
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1


def test_exact_dedup_sorts_no_text(labelled):
    """Who stays is decided on hashes; rows equal in text and id leave one."""
    rows = [(f"t{i % 7}", i % 2, "s", "safe") for i in range(60)]
    df = labelled(rows).unionAll(labelled(rows[:3])).withColumnRenamed("prompt", "prompt_norm")
    kept = dedup.exact_dedup(dedup.with_priority(df), copies="copies")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    found = {r.prompt_norm: (r.row_id, r.copies) for r in kept.collect()}
    assert kept.count() == 7 and sum(n for _, n in found.values()) == 63
    assert all(row_id == int(text[1:]) for text, (row_id, _) in found.items())
    assert kept.columns == [*df.columns, "priority", "copies"]
    assert "SortMergeJoin" not in plan
