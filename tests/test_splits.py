import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import splits
from labelloom.plans import save_splits


@pytest.fixture
def strata(labelled):
    """Strata of 2, 7, 41 and 100 rows."""
    rows = []
    for source, y, n in (("a", 1, 2), ("b", 0, 7), ("c", 1, 41), ("d", 0, 100)):
        rows += [(f"{source} {i}", y, source, "safe") for i in range(n)]
    random.Random(2).shuffle(rows)
    return labelled(rows)


def largest_remainder(sizes, total):
    share = {k: n * total / sum(sizes.values()) for k, n in sizes.items()}
    quota = {k: math.floor(v) for k, v in share.items()}
    order = sorted(sizes, key=lambda k: (-(share[k] - quota[k]), k))
    for k in order[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def test_quotas_and_partition_of_the_rows(strata):
    rows = splits.stratified_split(strata).collect()
    assert sorted(r.row_id for r in rows) == list(range(150))
    counts = Counter((f"{r.y}_{r.source}", r.split) for r in rows)
    sizes = {"1_a": 2, "0_b": 7, "1_c": 41, "0_d": 100}
    test = largest_remainder(sizes, math.ceil(0.15 * 150))
    rest = {k: n - test[k] for k, n in sizes.items()}
    val = largest_remainder(rest, math.ceil(0.15 / 0.85 * sum(rest.values())))
    for stratum, n in sizes.items():
        assert counts[stratum, "test"] == test[stratum]
        assert counts[stratum, "val"] == val[stratum]
        assert counts[stratum, "train"] == n - test[stratum] - val[stratum]


def test_splits_do_not_depend_on_partitions(strata):
    def assigned(df):
        return sorted(splits.make_splits(df).select("row_id", "split").collect())

    want = assigned(strata)
    for df in (strata.repartition(1), strata.repartition(17), strata.orderBy(F.desc("row_id"))):
        assert assigned(df) == want
    other = splits.make_splits(strata, splits.SplitSettings(seed=1))
    assert sorted(other.select("row_id", "split").collect()) != want


def test_a_stratum_of_one_row_is_an_error(labelled):
    df = labelled([("a", 1, "a", "x"), ("b", 0, "b", "x"), ("c", 0, "b", "x")])
    with pytest.raises(Exception, match="two rows or more: 1_a"):
        splits.stratified_split(df).collect()


def classes(df):
    return Counter(r.y for r in df.select("y").collect())


def test_balance(strata):
    assert classes(splits.balance_classes(strata)) == {1: 43, 0: 43}
    assert classes(splits.balance_classes(strata, ratio=0.5)) == {1: 21, 0: 21}
    assert classes(splits.balance_classes(strata, ratio=2.0)) == {1: 43, 0: 86}
    assert splits.balance_classes(strata.where("y = 0")).count() == 0


def test_short_class_keeps_all_and_moves_the_fraction(labelled):
    df = labelled([(f"t{i}", int(i < 900), "s", "x") for i in range(1000)])
    kept = splits.fix_prevalence(df, block_frac=0.5)
    assert classes(kept) == {1: 500, 0: 100}
    row = splits.achieved_prevalence(kept).first()
    assert (row.n, row.block, round(row.block_frac, 4)) == (600, 500, 0.8333)


def test_half_even_target(labelled):
    df = labelled([(f"t{i}", int(i < 3), "s", "x") for i in range(5)])
    assert classes(splits.fix_prevalence(df, block_frac=0.5)) == {1: 2, 0: 2}


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds(strata, k):
    rows = splits.assign_folds(strata, k=k).collect()
    per_stratum = Counter((r.source, r.fold) for r in rows)
    for source, n in (("a", 2), ("b", 7), ("c", 41), ("d", 100)):
        sizes = [per_stratum[source, fold] for fold in range(k)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    overall = Counter(r.fold for r in rows)
    assert max(overall.values()) - min(overall.values()) <= 1


def test_only_the_training_fold_is_balanced(strata):
    folded = splits.assign_folds(strata, k=5)
    train, held_out = splits.fold_frames(folded, 2)
    assert len(set(classes(train).values())) == 1
    assert held_out.count() == folded.where("fold = 2").count()
    assert train.where("fold = 2").count() == 0


def test_samples(strata):
    assert splits.sample_rows(strata, n=50, seed=7).count() == 50
    assert splits.sample_rows(strata, n=5000).count() == 150
    assert splits.sample_rows(strata, frac=0.1).count() == 15
    first = splits.sample_rows(strata, n=50, seed=7).select("row_id").collect()
    again = splits.sample_rows(strata.repartition(9), n=50, seed=7).select("row_id").collect()
    assert sorted(first) == sorted(again)
    with pytest.raises(ValueError):
        splits.sample_rows(strata)
    assert splits.sample_strata(strata, frac=0.15).count() == 22
    shuffled = [r.row_id for r in splits.shuffled(strata).collect()]
    assert sorted(shuffled) == list(range(150)) and shuffled != sorted(shuffled)


def test_a_stratum_is_ranked_by_hash_prefix_only(spark):
    df = spark.range(20000).select(
        F.col("id").alias("row_id"), F.lit(0).alias("y"), F.lit("s").alias("source")
    )
    rows = splits.stratified_split(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"test": 3000, "val": 3000, "train": 14000}


def test_manifest_and_saved_splits(spark, strata, tmp_path):
    path, manifest = str(tmp_path / "splits"), str(tmp_path / "manifest")
    saved = save_splits(strata, path, manifest)
    row = spark.read.json(manifest).first()
    counts = {r.split: (r.n, r.block, r.safe) for r in splits.split_counts(saved).collect()}
    assert counts["train"] == (row.train, row.train_block, row.train_safe)
    assert counts["test"] == (row.test, row.test_block, row.test_safe)
    assert counts["val"][0] == row.val and row.train_block == row.train_safe
    assert len(row.content_hash) == 16
    kept = row.asDict()
    again = save_splits(strata, path, manifest)
    assert again.count() == saved.count()
    for other in (strata.limit(0), strata.limit(149)):
        with pytest.raises(ValueError, match="content_hash"):
            save_splits(other, path, manifest)
    with pytest.raises(ValueError, match="seed, test_frac"):
        save_splits(strata, path, manifest, splits.SplitSettings(seed=7, test_frac=0.4))
    assert spark.read.json(manifest).first().asDict() == kept


def test_other_labels_belong_to_no_class(spark):
    rows = [(10 * i + k, y, "s") for i in range(10) for k, y in enumerate((0, 1, 2, None))]
    df = spark.createDataFrame(rows, "row_id bigint, y int, source string")
    for cut in (splits.balance_classes(df), splits.fix_prevalence(df)):
        assert sorted(r.y for r in cut.collect()) == [0] * 10 + [1] * 10
