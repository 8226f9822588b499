import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import stats


@pytest.mark.parametrize("top", [1, 40, 977])
def test_histogram_matches_numpy(labelled, top):
    rng = np.random.default_rng(top)
    lengths = rng.integers(1, top + 1, 400)
    df = labelled([("x" * int(n), 1, "s", "safe") for n in lengths])
    clipped = np.minimum(lengths, np.quantile(lengths, 0.99))
    counts, edges = np.histogram(clipped, bins=50)
    got = {r.bin: (r.low, r.n) for r in stats.length_histogram(df).collect()}
    assert [got[i][1] for i in range(50)] == counts.tolist()
    for i, (low, _) in got.items():
        assert low == pytest.approx(edges[i])


def test_quantiles_and_words_match_numpy(labelled):
    rng = np.random.default_rng(0)
    texts = [" ".join("w" * int(k) for k in rng.integers(1, 9, rng.integers(1, 30))) for _ in range(99)]
    df = labelled([(t, i % 2, "s", "safe") for i, t in enumerate(texts)])
    want = np.quantile([len(t) for t in texts], [0.25, 0.5, 0.75, 0.95])
    assert tuple(stats.length_quantiles(df).first()) == pytest.approx(tuple(want))
    row = stats.describe_words(df).where("y = 1").first()
    words = np.array([len(t.split()) for i, t in enumerate(texts) if i % 2])
    assert (row["count"], row.min, row.max) == (len(words), words.min(), words.max())
    assert (row.mean, row.std) == pytest.approx((words.mean(), words.std(ddof=1)))
    assert (row.p25, row.p50, row.p75) == pytest.approx(tuple(np.quantile(words, [0.25, 0.5, 0.75])))


def test_fingerprint_ignores_order_and_sees_changes(labelled):
    rows = [(f"text {i}", i % 2, "s", "safe") for i in range(40)]
    base = stats.fingerprint(labelled(rows)).first()[0]
    assert stats.fingerprint(labelled(rows[::-1]).repartition(7)).first()[0] == base
    assert stats.fingerprint(labelled(rows + rows[:1])).first()[0] != base
    assert stats.fingerprint(labelled([("other", 0, "s", "safe"), *rows[1:]])).first()[0] != base
    assert len(stats.fingerprint(labelled([])).first()[0]) == 16


def test_pivot_listing_and_errors(labelled):
    df = labelled([("a" * 4000, 1, "s", "x"), ("b" * 5000, 1, "t", "x"), ("c" * 9000, 0, "t", "x")])
    assert {tuple(r) for r in stats.source_pivot(df).collect()} == {("s", 0, 1), ("t", 1, 1)}
    assert [r.char_len for r in stats.longest(df).collect()] == [5000, 4000]
    assert stats.count_longer(df).first().n == 2
    assert "TakeOrdered" in stats.longest(df)._jdf.queryExecution().toString()
    assert [r.preview for r in stats.first_of_source(df, "t", n=1, chars=3).collect()] == ["bbb"]
    scored = df.withColumns({"y_pred": F.lit(1), "y_prob": F.lit(0.1235)})
    assert [(r.row_id, r.p) for r in stats.error_listing(scored).collect()] == [(2, 0.124)]


@pytest.mark.parametrize("rows", [300, 30_000])
def test_merged_sketches_keep_their_error(spark, rows):
    """Two builds, merged from what was stored, against the exact union."""
    table = spark.range(rows).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("source"),
        F.lit(1).alias("y"),
        F.expr("repeat('x', cast(1 + pow(id * 7919 % 1000 / 1000, 3) * 900 as int))").alias("prompt"),
    )
    builds = [table.where(F.col("source") == "s0"), table.where(F.col("source") == "s1")]
    stored = stats.length_sketches(builds[0]).unionAll(stats.length_sketches(builds[1]))
    merged = stats.merge_sketches(stored, ["y"])
    got = stats.sketch_quantiles(merged, ["y"]).first()
    lengths = np.sort([len(r.prompt) for r in table.collect()])
    assert got.n == rows
    for q in stats.QUANTILES:
        value = got[f"p{round(q * 100)}"]
        low, high = np.searchsorted(lengths, [value, value + 1]) / rows
        slack = stats.sketch_error() + 1 / rows
        assert low - slack <= q <= high + slack


def test_digests_follow_appends_and_deletions(labelled):
    rows = [(f"text {i}", i % 2, f"s{i % 3}", "x") for i in range(60)] + [(None, 0, "s0", "x")]
    df = labelled(rows + rows[:5])
    late = F.col("row_id") % 4 == 1
    stored = stats.digests(df.where(~late), ["source"])
    appended = stats.combined_digests(
        stored.unionAll(stats.digests(df.where(late), ["source"])), ["source"]
    )
    whole = stats.fingerprint(df).first()[0]
    assert stats.fingerprint_of(appended).first()[0] == whole
    gone = stats.digests(df.where("source = 's1'"), ["source"])
    left = stats.combined_digests(appended, ["source"], without=gone)
    assert {r.source for r in left.collect()} == {"s0", "s2"}
    want = stats.fingerprint(df.where("source <> 's1'")).first()[0]
    assert stats.fingerprint_of(left).first()[0] == want != whole
    nothing = stats.combined_digests(left, without=left)
    assert stats.fingerprint_of(nothing).first()[0] == stats.fingerprint(df.limit(0)).first()[0]
