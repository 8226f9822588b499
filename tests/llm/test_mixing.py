import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labelloom.llm import mixing
from labelloom.llm.common import row_key
from labelloom.llm.mixing import arrange, plan_mix

SCHEMA = "doc_id bigint, text string, source string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(totals):
    """Resharing the excess by weight until no source is above its limit."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    found, free = {}, set(names)
    rest = 1.5 * sum(totals.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest / whole > 2 * totals[s]}
        if not over:
            return found | {s: weight[s] * rest / whole for s in free}
        for s in over:
            found[s] = 2.0 * totals[s]
            rest -= found[s]
        free -= over
    return found


def brute_force(rows):
    totals = {}
    for _, text, source in rows:
        totals[source] = totals.get(source, 0) + size(text)
    want = targets(totals)
    out = []
    for source in totals:
        at = 0
        own = [(hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, t, s in rows if s == source]
        for _, doc_id, text in sorted(own, key=lambda r: r[:2]):
            n = size(text)
            copies = sum(k * totals[source] + at + n / 2 < want[source] for k in range(2))
            out.append((doc_id, n, totals[source], want[source], copies * n))
            at += n
    return sorted(out)


@pytest.fixture
def rows():
    rng = random.Random(6)
    names = ["a", "b", "B", "ä", "hot", None]
    out = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        out.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), source))
    return out + [(2000, None, "c"), (2001, "x " * 5000, "d")]


@pytest.mark.parametrize("per_prefix", [3, 20_000])
def test_sizes_targets_and_taken_equal_brute_force(spark, rows, per_prefix):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = plan_mix(df, rows_per_prefix=per_prefix)
    got = sorted(
        tuple(r)
        for r in plan.select("doc_id", "size", "source_size", "target", "taken").collect()
    )
    want = brute_force(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_taken_words_come_near_the_targets(spark, rows):
    plan = plan_mix(spark.createDataFrame(rows, SCHEMA))
    for r in (
        plan.groupBy("source")
        .agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"))
        .collect()
    ):
        assert abs(r["t"] - r["g"]) <= r["m"] / 2 + 1e-6
    assert plan.where("taken > 2 * size").isEmpty()


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(1500)]
    plan = plan_mix(spark.createDataFrame(rows, SCHEMA))
    positions = plan.select("source", F.explode("positions").alias("t"))
    early = {
        r["source"]: r["e"]
        for r in positions.groupBy("source").agg(F.avg((F.col("t") < 0.5).cast("int")).alias("e")).collect()
    }
    # The integral to 1/2 of a rate from a to b (mean 1) is (3a + b) / 8.
    assert early["a"] == pytest.approx((3 * 1.5 + 0.5) / 8, abs=0.01)
    assert early["b"] == pytest.approx(0.5, abs=0.01)
    assert early["c"] == pytest.approx((3 * 0.5 + 1.5) / 8, abs=0.01)
    assert positions.where("t < 0 OR t > 1").isEmpty()


def test_arranged_rows_are_the_copies_in_order(spark, rows):
    df = spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA + ", copies string")
    plan = plan_mix(df)
    got = [r["doc_id"] for r in arrange(df, plan, partitions=3).collect()]
    want = [
        r["doc_id"]
        for r in plan.select("doc_id", F.explode("positions").alias("t")).orderBy("t", "doc_id").collect()
    ]
    assert got == want
    assert arrange(df, plan).columns == df.columns


def test_reruns_agree(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    first, again = plan_mix(df), plan_mix(df.repartition(7))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_empty_table_and_table_without_words(spark):
    assert plan_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)
    assert [r["taken"] for r in plan_mix(df).collect()] == [0, 0]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s")], SCHEMA)
    plan = plan_mix(df)
    assert plan.count() == 3
    assert abs(plan.agg(F.sum("taken")).first()[0] - 9) <= 1


def words_of(df, plan):
    """Copies of each text: as planned by row, and as arranged."""
    planned = {}
    keyed = df.withColumn("row_key", row_key(df)).dropDuplicates(["doc_id", "row_key"])
    rows = plan.join(
        keyed.select(F.col("doc_id").alias("i"), "row_key", "text"),
        F.col("doc_id").eqNullSafe(F.col("i")) & (plan["row_key"] == keyed["row_key"]),
    )
    for r in rows.select("doc_id", "text", "copies").collect():
        planned[r["doc_id"], r["text"]] = planned.get((r["doc_id"], r["text"]), 0) + r["copies"]
    arranged = {}
    for r in arrange(df, plan).collect():
        arranged[r["doc_id"], r["text"]] = arranged.get((r["doc_id"], r["text"]), 0) + 1
    return {k: n for k, n in planned.items() if n}, arranged


def test_rows_of_one_id_are_taken_each_by_its_own_plan(spark):
    rows = [(1, "a " * 9, "s"), (1, "b " * 7, "s"), (1, "b " * 7, "s"), (None, "c", "s"),
            (None, "d d", "s"), (None, "c", "s"), (None, None, "s"), (2, "e " * 40, "t")]
    df = spark.createDataFrame([(*r, {"k": 1}) for r in rows], SCHEMA + ", m map<string, int>")
    plan = plan_mix(df)
    assert plan.count() == len(rows)
    planned, arranged = words_of(df, plan)
    assert planned == arranged
    taken = plan.agg(F.sum("taken")).first()[0]
    assert sum(len((t or "").split()) * n for (_, t), n in arranged.items()) == taken
    assert arrange(df, plan).columns == df.columns


@pytest.mark.parametrize("equal", [True, False])
def test_an_id_that_holds_most_rows_is_split(spark, equal, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 7)
    text = "'w w w'" if equal else "concat('w w ', id)"
    hot = spark.range(600).selectExpr("if(id % 2 = 0, 5, null) AS doc_id", f"{text} AS text")
    cold = spark.range(100).selectExpr("id + 10 AS doc_id", "'w w w' AS text")
    df = hot.unionAll(cold).withColumn("source", F.lit("s"))
    plan = plan_mix(df, rows_per_prefix=10)
    assert plan.count() == 700
    totals = plan.agg(F.sum("taken"), F.max("target"), F.max("size")).first()
    assert abs(totals[0] - totals[1]) <= totals[2] / 2
    places = [r["t"] for r in plan.select(F.explode("positions").alias("t")).collect()]
    assert len(set(places)) == len(places)
    planned, arranged = words_of(df, plan)
    assert planned == arranged
    again = plan_mix(df.repartition(5), rows_per_prefix=10)
    assert sorted(map(str, plan.collect())) == sorted(map(str, again.collect()))
    rows = mixing._in_blocks(
        df.groupBy("doc_id", "source", row_key(df).alias("row_key")).count(), 10
    )
    largest = rows.groupBy("source", "prefix", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 40


def test_sources_in_order_of_code_points(spark):
    totals = spark.createDataFrame(
        [("b", 10, 1), ("B", 10, 1), (None, 10, 1), ("é", 10, 1)],
        "source string, source_size bigint, rows bigint",
    )
    ranks = {r["source"]: r["rank"] for r in mixing.source_targets(totals).collect()}
    assert ranks == {"B": 0, "b": 1, "é": 2, None: 3}
