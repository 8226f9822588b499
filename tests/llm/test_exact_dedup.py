import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import exact_dedup
from labelloom.llm.exact_dedup import OpenTable, bucket_tree, drop_exact_copies, exact_groups

SCHEMA = "doc_id bigint, text string"


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for group in groups.values():
        keep = min(group, key=lambda r: (-len(r[1]), r[0]))[0]
        out += [(doc_id, keep, len(group), doc_id == keep) for doc_id, _ in group]
    return sorted(out)


def found(df):
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("flush, bucket", [(1 << 20, 1 << 20), (1, 300)])
def test_random_texts_at_any_memory_bound(spark, flush, bucket, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH_ROWS", 7 if flush == 1 else 1000)
    random.seed(3)
    words = ["a", "b", "ü", "😀", " ", "\n", "\t", "\x0b", " "]
    rows = [
        (i, "".join(random.choices(words, k=random.randint(0, 4)))) for i in range(200)
    ]
    rows += [(1000 + i, " one text  many times" + " " * (i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_groups(df, flush_bytes=flush, bucket_bytes=bucket)
    assert found(got) == brute_force(rows)


def test_null_empty_and_blank_texts_are_one_group(spark):
    df = spark.createDataFrame([(3, None), (1, ""), (2, " \n"), (4, "x" * 300_000)], SCHEMA)
    assert found(exact_groups(df)) == [
        (1, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False), (4, 4, 1, True)
    ]


def test_exactly_one_of_repeated_rows_is_kept(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab")], SCHEMA)
    rows = exact_groups(df).collect()
    assert [r["kept"] for r in rows].count(True) == 1
    assert {r["keep_id"] for r in rows} == {1} and {r["group_size"] for r in rows} == {4}
    assert drop_exact_copies(df).collect() == [(1, "a b")]


def test_rows_with_null_ids_only(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a "), (None, "b")], SCHEMA)
    assert sorted(r["text"] for r in drop_exact_copies(df).collect()) == ["a ", "b"]


def test_an_id_may_repeat_with_other_texts(spark):
    df = spark.createDataFrame([(1, "a"), (5, "a"), (5, "b"), (6, "b")], SCHEMA)
    assert sorted(tuple(r) for r in drop_exact_copies(df).collect()) == [(1, "a"), (5, "b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).collect() == [] and drop_exact_copies(df).collect() == []


def test_clashing_columns_are_carried(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, True), (2, "a", 2, False)],
        "doc_id bigint, text string, group_size int, kept boolean",
    )
    assert drop_exact_copies(df).collect() == [(1, "a", 1, True)]


def test_equal_hashes_do_not_make_contents_equal():
    table = OpenTable(slots=2)
    numbers = [table.number(5, bytes([i % 3])) for i in range(9)]
    assert numbers == [0, 1, 2] * 3 and len(table) == 3


def test_large_buckets_are_dealt_again(spark):
    """Hashes that all fall into one bucket of the first level, and into one of the next."""
    rows = spark.range(2000).select((F.col("id") * 100).alias("hash"), F.lit(10).alias("size"))
    buckets, bucket = bucket_tree(rows, 400)
    sizes = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 2000 and len(sizes) > 50
    assert buckets > 116  # 100, 16 of the second level, and a third one


def test_one_text_is_no_reason_to_deal_again(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("hash"), F.lit(900).alias("size"))
    assert bucket_tree(rows, 1_000_000)[0] == 2
