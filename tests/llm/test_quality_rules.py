import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.llm import quality_rules
from labelloom.llm.quality_rules import bin_start, filter_quality, judge_ids, measure, sketch_bin

SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "a", " ", "b " * 8, "b " * 9, "x y " * 20, "a\nb\na\n\n\nb\n"]
    for _ in range(150):
        vocabulary = ["a", "bü", "c#", "\n", "😀", "d\n", "|", "\x0b", "e<>"][: rng.randint(1, 9)]
        out.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))))
    passage = " ".join(f"p{i}" for i in range(12))
    out.append(f"{passage} x y z {passage} {passage[:20]} q " + " ".join(map(str, range(90))))
    return out + [" ".join(f"w{i % 7001}" for i in range(15_000))]


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in measure(df).collect()}
    assert got == {i: brute_force(t) for i, t in rows}


def test_bins_hold_their_values_within_their_width(spark):
    values = [*range(300), 1000, 4095, 4096, 10**6, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = df.select("v", sketch_bin(F.col("v")).alias("b")).select(
        "v", "b", bin_start(F.col("b")).alias("s")
    ).collect()
    for r in rows:
        assert r["s"] <= r["v"] <= r["s"] * 33 / 32 + 1
    bins = [r["b"] for r in sorted(rows)]
    assert bins == sorted(bins)


def clean(seed):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(10_000)}" for _ in range(60))


def test_fences_follow_the_source(spark):
    """A source of tables keeps its signs; the same signs are odd elsewhere."""
    rows = [(i, clean(i), "en", "prose") for i in range(300)]
    rows += [(1000 + i, clean(i).replace(" ", " | "), "en", "tables") for i in range(300)]
    rows += [(2000, clean(1).replace(" ", " | "), "en", "prose")]
    rows += [(2001, clean(2).replace(" ", " | "), "en", "small")]
    rows += [(2002, clean(3), "en", "small"), (2003, "short", "en", "prose")]
    judged = {r["doc_id"]: r["kept"] for r in judge_ids(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not judged[2000] and not judged[2003]
    # A small source takes the language's fences, which span prose and tables.
    assert judged[2001] and judged[2002]
    assert all(judged[i] for i in range(300)) and all(judged[1000 + i] for i in range(300))


def test_filter_keeps_columns_and_repeated_rows(spark):
    rows = [(1, clean(1), "en", "s", 5, False)] * 2 + [(None, clean(2), None, None, 6, True)]
    rows += [(3, None, None, "s", 7, True)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_words int, kept boolean")
    got = filter_quality(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:3], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge_ids(df).collect() == [] and filter_quality(df).collect() == []


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts())], SCHEMA
    )
    one = sorted(map(str, judge_ids(df.coalesce(1), min_rows=5).collect()))
    assert one == sorted(map(str, judge_ids(df.repartition(9), min_rows=5).collect()))


def test_only_native_operators(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")], SCHEMA)
    plan = measure(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules.MIN_ROWS >= 100


@pytest.mark.parametrize("times, covered", [(1, 0), (2, 16), (3, 24)])
def test_repeated_windows(spark, times, covered):
    text = " ; ".join([" ".join(f"p{i}" for i in range(8))] * times) + " end of text"
    parts = [f"{t} {i}" for i, t in enumerate(text.split(" ; "))]
    df = spark.createDataFrame([(1, " ".join(parts))], "doc_id bigint, text string")
    assert measure(df).first()["n_repeat_words"] == covered


@pytest.mark.parametrize("own", [60, 120, 199, 200, 201])
def test_no_row_count_switches_the_fences(spark, own):
    """Clean rows written without blanks keep their own word lengths, few or many."""
    rows = [(i, clean(i), "en", "prose") for i in range(1500)]
    rows += [
        (5000 + i, " ".join(["x" * 40 + f"{i}y{k}" for k in range(25)]), "zh", "web")
        for i in range(own)
    ]
    judged = judge_ids(spark.createDataFrame(rows, SCHEMA)).where("lang = 'zh' AND kept")
    assert judged.count() == own
