import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import (
    char_ngrams,
    head_tokens,
    length_between,
    minhash_signature,
    normalize_text,
    preview,
    subtype_priority,
    word_count,
)
from labelloom.functions.minhash import BASE, PRIME, gram_set, lanes
from labelloom.functions.text import SLICE_BYTES, _per_text, in_slices, jaccard

TEXTS = [
    "ＡＢＣ１２ x",
    "ﬁnd me",
    "ﷺ",
    "a\u001cb\u0085c d　e",
    "  Two   words ",
    "İstanbul ΟΔΟΣ ẞ ǅ",
    "é",
    "",
    " \t\n",
    "😀 ok",
]


def one_column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def values(df):
    return [r[1] for r in sorted(df.collect())]


def test_normalize_matches_python(spark):
    df = one_column(spark, [*TEXTS, None])
    want = [" ".join(unicodedata.normalize("NFKC", t).lower().split()) for t in TEXTS]
    assert values(df.select("i", normalize_text("t"))) == [*want, None]


def test_normalisation_runs_once_under_a_filter(spark):
    df = one_column(spark, TEXTS).withColumn("norm", normalize_text("t"))
    plan = df.where(length_between("norm"))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1


def test_ngrams(spark):
    df = one_column(spark, ["", "ab", "abc", "abcd", "a😀bc"])
    got = values(df.select("i", char_ngrams("t", 3)))
    assert got == [[], [], ["abc"], ["abc", "bcd"], ["a😀b", "😀bc"]]


def test_length_bounds(spark):
    df = one_column(spark, ["a" * n for n in (4, 5, 20000, 20001)])
    assert values(df.select("i", length_between("t"))) == [False, True, True, False]


def test_words_preview_and_head(spark):
    df = one_column(spark, TEXTS)
    assert values(df.select("i", word_count("t"))) == [len(t.split()) for t in TEXTS]
    assert values(df.select("i", preview("t", 3))) == [t[:3] for t in TEXTS]
    long = " ".join(map(str, range(600)))
    got = one_column(spark, ["", " a  b ", long]).select("i", head_tokens("t", 512))
    assert values(got) == ["", "a b", " ".join(map(str, range(512)))]


def test_priority(spark):
    df = one_column(spark, ["harmful", "jailbreak", "safe", "O1", None])
    assert values(df.select("i", subtype_priority("t"))) == [0, 1, 2, 3, 3]


def test_signature_matches_plain_integers(spark):
    texts = ["hello world, hello", "abc", "x" * 3000, "grüße 😀 an alle"]

    def gram(points):
        value = points[0]
        for point in points[1:]:
            value = (value * BASE + point) % PRIME
        return pow(value, 5, PRIME)

    def signature(text, n=5, num_perm=16):
        points = [ord(c) for c in text]
        width = min(n, len(points))
        grams = {gram(points[i : i + width]) for i in range(len(points) - width + 1)}
        return [min((a * g + b) % 2**32 for g in grams) for a, b in zip(*lanes(num_perm))]

    got = values(one_column(spark, texts).select("i", minhash_signature("t", 16)))
    assert got == [signature(t) for t in texts]


def test_signatures_estimate_jaccard(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = base[:2600] + "".join(rng.choice("abcdefgh ") for _ in range(400))
    df = one_column(spark, [base, other])
    left, right = (
        np.array(v) for v in values(df.select("i", minhash_signature("t", 512)))
    )
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (base, other)]
    exact = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    assert abs((left == right).mean() - exact) < 0.07


def test_exact_jaccard(spark):
    df = spark.createDataFrame([("abcdefgh", "abcdefxx")], "a string, b string")
    assert df.select(jaccard(gram_set("a", 5), gram_set("b", 5))).first()[0] == pytest.approx(
        2 / 6
    )


def test_gram_set_is_a_set(spark):
    got = values(one_column(spark, ["aaaaaaaa", "ab", ""]).select("i", F.size(gram_set("t", 5))))
    assert got == [1, 1, 1]


def test_texts_of_a_batch_are_python_objects_a_slice_at_a_time():
    batch = pa.array(["é" * 20_000, None, "", "é" * 1_000_000, *["ö" * 10_000] * 2000])
    parts = list(in_slices(batch))
    assert pa.concat_arrays(parts).equals(batch)
    assert all(len(p) == 1 or p.nbytes < 2 * SLICE_BYTES for p in parts)
    udf = _per_text(T.StringType(), str.upper)
    tracemalloc.start()
    made = udf.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist()[-1] == "Ö" * 10_000
    assert udf.func(batch.slice(0, 0)).to_pylist() == []
    # All of them at once took over 40 MB.
    assert peak < 20 << 20


def test_char_ngrams_in_one_walk_over_the_text(spark):
    texts = ["a\U0001F600b\n\rcd\U0001F600\U0001F601e", "abcd", "abcde", None, "", "\r\n" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    grams = df.select(char_ngrams("t", 5).alias("g"))
    want = [[t[i : i + 5] for i in range(len(t) - 4)] if t else [] for t in texts]
    assert [row["g"] for row in grams.collect()] == want
    # A slice and a join for each gram took three times as long.
    assert "slice" not in grams._jdf.queryExecution().optimizedPlan().toString()
