"""The pipeline, stage by stage, against plain Python on a small fixture."""

import random

import pytest
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm import test_exact_dedup, test_minhash_dedup, test_mixing, test_quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(25, 80))) for _ in range(60)]
    texts += [t + " " for t in texts[:15]]  # exact copies
    texts += [t.replace(t.split()[0], "changed", 1) for t in texts[20:30]]  # near copies
    texts += ["too short", None, "", " ".join(["same words again and again all over"] * 30)]
    texts += [t.replace(" ", " $$$ ") for t in texts[:2]]
    rng.shuffle(texts)
    return [
        (i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t or ""))
        for i, t in enumerate(texts)
    ]


def fences(rows):
    """Rows that pass the base rule and the fences of the whole table, which is small."""
    measured = {r[0]: test_quality_rules.brute_force(r[1]) for r in rows}
    lines = {
        r[0]: len([x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]) for r in rows
    }

    def values(i):
        n, chars, symbols, dup, repeats, _ = measured[i]
        return (
            1000 * symbols // max(n, 1), 1000 * repeats // max(n, 1),
            1000 * dup // max(lines[i], 1), 100 * chars // max(n, 1),
        )

    def start(v):
        shift = max(v.bit_length() - 6, 0)
        return v >> shift << shift

    passed = [r for r in rows if not measured[r[0]][5]]
    out = []
    limits = []
    for k, spread in enumerate((50, 50, 50, 100)):
        ordered = sorted(start(values(r[0])[k]) for r in passed)
        a, b = (ordered[-(-len(ordered) * q // 100) - 1] for q in (25, 75))
        reach = 3 * max(b - a, spread)
        limits.append((a - reach if k == 3 else -1, b + reach))
    for r in passed:
        if all(low <= v <= high for v, (low, high) in zip(values(r[0]), limits)):
            out.append(r)
    return out


def test_every_stage_equals_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "near dedup", "mixing", "encoding"]

    def run(name, rows):
        got = stages[name](spark, spark.createDataFrame(rows, SCHEMA), "")
        if name != "encoding":
            assert got.columns == docs.columns
        return [tuple(r) for r in got.collect()]

    want = fences(rows)
    assert sorted(run("quality rules", rows)) == sorted(want)
    assert 60 < len(want) < len(rows) - 5

    kept = {r[1] for r in test_exact_dedup.brute_force([r[:2] for r in want])}
    exact = [r for r in want if r[0] in kept]
    assert sorted(run("exact dedup", want)) == sorted(exact) and len(exact) < len(want)

    near = test_minhash_dedup.brute_force([r[:2] for r in exact], 5, 80)
    kept = {doc_id for doc_id, _, component, _ in near if doc_id == component}
    single = [r for r in exact if r[0] in kept]
    assert sorted(run("near dedup", exact)) == sorted(single) and len(single) < len(exact)

    plan = test_mixing.brute_force([(r[0], r[1], r[3]) for r in single])
    copies = {p[0]: p[4] // p[1] for p in plan if p[1]}
    mixed = run("mixing", single)
    assert sorted(mixed, key=str) == sorted(
        (r for r in single for _ in range(copies.get(r[0], 0))), key=str
    )

    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    encoded = run("encoding", mixed)
    assert sorted(r[0] for r in encoded) == sorted(r[0] for r in mixed)
    texts = {r[0]: r[1] for r in mixed}
    for doc_id, n_tokens, ids, starts, ends in encoded:
        assert ids == library.encode(texts[doc_id], add_eos=True) and n_tokens == len(ids)
        assert len(starts) == len(ends) == n_tokens


def test_run_applies_all_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "starts", "ends"]
    assert 30 < got.count() < 120


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_odd_rows(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
    odd = [(1, None, None, None, None)] * 2 + [(None, "a b", "en", "s", 3)] * 2
    odd += [(7, "long text " * 20_000, "en", "s", 1)]
    docs = spark.createDataFrame(
        [(*r, "x", True) for r in odd], SCHEMA + ", group_size string, kept boolean"
    )
    got = stage(spark, docs, "")
    got.collect()
    if name != "encoding":
        assert got.columns == docs.columns
