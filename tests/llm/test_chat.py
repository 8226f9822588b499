import random

import numpy as np
import public_tokenizers
import pytest

from labelloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["#", "##", "### ", "\\", "</turn>", "</turn>\n", "### Assistant: ", "a", "ü", "😀"]
PARTS += ["User", ":", " ok", "<", "\n", "### User: ", "\\n", "turn>"]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        return file.read()


def test_round_trip_and_mask_of_random_turns(definition):
    tokenizer = chat.tokenizer_from(definition)
    random.seed(1)
    roles = ["user", "assistant", "system", "User", "x: y", "", "###", "\\", "</turn>\n"]
    for _ in range(1500):
        turns = [
            (random.choice(roles), "".join(random.choices(PARTS, k=random.randint(0, 9))))
            for _ in range(random.randint(1, 4))
        ]
        row = chat._format(tokenizer, 1, turns)
        formatted, starts, ends, loss_from, loss_to = row[2], *row[4:]
        assert chat.parse(formatted) == turns
        want = "".join(text for role, text in turns if role == "assistant")
        assert chat.learned_text(formatted, loss_from, loss_to) == want
        # Control strings stand only where a turn begins or ends.
        assert formatted.count("</turn>\n") == len(turns)
        # A token is learned whole or not at all.
        met = loss_from < loss_to
        assert (loss_from[met] == starts[met]).all() and (loss_to[met] == ends[met]).all()
        assert all(a >= b for a, b in zip(starts[1:], starts))


def test_mask_clips_tokens_that_cross_a_border():
    first, last = chat.mask_spans(
        np.array([0, 2, 4, 9]), np.array([2, 4, 9, 12]), [(3, 5), (10, 11)]
    )
    assert [(a, b) for a, b in zip(first, last) if a < b] == [(3, 4), (4, 5), (10, 11)]


def formatted(spark, definition, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["conv_id"]: r for r in chat.format_conversations(df, definition).collect()}


def test_null_texts_roles_turns_and_ids(spark, definition):
    got = formatted(
        spark,
        definition,
        [
            (1, 1, "assistant", None), (1, 0, "user", "hi"), (1, None, None, "first"),
            (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"),
        ],
    )
    assert chat.parse(got[1]["formatted"]) == [("", "first"), ("user", "hi"), ("assistant", "")]
    assert got[None]["n_turns"] == 2
    assert [t for _, t in chat.parse(got[2]["formatted"])] == ["a", "a", "b"]
    assert chat.learned_text(got[None]["formatted"], got[None]["loss_from"], got[None]["loss_to"]) == "y"


def test_empty_table_and_long_text(spark, definition):
    assert formatted(spark, definition, []) == {}
    text = "long text ### " * 40_000
    row = formatted(spark, definition, [(1, 0, "assistant", text)])[1]
    assert chat.learned_text(row["formatted"], row["loss_from"], row["loss_to"]) == text


def test_other_columns_are_left_aside(spark, definition):
    df = spark.createDataFrame(
        [(1, 0, "user", "a", "z", [1])], SCHEMA + ", formatted string, ids array<int>"
    )
    assert chat.format_conversations(df, definition).count() == 1
