import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import fill_middle
from labelloom.llm.fill_middle import PieceTable, Transformer

SCHEMA = "doc_id bigint, text string, output string, n string"


def by_hand(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix, middle, output) straight from the definition."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, s, m = marks
    if h4 % 100 < spm:
        return len(lines), "spm", prefix, middle, s + suffix + p + prefix + m + middle
    return len(lines), "psm", prefix, middle, p + prefix + s + suffix + m + middle


def check(row, doc_id, text, **settings):
    n, form, prefix, middle, output = by_hand(doc_id, text, **settings)
    size = [None if x is None else len(x) for x in (prefix, middle)]
    assert (row["n"], row["form"], row["output"]) == (n, form, output)
    assert [row["prefix_chars"], row["middle_chars"]] == size
    assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(
    st.integers(-(2**63), 2**63 - 1) | st.none(),
    st.text(st.sampled_from("a<>PSM\n\r é\U0001f600 "), max_size=40),
)
def test_cutting_and_restoring_equal_the_definition(doc_id, text):
    transformer = Transformer()
    row = transformer.split(doc_id, text.encode())
    assert transformer.restore(row["output"], row["form"]).decode() == text
    row["output"] = row["output"].decode()
    check(row, doc_id, text)


def test_pieces_spell_out_the_output():
    data = "eins\nzwei\nçdrei".encode()
    for doc_id in range(50):
        row = Transformer().split(doc_id, data)
        pieces = [(p["buffer"], p["start"], p["length"]) for p in row["pieces"]]
        assert PieceTable([data, b"<P><S><M>"], pieces).content() == row["output"]


def test_a_piece_table_leaves_its_buffers_alone():
    table = PieceTable([b"abcdef"], [(0, 0, 6)])
    table.cut(0, 2, 2)
    assert table.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4)]
    table.permute((2, 0, 1))
    assert table.content() == b"cdefab"
    assert table.digest() == hashlib.sha256(b"cdefab").hexdigest()
    table.permute(fill_middle.inverse((2, 0, 1)))
    assert table.content() == b"abcdef"


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    long = "x" * 3_000_000 + "\n" + "une ligne\n" * 200_000
    rows = [
        (1, "a\nb\nc\n", "other", "z"),
        (1, "a\nb\nc\n", "other", "z"),
        (1, "a different text\nunder one id", None, None),
        (2, None, "o", "n"),
        (3, "", "o", "n"),
        (None, "no id\nhere\n", "o", "n"),
        (4, "\n\n\n", "o", "n"),
        (5, "holds <M> already\nx", "o", "n"),
        (6, long, "o", "n"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()
    want = sorted(((d, t or "") for d, t, _, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=repr) == want
    for row in got:
        check(row.asDict(), row["doc_id"], row["restored"])
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_settings(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'a\nb\nc\nd' AS text")
    own = {"seed": 11, "rate": 40, "spm_share": 90, "sentinels": ("[pre]", "[suf]", "[mid]")}
    made = fill_middle.fill_in_middle(docs, **own)
    rows = fill_middle.restore(made, sentinels=own["sentinels"]).collect()
    assert {r["restored"] for r in rows} == {"a\nb\nc\nd"}
    for row in rows:
        check(
            row.asDict(), row["doc_id"], "a\nb\nc\nd",
            seed=11, rate=40, spm=90, marks=own["sentinels"],
        )
    assert 80 < sum(r["form"] != "plain" for r in rows) < 160


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "d")])
def test_sentinels_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        Transformer(sentinels=marks)


def test_both_stages_are_narrow(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'a\nb' AS text")
    plan = fill_middle.restore(fill_middle.fill_in_middle(docs))
    assert "Exchange" not in plan._jdf.queryExecution().toString()
