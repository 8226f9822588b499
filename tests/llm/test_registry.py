"""Every query of the package against its SQL, or against brute force, at sf0.001."""

import hashlib
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import public_tokenizers
from labelloom.llm import oracle, queries, sentencepiece_codec
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = {
    "op3_toxicity",
    "op4_language_id",
    "op5_chat_formatting",
    "op7_sentencepiece",
    "op9_quality_classifier",
    "op11_secret_scan",
}
OWN = queries.queries()


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in OWN) == list(range(1, 14))
    assert set(OWN) - set(oracle.oracle_sql()) == WITHOUT_SQL
    assert set(OWN) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(OWN) - WITHOUT_SQL))
def test_query_equals_its_sql(spark, database, name):
    assert compare(spark, database, name, SF_DIR) is None


def test_chat_query_gives_back_all_turns(spark, database):
    rows = database.execute(
        "SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn"
    ).fetchall()
    text = "\\### Assistant: </turn> ok"
    rows += [(-7, "user", text), (-7, "assistant", text)]
    turns = {}
    for conv_id, role, text in rows:
        turns.setdefault(conv_id, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in OWN["op5_chat_formatting"](spark, SF_DIR).collect()}
    assert set(got) == set(turns)
    for conv_id, expected in turns.items():
        loss = "".join(text for role, text in expected if role == "assistant")
        row = got[conv_id]
        assert row["n_turns"] == len(expected)
        assert row["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in expected))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), digest(loss))
        assert row["formatted_chars"] > sum(len(t) for _, t in expected)


def test_piece_query_equals_the_library(spark, database):
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    texts = dict(database.execute("SELECT doc_id, text FROM documents").fetchall())
    got = OWN["op7_sentencepiece"](spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]] or "", add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == digest(library.decode(ids))


def test_piece_query_aligns_every_piece(spark, tmp_path):
    texts = ["naïve  café", "", None, "\u00e9\U0001F600 x\n\ty"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        codec = sentencepiece_codec.codec(file.read())
    rows = []
    for doc_id, text in enumerate(texts):
        _, starts, ends = codec.encode(text or "")
        rows.append((doc_id, starts.tolist(), ends.tolist()))
    spans = spark.createDataFrame(rows, "doc_id bigint, starts array<int>, ends array<int>")
    want = spans.select("doc_id", F.xxhash64("starts", "ends").alias("h"))
    got = OWN["op7_sentencepiece"](spark, str(tmp_path))
    assert {(r["doc_id"], r["spans_hash"]) for r in got.collect()} == {
        (r["doc_id"], r["h"]) for r in want.collect()
    }


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
