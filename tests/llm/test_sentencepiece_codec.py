import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from labelloom.llm import sentencepiece_codec as codec

TEXTS = [
    "", " ", "   ", "a", " a  b ", "Hello,  world\n\tx", "ünï ▁ code 😀 漢字", "a▁b ▁▁c",
    "<s> </s> <unk> <0x41>", "\x00\x01 \u200b\ufeff", "e\u0301 \ufb01 \u2460", "x" * 3000,
    "１２３ ﾊﾝｶｸ Ａ", "\r\n\r\n", "​ zero",
]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def random_texts(n):
    rng = random.Random(2)
    parts = [" ", "  ", "a", "the", "ü", "漢", "😀", "\n", "▁", ".", "é", "\u0301", "ﬁ", "Ａ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = codec.Codec(model)
    for text in TEXTS + random_texts(800):
        ids, starts, ends = own.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert own.decode([ids.tolist()]) == [library.decode(ids.tolist())]


def test_spans_cover_the_source_without_gaps(model):
    own = codec.Codec(model)
    for text in TEXTS + random_texts(300):
        ids, starts, ends = own.encode(text)
        data = text.encode()
        assert starts[-1] == ends[-1] == len(data)
        seen = np.zeros(len(data), dtype=bool)
        for a, b in zip(starts, ends):
            seen[a:b] = True
        assert seen.all() and (np.diff(starts) >= 0).all()
        if "▁" not in text:
            pieces = [own.processor.id_to_piece(i) for i in ids.tolist()]
            for piece, a, b in zip(pieces[:-1], starts, ends):
                if not piece.startswith("<0x"):
                    got = data[a:b].decode().replace(" ", "▁")
                    assert got == piece or "▁" + got == piece


def with_map(model, blob):
    proto = model_pb2.ModelProto.FromString(model)
    proto.normalizer_spec.precompiled_charsmap = blob
    return proto.SerializeToString()


def compiled(rules):
    """A double array over the rules' bytes, built slot by slot, and its normal forms."""
    forms, values = b"", {}
    for source, target in rules.items():
        values[source.encode()] = len(forms)
        forms += target.encode() + b"\0"
    units = {0: 0}
    used = {0}

    def place(node, keys):
        labels = sorted({k[0] for k in keys if k} | ({0} if b"" in keys else set()))
        base = 1
        while any((base ^ label) in used for label in labels) or base in (node,):
            base += 1
        used.update(base ^ label for label in labels)
        units[node] |= (base ^ node) << 10
        for label in labels:
            if label == 0:
                units[node] |= 0x100
                continue
            units[base ^ label] = label
        for label in labels:
            if label:
                place(base ^ label, {k[1:]: v for k, v in keys.items() if k[:1] == bytes([label])})
            else:
                units[base] = 0x80000000 | keys[b""]

    place(0, values)
    size = (max(units) // 256 + 1) * 256
    array = [units.get(i, 0) for i in range(size)]
    blob = struct.pack(f"<{size}I", *array)
    return struct.pack("<I", len(blob)) + blob + forms


RULES = {"A": "a", "Ab": "XY", "é": "e", "e\u0301": "e", "ﬁ": "fi", "１": "1", "\u200b": "", "\t": " "}


def test_map_takes_the_longest_prefix(model):
    blob = compiled(RULES)
    own = codec.CharacterMap(blob)
    normal, starts, ends = own.normalize("AbAé".encode())
    assert normal == b"XYae"
    assert starts.tolist() == [0, 0, 2, 3] and ends.tolist() == [2, 2, 3, 5]


def test_a_compiled_map_equals_the_library(model):
    mapped = with_map(model, compiled(RULES))
    library = sentencepiece.SentencePieceProcessor(model_proto=mapped)
    own = codec.Codec(mapped)
    texts = ["Abc Aé", "ﬁne １\u200b2\tx", "e\u0301A", "\u200b", "Z Ab" * 50] + random_texts(300)
    for text in texts:
        ids, starts, ends = own.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert (starts <= ends).all() and ends.max() <= len(text.encode())


def test_models_without_byte_fallback_are_refused(model):
    proto = model_pb2.ModelProto.FromString(model)
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        codec.Codec(proto.SerializeToString())


def test_frames_with_nulls_repeats_and_clashing_columns(spark, model):
    df = spark.createDataFrame(
        [(1, "a b", [9]), (1, "a b", None), (2, None, []), (None, "c", None)],
        "doc_id bigint, text string, ids array<int>",
    )
    encoded = codec.encode_documents(df, model)
    rows = sorted(codec.decode_documents(encoded, model).collect(), key=str)
    assert [(r["doc_id"], r["text"]) for r in rows] == [
        (1, "a b"), (1, "a b"), (2, ""), (None, "c")
    ]
    assert rows[2]["ids"] == [2]


def test_empty_frame(spark, model):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert codec.decode_documents(codec.encode_documents(df, model), model).collect() == []


def test_known_segments_are_bounded(model, monkeypatch):
    own = codec.Codec(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    monkeypatch.setattr(codec, "CACHE_BYTES", own._ids.nbytes + 500)
    for text in ("one two three", "four five one two", "x" * 100 + " y", "two"):
        assert own.encode(text)[0].tolist() == library.encode(text, add_eos=True)
        assert len(own._numbers) <= 6


def test_long_texts_are_cut_between_segments(model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    whole = codec.Codec(model)
    cut = codec.Codec(model)
    texts = TEXTS + random_texts(300) + ["ab ▁ c  ▁▁ d" * 40, " ▁" * 50, "word " * 200]
    want = [whole.encode(text) for text in texts]
    monkeypatch.setattr(codec, "PIECE_BYTES", 7)
    for text, expected in zip(texts, want):
        got = cut.encode(text)
        assert got[0].tolist() == library.encode(text, add_eos=True), text
        for a, b in zip(got, expected):
            assert a.tolist() == b.tolist(), text


def test_a_very_long_text(spark, model):
    text = "un long texte, ünï 漢字 " * 300_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    encoded = codec.encode_documents(df, model, spans=False, decoded=True)
    assert encoded.columns == ["doc_id", "ids", "decoded"]
    row = encoded.where("doc_id = 1").first()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert row["ids"] == library.encode(text, add_eos=True)
    assert row["decoded"] == library.decode(row["ids"])


def test_numbered_ids_grow():
    ids = codec._Ids()
    rows = [[k] * (k % 5) for k in range(100_000)]
    for at in range(0, len(rows), 9_999):
        ids.add(rows[at : at + 9_999])
    ids.add([])
    picked = np.array([0, 99_999, 4, 4, 50_003])
    want = [x for k in picked for x in rows[k]]
    assert ids.of(picked).tolist() == want
