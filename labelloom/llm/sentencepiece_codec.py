"""SentencePiece encoding with the source bytes of every piece, and decoding.

Normalisation walks the text with the model's compiled character map, a double-array trie:
the longest prefix found is replaced by its normal form, and every byte of the result
records where its source began and ended. The dummy prefix and the escaped blanks are
added, the library splits the result into pieces, and the running byte lengths of the
pieces project each one to a span of the original UTF-8 text. A model with an empty map
(identity) takes the same path with the identical text, without the walk.

A model none of whose pieces goes from another character to a blank never merges across
such a border, so a text falls into blank-led segments that encode alike wherever they
stand. Segments are encoded once each and looked up from then on, in a table of at most
about `CACHE_BYTES`; texts of more than `PIECE_BYTES` are cut between segments, so that a
very long one needs little more than its ids and spans. Other models encode texts in one
piece.

Defined cases: a null text is the empty one, which has the end id only; repeated ids and
rows are encoded row by row; null ids stay null; an empty table gives an empty one;
only the id and the text are read. The model must have byte fallback, so that the pieces
spell out every byte, and must not squeeze blanks.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from labelloom.llm.common import in_small_batches

BLANK = "▁"
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
# A blank that begins a segment: neither a blank nor a blank sign stands before it.
_BORDER = re.compile(rb"(?<!\x20)(?<!\xe2\x96\x81)\x20")
# Bytes of remembered segments in a worker, as Python holds them, before it starts anew.
CACHE_BYTES = 48 << 20
# Normalised bytes that are cut into segments at once.
PIECE_BYTES = 1 << 20
# Bytes of a dictionary's slot and number beside the string itself.
_SLOT = 136


class CharacterMap:
    """The compiled map: a double array over bytes and zero-ended normal forms."""

    def __init__(self, blob: bytes):
        self._units: list[int] = []
        self._forms = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self._units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self._forms = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix in the map at `start`, and its normal form.

        A unit holds a label in its low 8 bits, an offset from bit 10 on, which bit 9
        scales by 256, and in bit 8 whether a value hangs on it.
        """
        units, found = self._units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = units[node] & 0x7FFFFFFF
                found = at + 1 - start, value
        if found is None:
            return None
        end = self._forms.index(b"\0", found[1])
        return found[0], self._forms[found[1] : end]

    def normalize(self, data: bytes, spans: bool = True):
        """Normal form, and for each of its bytes the start and end of its source."""
        if not self:
            if not spans:
                return data, None, None
            at = np.arange(len(data) + 1, dtype=np.int32)
            return data, at[:-1], at[1:]
        out, starts, ends = [], [], []
        at = 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                first = data[at]
                width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                form = data[at : at + width]
                # Each byte of an untouched character is its own source.
                starts.append(np.arange(at, at + len(form)))
                ends.append(np.arange(at + 1, at + len(form) + 1))
            else:
                width, form = hit
                starts.append(np.full(len(form), at))
                ends.append(np.full(len(form), at + width))
            out.append(form)
            at += width
        if not out:
            return b"", np.zeros(0, np.int32), np.zeros(0, np.int32)
        return (
            b"".join(out),
            np.concatenate(starts).astype(np.int32),
            np.concatenate(ends).astype(np.int32),
        )


class _Ids:
    """Ids of numbered segments, in one array that doubles when it is full."""

    def __init__(self) -> None:
        self._ids = np.zeros(1 << 16, dtype=np.int32)
        self._starts = np.zeros(1 << 14, dtype=np.int64)
        self._known = 0

    @property
    def nbytes(self) -> int:
        return self._ids.nbytes + self._starts.nbytes

    def add(self, split: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        first, known = int(self._starts[self._known]), self._known
        ends = first + np.cumsum(lengths)
        last = int(ends[-1]) if len(ends) else first
        self._ids = self._fitting(self._ids, last, first)
        self._starts = self._fitting(self._starts, known + len(split) + 1, known + 1)
        self._ids[first:last] = np.fromiter(chain.from_iterable(split), np.int32, last - first)
        self._starts[known + 1 : known + 1 + len(split)] = ends
        self._known += len(split)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        first = self._starts[numbers]
        lengths = self._starts[numbers + 1] - first
        before = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(before, lengths)
        return self._ids[np.repeat(first, lengths) + within]

    @staticmethod
    def _fitting(held: np.ndarray, needed: int, used: int) -> np.ndarray:
        if needed <= len(held):
            return held
        larger = np.zeros(max(needed, 2 * len(held)), dtype=held.dtype)
        larger[:used] = held[:used]
        return larger


class Codec:
    """One worker's model: encoding, with spans if wanted, and decoding.

    The library's two processors are made when they are first needed: one splits text in
    normal form, the other decodes.
    """

    def __init__(self, model: bytes):
        proto = model_pb2.ModelProto.FromString(model)
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if spec.remove_extra_whitespaces or not trained.byte_fallback:
            raise ValueError("needs a model with byte fallback that keeps all blanks")
        self._model = model
        self.map = CharacterMap(spec.precompiled_charsmap)
        self._prefix = spec.add_dummy_prefix
        self.end_id = trained.eos_id
        byte = model_pb2.ModelProto.SentencePiece.BYTE
        self._lengths = np.array(
            [1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces]
        )
        self._by_segment = not any(
            BLANK in p.piece.lstrip(BLANK) for p in proto.pieces
        )
        self._forget()

    @functools.cached_property
    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self._model)

    @functools.cached_property
    def _splitter(self) -> sentencepiece.SentencePieceProcessor:
        """Segments are in normal form already: this copy only splits them."""
        proto = model_pb2.ModelProto.FromString(self._model)
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id last, and each piece's span in the text's UTF-8 bytes.

        The end id has an empty span at the end.
        """
        return self.encode_many([text], spans=True)[0]

    def encode_many(self, texts: list[str], *, spans: bool) -> list[tuple[np.ndarray, ...]]:
        """The ids of each text, and with `spans` the starts and ends of their sources.

        Segments not met before are split in one call for a group of pieces.
        """
        rows: list[list] = [[] for _ in texts]
        waiting, size = [], 0
        for row, text in enumerate(texts):
            for piece in self._pieces(text.encode(), spans):
                waiting.append((row, *piece))
                size += len(piece[0])
                if size >= PIECE_BYTES:
                    self._settle(waiting, rows)
                    waiting, size = [], 0
        self._settle(waiting, rows)
        return [self._ended(parts, text, spans) for parts, text in zip(rows, texts)]

    def _pieces(self, data: bytes, spans: bool):
        """(normal bytes, starts, ends, is it the first) of a text, cut between segments."""
        if not data:
            return
        normal, starts, ends = self.map.normalize(data, spans)
        at = 0
        while at < len(normal) or not at:
            end = len(normal)
            if self._by_segment and end - at > PIECE_BYTES:
                border = _BORDER.search(normal, at + PIECE_BYTES)
                end = border.start() if border else end
            part = slice(at, end)
            sources = (starts[part], ends[part]) if spans else (None, None)
            yield normal[part], *sources, not at
            if not normal:
                return
            at = end

    def _settle(self, waiting: list, rows: list[list]) -> None:
        """Encode the waiting pieces into the rows they belong to."""
        segmented = [self._segments(piece[1], piece[4]) for piece in waiting]
        self._learn({s for segments in segmented for s in segments})
        for (row, normal, starts, ends, first), segments in zip(waiting, segmented):
            numbers = np.fromiter(
                map(self._numbers.__getitem__, segments), np.int64, len(segments)
            )
            ids = self._ids.of(numbers)
            if starts is None:
                rows[row].append((ids,))
            else:
                rows[row].append((ids, *self._project(ids, normal, starts, ends, first)))

    def _ended(self, parts: list[tuple], text: str, spans: bool) -> tuple[np.ndarray, ...]:
        """A row's pieces joined, and the end id with an empty span behind them."""
        last = [np.array([self.end_id], np.int32)]
        if spans:
            end = np.array([len(text.encode())], dtype=np.int32)
            last += [end, end]
        return tuple(
            np.concatenate([*(part[k] for part in parts), tail]) for k, tail in enumerate(last)
        )

    def _segments(self, normal: bytes, first: bool) -> list[str]:
        escaped = normal.decode().replace(" ", BLANK)
        if self._prefix and first:
            escaped = BLANK + escaped
        return _SEGMENT.findall(escaped) if self._by_segment else [escaped]

    def _learn(self, segments: set[str]) -> None:
        """Have the ids of at least these segments in the table."""
        if self._held + self._ids.nbytes >= CACHE_BYTES:
            self._forget()
        missing = [s for s in segments if s not in self._numbers]
        self._ids.add(
            self._splitter.encode([s.replace(BLANK, " ") for s in missing], num_threads=1)
        )
        known = len(self._numbers)
        self._numbers.update(zip(missing, range(known, known + len(missing))))
        self._held += sum(map(sys.getsizeof, missing)) + _SLOT * len(missing)

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._ids = _Ids()
        self._held = 0

    def _project(self, ids, normal: bytes, starts, ends, first_piece: bool):
        """Piece borders in escaped bytes, taken back to blanks, then to the source.

        Escaping makes a blank three bytes long, and so it does to a blank sign that was
        in the text: borders inside such bytes belong to the character they are part of.
        """
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        points = np.frombuffer(normal, dtype=np.uint8)
        widths = np.where(points == 0x20, 3, 1)
        if self._prefix and first_piece:
            # The dummy prefix stands for no byte: an empty source before the first one.
            widths = np.concatenate([[3], widths])
            first = starts[:1] if len(starts) else np.zeros(1, np.int32)
            starts = np.concatenate([first, starts])
            ends = np.concatenate([first, ends])
        source = np.repeat(np.arange(len(widths), dtype=np.int32), widths)
        borders = np.cumsum(self._lengths[ids])
        first = source[np.concatenate([[0], borders[:-1]])]
        last = source[borders - 1]
        return starts[first].astype(np.int32), ends[last].astype(np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The process's codec of a model, kept between tasks."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode_documents(
    docs: DataFrame,
    model: bytes,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    spans: bool = True,
    decoded: bool = False,
) -> DataFrame:
    """doc_id and ids (end id last), in one Python stage.

    With `spans` the starts and ends of their source bytes follow, with `decoded` the text
    that the ids give back.
    """
    schema = "doc_id bigint, ids array<int>"
    schema += ", starts array<int>, ends array<int>" if spans else ""
    schema += ", decoded string" if decoded else ""
    names = [field.split()[0] for field in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = own.encode_many(texts, spans=spans)
                columns = [_lists([r[k] for r in rows]) for k in range(3 if spans else 1)]
                if decoded:
                    texts = own.decode([row[0].tolist() for row in rows])
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, and the decoded text of stored ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                texts = own.decode([ids or [] for ids in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "text"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        decode, "doc_id bigint, ids array<int>, text string"
    )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
