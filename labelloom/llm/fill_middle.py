"""Fill-in-the-middle documents by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its
own UTF-8 bytes and the three sentinels. Two cuts at line borders split its one descriptor
into prefix, middle and suffix; a form is a permutation of these and the sentinels:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

Text is copied once, when the output is written; digests stream through the descriptors.
`restore` makes descriptors over an output, cut at its sentinels, and applies the inverse
permutation. Where the cuts fall and which form is taken follows from sha256 of the seed and
the id, so reruns agree whatever the partitions.

Both stages are narrow, without a shuffle. Only the id and the text are read. Defined cases:
a null text is the empty one; empty texts and texts that hold a sentinel stay plain; a null
id counts as the empty string in the hash; rows of one id are cut by the same numbers, each
in its own text; equal rows give equal rows; a text without line ends is one line; a very
long text takes its own size in a task and no more descriptors than a short one; bytes that
are not UTF-8 are carried along; an empty table gives an empty one; other columns of
whatever name are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelloom.llm.common import in_small_batches

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100
SPM_SHARE = 50

TEXT, MARK = 0, 1
# Order of (P, S, M, prefix, middle, suffix) in the output.
ORDERS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}
_PIECES = pa.list_(
    pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
)
_SCHEMA = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "pieces array<struct<buffer: int, start: bigint, length: bigint>>, "
    "output string, output_sha256 string"
)

Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over immutable buffers; every change makes new descriptors only."""

    def __init__(self, buffers: Sequence[bytes], pieces: Sequence[Piece]):
        self._views = [memoryview(b) for b in buffers]
        self.pieces = list(pieces)

    def cut(self, index: int, *offsets: int) -> None:
        """Split one descriptor at ascending offsets from its start; empty parts stay."""
        buffer, start, length = self.pieces[index]
        borders = [0, *offsets, length]
        self.pieces[index : index + 1] = [
            (buffer, start + a, b - a) for a, b in zip(borders, borders[1:])
        ]

    def permute(self, order: Sequence[int]) -> None:
        self.pieces = [self.pieces[k] for k in order]

    def parts(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self._views[buffer][start : start + length]

    def content(self) -> bytes:
        return b"".join(self.parts())

    def digest(self) -> str:
        """sha256 of the content, without building it."""
        state = hashlib.sha256()
        for part in self.parts():
            state.update(part)
        return state.hexdigest()


def inverse(order: Sequence[int]) -> list[int]:
    return [int(k) for k in np.argsort(order)]


def draw(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return tuple(
        int(x) for x in np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], ">u4")
    )


def line_ends(data: bytes) -> np.ndarray:
    """Ends of the lines; the last line may lack its line end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    return ends


def code_points(part: memoryview) -> int:
    """Bytes that do not continue a character."""
    return int(np.count_nonzero(np.frombuffer(part, np.int8) >= -64))


class Transformer:
    """Cuts and arranges one document after the other."""

    def __init__(
        self,
        seed: int = SEED,
        rate: int = RATE,
        spm_share: int = SPM_SHARE,
        sentinels: Sequence[str] = SENTINELS,
    ):
        self._seed, self._rate, self._spm = seed, rate, spm_share
        self._marks = [mark.encode() for mark in sentinels]
        if len(set(self._marks)) != 3 or not all(self._marks):
            raise ValueError("three different sentinels are needed")
        # A sentinel that begins as another ends could be found across a border.
        for a in self._marks:
            for b in self._marks:
                if any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))):
                    raise ValueError(f"sentinels overlap: {a!r}, {b!r}")
        self._mark_buffer = b"".join(self._marks)
        starts = np.cumsum([0, *map(len, self._marks)])
        self._mark_pieces = [(MARK, int(s), len(m)) for s, m in zip(starts, self._marks)]

    def split(self, doc_id: int | None, data: bytes) -> dict:
        """The row of one document, without its id."""
        ends = line_ends(data)
        n = len(ends)
        h1, h2, h3, h4 = draw(self._seed, doc_id)
        table = PieceTable([data, self._mark_buffer], [(TEXT, 0, len(data))])
        row = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
        if data and h3 % 100 < self._rate and not any(m in data for m in self._marks):
            borders = np.concatenate([[0], ends])
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            table.cut(0, int(borders[low]), int(borders[high]))
            prefix, middle, _ = table.parts()
            row["prefix_chars"], row["middle_chars"] = map(code_points, (prefix, middle))
            row["form"] = "spm" if h4 % 100 < self._spm else "psm"
            table.pieces = self._mark_pieces + table.pieces
            table.permute(ORDERS[row["form"]])
        row["pieces"] = [
            {"buffer": b, "start": s, "length": length} for b, s, length in table.pieces
        ]
        row["output"], row["output_sha256"] = table.content(), table.digest()
        return row

    def restore(self, output: bytes, form: str) -> bytes:
        """The text of an output: descriptors by its sentinels, then the inverse order."""
        table = PieceTable([output], [(TEXT, 0, len(output))])
        if form == "plain":
            return table.content()
        order = ORDERS[form]
        borders, at = [], 0
        for k in order[::2]:
            at = output.index(self._marks[k], at)
            borders += [at, at + len(self._marks[k])]
        table.cut(0, *borders[1:])
        table.permute(inverse(order))
        table.pieces = table.pieces[3:]
        return table.content()


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """One row per document: lines, form, sizes, descriptors, output and its digest.

    `settings` are those of `Transformer`. The pieces refer to the text (buffer 0) and to
    the joined sentinels (buffer 1), in bytes.
    """
    transformer = Transformer(**settings)  # wrong settings fail here, not in a task

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                ids = part.column(0).to_pylist()
                made = [transformer.split(*x) for x in zip(ids, _texts(part.column(1)))]

                def column(name: str, kind: pa.DataType) -> pa.Array:
                    return pa.array([row[name] for row in made], kind)

                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        column("n", pa.int64()),
                        column("form", pa.string()),
                        column("prefix_chars", pa.int64()),
                        column("middle_chars", pa.int64()),
                        column("pieces", _PIECES),
                        _strings([row["output"] for row in made]),
                        column("output_sha256", pa.string()),
                    ],
                    names=[
                        "doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces",
                        "output", "output_sha256",
                    ],
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(rows, _SCHEMA)


def restore(transformed: DataFrame, **settings) -> DataFrame:
    """The given rows with `restored`, the text rebuilt from output and form alone.

    `settings` need only name the sentinels, if they are not the usual ones.
    """
    transformer = Transformer(**settings)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_small_batches(batch, batch.nbytes / max(1, batch.num_rows)):
                pairs = zip(_texts(part.column("output")), part.column("form").to_pylist())
                texts = [transformer.restore(output, form) for output, form in pairs]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _strings(texts)], names=[*part.schema.names, "restored"]
                )

    kept = transformed.drop("restored")
    schema = StructType([*kept.schema.fields, StructField("restored", StringType())])
    return kept.mapInArrow(rows, schema)
