"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its
turns meet the sorted spans of its tokens by binary search. Template, per turn:

    ### User: text</turn>\\n        ### Assistant: text</turn>\\n
    ### <other role>: text</turn>\\n

`### User: `, `### Assistant: `, `### System: `, `### ` and `</turn>\\n` are control strings, added to the
tokenizer as special tokens, so that no token crosses the border of a text. In texts and
roles every backslash is doubled, and one is put between two `#` and into `</turn>`, so
that no control string is left in them; taking each backslash off again restores them.
Roles also escape `:` and a name of the template.

Rows are dealt by conversation, sorted by turn and streamed, so a task holds one
conversation at a time.

Defined cases: a null text or role is empty; null turns come first, and turns that tie are
ordered by role and text; null conversation ids form one conversation; repeated rows are
turns of their own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm.common import BATCH_BYTES

TURN = "### "
ROLE_END = ": "
TURN_END = "</turn>\n"
LEARNED_ROLE = "assistant"
# Roles with a name of their own in the template.
NAMED = {"user": "User", "assistant": "Assistant", "system": "System"}
_NAMES = {name: role for role, name in NAMED.items()}
CONTROL = [f"{TURN}{name}{ROLE_END}" for name in NAMED.values()] + [TURN, TURN_END]

# A backslash goes before each match.
_ESCAPE = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_ESCAPE_ROLE = re.compile(_ESCAPE.pattern + r"|:|^(?=(?:User|Assistant|System)$)")
_UNESCAPE = re.compile(r"\\(.?)", re.S)
FORMATTED = (
    "conv_id bigint, n_turns bigint, formatted string, ids array<int>, "
    "starts array<int>, ends array<int>, loss_from array<int>, loss_to array<int>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of the texts that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name = NAMED.get(role)
        if name is None:
            name = _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role)
        head = f"{TURN}{name}{ROLE_END}"
        body = escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TURN_END]
        at += len(head) + len(body) + len(TURN_END)
    return "".join(parts), spans


_TURN = re.compile(
    r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S
)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that were rendered."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        name = found[1]
        turns.append((_NAMES.get(name, unescape(name)), unescape(found[2])))
        at = found.end()
    return turns


def mask_spans(
    starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray]:
    """For each token the part of it that is learned; from = to where there is none.

    Both sides are sorted: two binary searches give the turn that a token can meet.
    """
    if not spans:
        return starts.copy(), starts.copy()
    low = np.array([s for s, _ in spans])
    high = np.array([e for _, e in spans])
    # The last turn that begins before the token ends.
    turn = np.searchsorted(low, ends, side="left") - 1
    inside = turn >= 0
    turn = np.maximum(turn, 0)
    first = np.maximum(starts, low[turn])
    last = np.minimum(ends, high[turn])
    met = inside & (first < last)
    return np.where(met, first, starts), np.where(met, last, starts)


def learned_text(formatted: str, loss_from, loss_to) -> str:
    """All text under the mask, unescaped, each character once and in order.

    Tokens that share a character (its bytes are split) have the same span.
    """
    pieces, done = [], 0
    for first, last in zip(loss_from, loss_to):
        first = max(first, done)
        if first < last:
            pieces.append((first, last))
            done = last
    return unescape("".join(formatted[a:b] for a, b in pieces))


def tokenizer_from(definition: str) -> Tokenizer:
    """The tokenizer with the control strings as special tokens and untrimmed offsets."""
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens(CONTROL)
    return tokenizer


_TOKENIZERS: dict[str, Tokenizer] = {}


def _tokenizer(definition: str) -> Tokenizer:
    if definition not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[definition] = tokenizer_from(definition)
    return _TOKENIZERS[definition]


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: rendered text, ids with offsets, learned part of each.

    `tokenizer` is the JSON definition. Offsets count code points of `formatted`.
    """

    def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer)
        ready, size = [], 0
        for conv_id, rows in _conversations(batches):
            ready.append(_format(own, conv_id, rows))
            size += len(ready[-1][2]) * 8
            if size > BATCH_BYTES:
                yield _batch(ready)
                ready, size = [], 0
        if ready:
            yield _batch(ready)

    return (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(format_rows, FORMATTED)
    )


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conv_id, turns) of rows that are sorted by conversation."""
    current, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(
            batch.column(0).to_pylist(),
            batch.column(2).to_pylist(),
            batch.column(3).to_pylist(),
        ):
            if turns and conv_id != current:
                yield current, turns
                turns = []
            current = conv_id
            turns.append((role, text))
    if turns:
        yield current, turns


def _format(tokenizer: Tokenizer, conv_id, turns):
    formatted, spans = render(turns)
    encoding = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    loss_from, loss_to = mask_spans(starts, ends, spans)
    return conv_id, len(turns), formatted, encoding.ids, starts, ends, loss_from, loss_to


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows))
    numbers = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.int64()),
            pa.array(columns[2], pa.string()),
            *[pa.array([np.asarray(v, np.int32) for v in c], numbers) for c in columns[3:]],
        ],
        names=[c.split()[0] for c in FORMATTED.split(", ")],
    )
