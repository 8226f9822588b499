"""MinHash signatures of character n-gram sets (Broder 1997).

The hash family is small integer arithmetic, so an SQL engine can reproduce it:

* gram    polynomial of the code points in base `BASE` modulo `PRIME`
* mixing  fifth power modulo `PRIME`; a bijection, as 5 is coprime to PRIME - 1
* lane j  (a_j * mixed + b_j) modulo 2^32, with a_j odd; the signature is its minimum
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.text import in_slices

PRIME = 2**31 - 1
BASE = 1_000_003
SET_BASE = 0x9E3779B97F4A7C15  # odd 64-bit base for gram_set
_BLOCK = 1024


def lanes(num_perm: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """Multipliers and offsets, taken from md5 of the lane number."""

    def word(name: str, lane: int) -> int:
        return int(hashlib.md5(f"{name}{seed}:{lane}".encode()).hexdigest()[:8], 16)

    return (
        [word("a", j) // 2 * 2 + 1 for j in range(num_perm)],
        [word("b", j) for j in range(num_perm)],
    )


def minhash_signature(
    text: Column | str, num_perm: int = 128, n: int = 5, seed: int = 1
) -> Column:
    """`array<bigint>` of num_perm minima over the whole text's n-grams."""
    multipliers, offsets = (
        np.array(values, dtype=np.uint32)[:, None] for values in lanes(num_perm, seed)
    )

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(texts: pa.Array) -> pa.Array:
        rows = np.empty((len(texts), num_perm), dtype=np.int64)
        values = chain.from_iterable(part.to_pylist() for part in in_slices(texts))
        for i, value in enumerate(values):
            rows[i] = _signature(value or "", n, multipliers, offsets)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * num_perm
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return signature.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def gram_set(text: Column | str, n: int) -> Column:
    """Distinct n-grams as 64-bit hashes; a text without grams is its own gram."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pa.Array) -> pa.Array:
        values = chain.from_iterable(part.to_pylist() for part in in_slices(texts))
        sets = [gram_codes(value or "", n) for value in values]
        ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))
        )

    return hashes.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def gram_codes(text: str, n: int) -> np.ndarray:
    """The sorted set that `gram_set` makes of one text, as unsigned numbers."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    width = min(n, len(points))
    count = len(points) - width + 1
    value = np.full(count, width, dtype=np.uint64)
    for j in range(width):
        value = value * np.uint64(SET_BASE) + points[j : j + count] + np.uint64(1)
    return np.unique(value)


def _gram_hashes(text: str, n: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if len(points) == 0:
        return np.zeros(1, dtype=np.uint32)
    width = min(n, len(points))
    count = len(points) - width + 1
    prime = np.uint64(PRIME)
    value = points[:count]
    for j in range(1, width):
        value = (value * np.uint64(BASE) + points[j : j + count]) % prime
    square = value * value % prime
    return (square * square % prime * value % prime).astype(np.uint32)


def _signature(text: str, n: int, multipliers, offsets) -> np.ndarray:
    grams = _gram_hashes(text, n)
    best = None
    for start in range(0, len(grams), _BLOCK):
        block = grams[None, start : start + _BLOCK]
        low = (multipliers * block + offsets).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best
