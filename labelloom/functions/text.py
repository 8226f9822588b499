"""Text expressions: JVM-side where Spark has them, Arrow batches where it does not."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Which subtype survives when the same text occurs more than once.
SUBTYPE_PRIORITY = {"harmful": 0, "jailbreak": 1, "safe": 2}
OTHER_PRIORITY = 3

# Fixed value: the characters that Unicode calls white space, and the separators 1c to 1f.
WHITE_SPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Bytes of texts that are Python objects at one time.
SLICE_BYTES = 1 << 20

# The Arrow UDFs below are marked non-deterministic so that a filter on their result is
# not pushed below the projection, which would run them once per use.


def in_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about SLICE_BYTES; a longer one is a slice of its own.

    A batch has up to 10000 texts, whatever their length: as Python objects, with what is
    made of them, they would take several times the batch.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, before = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _per_text(result_type: T.DataType, function: Callable[[str], object]):
    arrow_type = to_arrow_type(result_type)

    @F.arrow_udf(result_type)
    def apply(texts: pa.Array) -> pa.Array:
        parts = [
            pa.array([None if t is None else function(t) for t in part.to_pylist()], arrow_type)
            for part in in_slices(texts)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)

    return apply.asNondeterministic()


def normalize_text(text: Column | str) -> Column:
    """NFKC, lower case, every whitespace run to one space, ends trimmed.

    Spark has no Unicode normalisation. As the text has to cross to Python for it, the
    other steps are done there too: measured three times faster than a JVM pattern.
    """

    def normalize(value: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", value).lower().split())

    return _per_text(T.StringType(), normalize)(_col(text))


def _words(text: Column | str) -> Column:
    """Cut at single blanks, which needs no pattern, after all white space became blanks."""
    blanked = F.translate(_col(text), WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.array_remove(F.split(blanked, " "), "")


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    return F.when(_col(text).isNotNull(), F.size(_words(text)))


def head_tokens(text: Column | str, n: int = 512) -> Column:
    """The first n whitespace-separated words, joined by single spaces."""
    return F.array_join(F.slice(_words(text), 1, n), " ")


def char_ngrams(text: Column | str, n: int) -> Column:
    """Character n-grams by code point, stride 1; empty for a text shorter than n."""
    # One walk over the text: every match takes one character and looks n ahead.
    grams = F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.coalesce(grams, F.array().cast("array<string>"))


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Exact Jaccard similarity of two arrays without duplicates."""
    left, right = _col(left), _col(right)
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def char_length(text: Column | str) -> Column:
    return F.length(_col(text))


def preview(text: Column | str, n: int = 200) -> Column:
    return F.substring(_col(text), 1, n)


def length_between(
    text_norm: Column | str, min_len: int = 5, max_len: int = 20000
) -> Column:
    """Inclusive length test; belongs on normalised text, whose length may differ."""
    return F.length(_col(text_norm)).between(min_len, max_len)


def subtype_priority(
    subtype: Column | str,
    priorities: Mapping[str, int] = SUBTYPE_PRIORITY,
    default: int = OTHER_PRIORITY,
) -> Column:
    """Smaller is stronger; a subtype that is not listed gets the default."""
    subtype = _col(subtype)
    result = F.lit(default)
    for name, value in priorities.items():
        result = F.when(subtype == name, F.lit(value)).otherwise(result)
    return result


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
