"""Column expressions: text, hashing and identity."""

from labelloom.functions.ids import hash_order, stratum_key, with_row_id
from labelloom.functions.minhash import minhash_signature
from labelloom.functions.text import (
    char_length,
    char_ngrams,
    head_tokens,
    length_between,
    normalize_text,
    preview,
    subtype_priority,
    word_count,
)

__all__ = [
    "char_length",
    "char_ngrams",
    "hash_order",
    "head_tokens",
    "length_between",
    "minhash_signature",
    "normalize_text",
    "preview",
    "stratum_key",
    "subtype_priority",
    "with_row_id",
    "word_count",
]
