"""Sources that bring differently shaped tables into one schema, and sinks."""

from labelloom.sources.loaders import (
    LABELLED_SCHEMA,
    LoadResult,
    constant_source,
    empty_labelled,
    filtered_source,
    label_mapped_source,
    load_all,
    resolve_column,
    taxonomy_source,
)
from labelloom.sources.sinks import (
    build_once,
    is_built,
    read_table,
    write_document,
    write_table,
)

__all__ = [
    "LABELLED_SCHEMA",
    "LoadResult",
    "build_once",
    "constant_source",
    "empty_labelled",
    "filtered_source",
    "is_built",
    "label_mapped_source",
    "load_all",
    "read_table",
    "resolve_column",
    "taxonomy_source",
    "write_document",
    "write_table",
]
