"""Differently shaped source tables to (prompt, y, source, subtype [, row_id])."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.ids import with_row_id
from labelloom.session import materialize

LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("subtype", T.StringType()),
    ]
)


def resolve_column(df: DataFrame, candidates: Sequence[str], what: str = "text") -> str:
    """The first candidate the table has, or an error naming what it does have."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(
        f"no {what} column among {list(candidates)}; the table has {df.columns}"
    )


def constant_source(
    df: DataFrame,
    *,
    y: int,
    source: str | Column,
    subtype: str,
    candidates: Sequence[str] = ("prompt",),
    row_id: str | Column | None = None,
) -> DataFrame:
    """Every row with text gets the same label and subtype."""
    text = F.col(resolve_column(df, candidates))
    return _labelled(
        df, _text(text, "drop"), F.lit(y), source, F.lit(subtype), row_id
    )


def label_mapped_source(
    df: DataFrame,
    *,
    source: str | Column,
    text: str = "prompt",
    label: str = "type",
    safe_label: str = "benign",
    null_policy: str = "drop",
    row_id: str | Column | None = None,
) -> DataFrame:
    """`safe_label` in any case is y=0; every other label, null included, is y=1."""
    is_safe = F.lower(F.coalesce(F.col(label).cast("string"), F.lit(""))) == safe_label
    return _labelled(
        df,
        _text(F.col(text), null_policy),
        F.when(is_safe, 0).otherwise(1),
        source,
        F.when(is_safe, "safe").otherwise("jailbreak"),
        row_id,
    )


def filtered_source(
    df: DataFrame,
    *,
    source: str | Column,
    y: int = 1,
    subtype: str = "jailbreak",
    column: str = "format",
    value: str = "text",
    candidates: Sequence[str] = ("redteam_query", "jailbreak_query", "prompt"),
    row_id: str | Column | None = None,
) -> DataFrame:
    """Rows whose `column` is `value` in any case; text is the first non-empty one."""
    if column not in df.columns:
        return _labelled(
            df.where(F.lit(False)), F.lit(None), F.lit(y), source, F.lit(subtype), row_id
        )
    present = [c for c in candidates if c in df.columns]
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in present]
    text = F.coalesce(*texts) if texts else F.lit(None)
    kept = df.where(F.lower(F.col(column).cast("string")) == value)
    return _labelled(kept, text, F.lit(y), source, F.lit(subtype), row_id)


def taxonomy_source(
    df: DataFrame,
    *,
    source: str | Column,
    y: int = 1,
    candidates: Sequence[str] = ("prompt", "question", "instruction"),
    taxonomy: Sequence[str] = ("category", "domain", "task"),
    default_subtype: str = "harmful",
    null_policy: str = "drop",
    row_id: str | Column | None = None,
) -> DataFrame:
    """The subtype is the row's own category when the table has such a column."""
    text = _text(F.col(resolve_column(df, candidates)), null_policy)
    found = [c for c in taxonomy if c in df.columns]
    subtype = (
        F.coalesce(F.col(found[0]).cast("string"), F.lit("None"))
        if found
        else F.lit(default_subtype)
    )
    return _labelled(df, text, F.lit(y), source, subtype, row_id)


@dataclass(frozen=True)
class LoadResult:
    table: DataFrame
    status: DataFrame

    def counts(self) -> DataFrame:
        """Rows per source, one pass over all sources together."""
        return self.table.groupBy("source").agg(F.count("*").alias("n"))


def load_all(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], DataFrame]],
    *,
    staged: bool = False,
) -> LoadResult:
    """Union of the sources that can be resolved; the others are reported.

    A source fails here when its table or a needed column is missing, or when it does
    not have the columns and types of the union: those of a labelled table and, if any
    source names row ids, a string `row_id`, which the others then get from content.

    An error while rows are read fails the job that reads them, unless `staged` is set: then
    every source is read here and written to the shared folder on its own, and one that
    breaks off is reported and left out whole. What was written of it is never read.
    """
    frames, status = [], []
    for name, load in sources.items():
        try:
            frame = load()
            _check_columns(frame)
            if staged:
                frame = materialize(frame, f"source-{len(status)}")
        except (PySparkException, Py4JError, ValueError, OSError, RuntimeError) as error:
            status.append((name, "failed", str(error).split("\n")[0]))
        else:
            frames.append(frame)
            status.append((name, "loaded", None))
    if any("row_id" in frame.columns for frame in frames):
        frames = [with_row_id(frame) for frame in frames]
    table = (
        functools.reduce(DataFrame.unionByName, frames)
        if frames
        else empty_labelled(spark)
    )
    return LoadResult(
        table,
        spark.createDataFrame(status, "source string, status string, error string"),
    )


def _check_columns(frame: DataFrame) -> None:
    """Raises unless the frame can join the union; resolves the frame's plan."""
    wanted = {field.name: field.dataType for field in LABELLED_SCHEMA}
    wanted["row_id"] = T.StringType()
    found = {field.name: field.dataType for field in frame.schema}
    missing = set(LABELLED_SCHEMA.names) - set(found)
    other = {name for name, kind in found.items() if wanted.get(name) != kind}
    if missing or other:
        raise ValueError(f"columns missing {sorted(missing)}, not as expected {sorted(other)}")


def empty_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LABELLED_SCHEMA)


def _text(text: Column, null_policy: str) -> Column:
    """`drop` loses null and empty text later; `stringify` turns null into "None"."""
    text = text.cast("string")
    if null_policy == "stringify":
        return F.coalesce(text, F.lit("None"))
    if null_policy == "drop":
        return text
    raise ValueError(f"null_policy is drop or stringify, not {null_policy!r}")


def _labelled(
    df: DataFrame,
    text: Column,
    y: Column,
    source: str | Column,
    subtype: Column,
    row_id: str | Column | None,
) -> DataFrame:
    columns = [
        text.cast("string").alias("prompt"),
        y.cast("int").alias("y"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        subtype.alias("subtype"),
    ]
    if row_id is not None:
        row_id = F.col(row_id) if isinstance(row_id, str) else row_id
        columns.append(row_id.cast("string").alias("row_id"))
    return df.select(*columns).where(F.length("prompt") > 0)
