"""The unified table to splits on disk, with their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelloom.operators.splits import SplitSettings, make_splits, split_manifest
from labelloom.operators.stats import fingerprint, fingerprint_of
from labelloom.sources.sinks import build_once, is_built, write_document


def save_splits(
    unified: DataFrame,
    splits_path: str,
    manifest_path: str,
    settings: SplitSettings = SplitSettings(),
    *,
    digests: DataFrame | None = None,
) -> DataFrame:
    """One table partitioned by `split`, built only if it is not there yet.

    The manifest names the input and the settings of the splits that lie there. Asking
    for others than those is an error: remove the splits first. Splits without a manifest
    are from a run that broke off, and are built again. With `digests`, those stored with
    the input, the input is not read to check it.
    """
    spark = unified.sparkSession
    if is_built(spark, splits_path) and is_built(spark, manifest_path):
        _check_manifest(unified, digests, manifest_path, settings)
        return spark.read.parquet(splits_path)
    splits = build_once(
        spark,
        splits_path,
        lambda: make_splits(unified, settings),
        partition_by=["split"],
        again=True,
    )
    write_document(split_manifest(unified, splits, settings), manifest_path)
    return splits


def _check_manifest(
    unified: DataFrame, digests: DataFrame | None, path: str, settings: SplitSettings
) -> None:
    names = ["seed", "test_frac", "val_frac", "block_frac", "ratio"]
    wanted = {name: getattr(settings, name) for name in names}
    found = fingerprint(unified) if digests is None else fingerprint_of(digests)
    wanted["content_hash"] = found.first()[0]
    row = unified.sparkSession.read.json(path).first().asDict()
    other = sorted(name for name, value in wanted.items() if row.get(name) != value)
    if other:
        raise ValueError(f"the splits were built with another {', '.join(other)}")
