"""Drawing bounded training samples, and moving small models around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import broadcast_if_small
from labelloom.session import materialize


def label_rows(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) with one row per id; null ids and labels are left out.

    Of contradicting labels of one id the greatest holds.
    """
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )


def sample_ids(ids: DataFrame, by: Column, limit: int, seed: int) -> tuple[DataFrame, dict]:
    """About `limit` rows of each class of (doc_id, ...) by id hash; rows per class before.

    The share kept follows from the class's size, so what is kept has the same expected
    size whatever the table holds; a hash makes reruns agree.
    """
    classed = ids.withColumn("__class", by)
    counts = {
        row["__class"]: row["count"] for row in classed.groupBy("__class").count().collect()
    }
    if not counts:
        return ids, counts
    shares = F.create_map(
        *[
            F.lit(x)
            for name, count in counts.items()
            for x in (name, min(1.0, limit / count))
        ]
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)
    kept = classed.where(draw < F.element_at(shares, F.col("__class"))).drop("__class")
    return kept, counts


def sample_rows(rows: DataFrame, by: str, limit: int, seed: int) -> tuple[DataFrame, dict]:
    """About `limit` rows of each class of (doc_id, text, ...), written once; rows before.

    As `sample_ids`, but a row is drawn by id and text and keeps its own class and text
    whatever other rows have its id. Equal rows are drawn together and come once, so that
    one row that fills much of the table does not fill the sample.
    """
    counts = {row[by]: row["count"] for row in rows.groupBy(by).count().collect()}
    if not counts:
        return rows, counts
    share = F.lit(0.0)
    for name, count in counts.items():
        share = F.when(F.col(by) == name, min(1.0, limit / count)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)
    drawn = rows.where(draw < share).groupBy("doc_id", by, F.sha2("text", 256).alias("of"))
    sample = drawn.agg(F.first("text").alias("text")).select("doc_id", by, "text")
    return materialize(sample, "sample-rows"), counts


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sampled rows with their texts, written once; repeated texts come once.

    The ids are few by their bound, so the texts of the table are not shuffled.
    """
    ids = materialize(ids, "sample-ids")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return materialize(texts.join(broadcast_if_small(ids), "doc_id"), "sample-texts")
