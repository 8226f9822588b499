"""How far the sources of a language diverge, by hash-consed segment trees over term ids.

1. Tasks count terms and the documents that hold them per (lang, source), in tables of
   bounded size; Spark adds them up. A language keeps the terms of enough documents.
2. Terms are dealt into blocks by hash, sources into tiles of at most `TILE`. One group of
   rows is a block of term ids with one or two tiles of sources, of bounded size however
   many terms, sources or documents there are.
3. In a block every source's counts are the leaves of a segment tree. Nodes are interned
   by their children through a hash table, so identical subtrees, the empty ones of rare
   terms above all, are one node in all trees.
4. Two trees are walked together from the root. Each level holds the different pairs of
   nodes met and how often, so a pair is expanded or priced once; the price of a pair of
   leaves needs only the sizes of the two sources. Block sums are added by Spark.

All arithmetic is on whole numbers. Defined cases: null text, lang and source are the empty
string; a source without kept terms, or without any text, takes part with counts of zero; a
language without kept terms has pairs of value 0 and no terms; rows of one id, and equal
rows, are documents each; very long texts are counted in pieces cut between terms; ties
rank by the UTF-8 bytes of the item; an empty table gives an empty one; other columns are
not read. The result has a row for every ordered pair of a language's sources, as asked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import broadcast_if_small
from labelloom.session import materialize, settle

MIN_DOCS = 10
TOP_TERMS = 10
# Terms a block and sources a tile, on average and at most.
BLOCK_TERMS = 3000
TILE = 64
# Counted terms that a task holds before it hands them out.
HELD_TERMS = 300_000
_SCALE = 1_000_000_000
_PIECE = 1 << 20
# Letters of ASCII and all other characters' bytes; the rest separates terms.
_LOWER = bytes(
    b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)
)
_COUNTED = "lang string, source string, term string, count bigint, docs bigint"
_PRICED = "lang string, source string, part string, item string, value bigint"


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased terms of a text, in lists of bounded size."""
    blanked = text.translate(_LOWER)
    at = 0
    while at < len(blanked):
        end = blanked.find(b" ", at + _PIECE)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def count_terms(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, term, count, docs); a null term marks that the group occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                total, inside = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(total)
                met: set[bytes] = set()
                for terms in term_pieces(text.as_py()):
                    total.update(terms)
                    met.update(terms)
                inside.update(met)
                size += len(total)
                if size >= HELD_TERMS:
                    yield from _counted(held)
                    held, size = {}, 0
        yield from _counted(held)

    def named(column: str, name: str):
        return F.coalesce(F.col(column), F.lit("")).alias(name)

    counted = docs.select(
        named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text")
    ).mapInArrow(rows, _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def _counted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (total, inside) in held.items():
        n = len(total) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * n, pa.string()),
                pa.array([source] * n, pa.string()),
                pa.array([None, *total], pa.binary()).view(pa.string()),
                pa.array([0, *total.values()], pa.int64()),
                pa.array([0, *(inside[t] for t in total)], pa.int64()),
            ],
            names=["lang", "source", "term", "count", "docs"],
        )


class Forest:
    """Segment trees over the same term ids that share their identical subtrees."""

    def __init__(self, counts: np.ndarray):
        """One tree for each row; ids are padded to a power of two by leaves of no price."""
        trees, terms = counts.shape
        width = 1 << max(0, terms - 1).bit_length()
        padded = np.full((trees, width), -1, dtype=np.int64)
        padded[:, :terms] = counts
        codes, self.leaves = pd.factorize(padded.ravel())
        nodes = codes.reshape(trees, width)
        # One table a level: the children of each different node.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        below = len(self.leaves)
        while nodes.shape[1] > 1:
            keys = nodes[:, ::2] * below + nodes[:, 1::2]
            codes, different = pd.factorize(keys.ravel())
            nodes = codes.reshape(keys.shape)
            self.levels.append((different // below, different % below))
            below = len(different)
        self.roots = nodes[:, 0]

    def leaf_pairs(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of leaves under the same id, and how many ids have each."""
        a, b = self.roots[[i]], self.roots[[j]]
        times = np.ones(1, dtype=np.int64)
        for left, right in reversed(self.levels):
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            base = int(b.max()) + 1
            codes, different = pd.factorize(a * base + b)
            times = np.bincount(codes, np.concatenate([times, times]), len(different))
            times = times.astype(np.int64)
            a, b = different // base, different % base
        return a, b, times


def shares(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (size + 2 terms)); 0 stays for padding."""
    raised = counts + 2
    if len(raised) and int(raised.max()) >= 2**63 // _SCALE:
        raised = raised.astype(object)
    p = (1 + raised * _SCALE // (size + 2 * terms)).astype(np.int64)
    return np.where(counts < 0, 0, p)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // np.maximum(p + q, 1)


def price_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All pairs of sources of one or two tiles over one block of terms, and top terms."""
    lang, _, first, second = (k.as_py() for k in key)
    is_head = np.asarray(rows["term"].is_null())
    head = rows.filter(pa.array(is_head)).sort_by("number")
    names = head["source"].to_pylist()
    numbers = np.asarray(head["number"])
    sizes = head["size"].to_pylist()
    n_terms, lang_size = head["terms"][0].as_py(), head["lang_size"][0].as_py()
    body = rows.filter(pa.array(~is_head))
    held = pd.DataFrame(
        {
            "term": body["term"].cast(pa.binary()).to_pylist(),
            "total": np.asarray(body["lang_count"]),
        }
    )
    # Frequent terms first: rare ones then share their subtrees of zeros.
    kept = held.drop_duplicates("term").sort_values(
        ["total", "term"], ascending=[False, True], ignore_index=True
    )
    width = head["width"][0].as_py() or 0
    counts = np.zeros((len(names) + 1, width), dtype=np.int64)
    at = pd.Index(kept["term"]).get_indexer(held["term"])
    counts[np.searchsorted(numbers, np.asarray(body["number"])), at] = body["count"]
    counts[-1, : len(kept)] = kept["total"]
    out: list[tuple[str, str, str, int]] = []
    forest = Forest(counts) if width else None
    if forest:
        tables = [shares(forest.leaves, size, n_terms) for size in [*sizes, lang_size]]
    tiles = np.asarray(head["tile"])
    for i, j in zip(*np.triu_indices(len(names), 1)):
        if first != second and tiles[i] == tiles[j]:
            continue
        value = 0
        # Equal trees of sources of one size have no distance anywhere.
        if forest and (sizes[i] != sizes[j] or forest.roots[i] != forest.roots[j]):
            a, b, times = forest.leaf_pairs(i, j)
            value = int((distance(tables[i][a], tables[j][b]) * times).sum())
        out += [(names[i], "pair", names[j], value), (names[j], "pair", names[i], value)]
    if forest and first == second:
        for i, name in enumerate(names):
            out += _top_terms(name, i, forest, tables, counts, kept["term"].tolist())
    columns = list(zip(*out)) if out else [(), (), (), ()]
    return pa.table(
        {
            "lang": pa.array([lang] * len(out), pa.string()),
            "source": pa.array(columns[0], pa.string()),
            "part": pa.array(columns[1], pa.string()),
            "item": pa.array(columns[2], pa.string()),
            "value": pa.array(columns[3], pa.int64()),
        }
    )


def _top_terms(name, i, forest, tables, counts, terms) -> list[tuple[str, str, str, int]]:
    """The block's candidates: any further one has TOP_TERMS before it in this block."""
    a, b, _ = forest.leaf_pairs(i, len(counts) - 1)
    p, q = tables[i][a], tables[-1][b]
    more = (p > q) & (forest.leaves[a] > 0)
    priced = {
        pair: value
        for pair, value in zip(
            zip(forest.leaves[a[more]].tolist(), forest.leaves[b[more]].tolist()),
            distance(p[more], q[more]).tolist(),
        )
    }
    found = [
        (-priced[pair], term)
        for pair, term in zip(zip(counts[i].tolist(), counts[-1].tolist()), terms)
        if pair in priced
    ]
    return [(name, "term", term.decode(), -value) for value, term in sorted(found)[:TOP_TERMS]]


def audit_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    block_terms: int = BLOCK_TERMS,
    tile: int = TILE,
) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs, and each source's top terms."""
    return settle(
        docs.sparkSession,
        "audit",
        lambda: _audit(
            count_terms(docs, text_col=text_col, lang_col=lang_col, source_col=source_col),
            min_docs,
            block_terms,
            tile,
        ),
    )


def _audit(counted: DataFrame, min_docs: int, block_terms: int, tile: int) -> DataFrame:
    counted = materialize(counted, "audit-counts")
    # At most as many rows in a window as the language has sources.
    everywhere = Window.partitionBy("lang", "term")
    kept = materialize(
        counted.where("term IS NOT NULL")
        .withColumn("lang_docs", F.sum("docs").over(everywhere))
        .withColumn("lang_count", F.sum("count").over(everywhere))
        .where(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "count", "lang_count"),
        "audit-kept",
    )
    groups = materialize(_groups(counted, kept, block_terms, tile), "audit-groups")
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    placed = groups.withColumn("tile", F.floor(F.col("number") / tile).cast("int"))
    in_block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    # Terms that none of a group's sources has still count in its pairs, as zeros.
    widths = (
        kept.select("lang", "term")
        .distinct()
        .join(broadcast_if_small(groups.where("number = 0").select("lang", "blocks")), "lang")
        .groupBy("lang", in_block.alias("block"))
        .agg(F.count(F.lit(1)).alias("width"))
    )
    heads = (
        placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(widths, ["lang", "block"], "left")
        .withColumn("other", F.explode(tiles))
        .withColumn("term", F.lit(None).cast("string"))
        .withColumn("count", F.lit(0).cast("long"))
        .withColumn("lang_count", F.lit(0).cast("long"))
    )
    narrow = placed.select("lang", "source", "number", "tile", "tiles", "blocks")
    body = (
        kept.join(broadcast_if_small(narrow), ["lang", "source"])
        .withColumn("block", in_block)
        .withColumn("other", F.explode(tiles))
        .withColumn("source", F.lit(None).cast("string"))
    )
    priced = (
        heads.unionByName(body, allowMissingColumns=True)
        .select(
            "lang",
            "block",
            F.least("tile", "other").alias("first"),
            F.greatest("tile", "other").alias("second"),
            "source",
            "number",
            "tile",
            "size",
            "terms",
            "width",
            "lang_size",
            "term",
            "count",
            "lang_count",
        )
        .groupBy("lang", "block", "first", "second")
        .applyInArrow(price_block, _PRICED)
    )
    rank = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (
        priced.groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(rank))
        .where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
    )


def _groups(counted: DataFrame, kept: DataFrame, block_terms: int, tile: int) -> DataFrame:
    """One row a (lang, source): its size, number, and how its language is dealt."""
    langs = (
        kept.groupBy("lang", "term")
        .agg(F.first("lang_count").alias("n"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_size"))
    )
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    by_source = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    return (
        counted.where("term IS NULL")
        .select("lang", "source")
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang",
            "source",
            F.coalesce("size", zero).alias("size"),
            F.coalesce("terms", zero).alias("terms"),
            F.coalesce("lang_size", zero).alias("lang_size"),
            (F.row_number().over(by_source.orderBy("source")) - 1).alias("number"),
            F.ceil(F.count(F.lit(1)).over(by_source) / tile).cast("int").alias("tiles"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("terms", zero) / block_terms))
            .cast("int")
            .alias("blocks"),
        )
    )
