"""URL filters: host-suffix and path-prefix expressions matched by hash prefix.

Each distinct (host, path) is expanded into every host suffix (at label borders) with
every path prefix of a length that some rule has. Expressions meet the rules in an
equi-join on the first bytes of their digest; the full digest, which covers host and
path apart, then confirms the match, and the longest rule that fits gives the verdict.
Everything is a DataFrame expression.

Defined cases: a null url or one without `://` has an empty host and path, which no rule
fits; repeated and null page ids are judged row by row; of equally long rules the one
with the longer host wins, then `block`; an empty rule table leaves every row to the
default; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import BROADCAST_ROWS

# Hex digits of the digest that the join compares; the rest is confirmed afterwards.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """Between the first `://` and `/`, `?` or `#`; A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(
        host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def url_path(url: Column) -> Column:
    """From the host's end up to `?` or `#`."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(
        F.when(at > 0, F.substr(url, at + 3, F.length(url))), F.lit("")
    )


def _digest(host: Column, path: Column) -> Column:
    # A line feed cannot be mistaken: lengths come first.
    return F.sha2(
        F.concat(F.length(host).cast("string"), F.lit("\n"), host, path), 256
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """`id`, host, path, rule and verdict of every row.

    `rules` has host, path and verdict (`allow` or `block`). It is broadcast only if
    counted within `broadcast_rows`; a larger rule table is joined by shuffle, where
    adaptive execution splits the expressions that most urls share.
    """
    parts = pages.select(
        F.col(id_col),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    verdicts = _verdicts(parts.select("host", "path").distinct(), rules, broadcast_rows)
    return parts.join(verdicts, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )


def _verdicts(urls: DataFrame, rules: DataFrame, broadcast_rows: int) -> DataFrame:
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
        .select(
            F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"),
            F.col("digest").alias("rule_digest"),
            F.struct(
                (F.length("host") + F.length("path")).alias("size"),
                F.length("host").alias("host_size"),
                F.col("verdict").alias("verdict"),  # `block` sorts after `allow`
                F.concat("host", "path").alias("rule"),
                F.length("path").alias("path_size"),
            ).alias("hit"),
        )
    )
    # One row of the distinct lengths: as many numbers as rule paths have lengths.
    lengths = rules.agg(F.collect_set("hit.path_size").alias("sizes")).first()["sizes"]
    if not lengths:
        return urls.select(
            "host",
            "path",
            F.lit(None).cast("string").alias("rule"),
            F.lit(None).cast("string").alias("verdict"),
        )
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)])
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(sizes, lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), 1, n),
    )
    expressions = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("head", F.explode(prefixes))
        .withColumn("full", _digest(F.col("suffix"), F.col("head")))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    if rules.count() <= broadcast_rows:
        rules = F.broadcast(rules)
    return (
        expressions.join(rules, "prefix")
        .where(F.col("full") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max("hit").alias("hit"))
        .select("host", "path", F.col("hit.rule"), F.col("hit.verdict"))
    )
