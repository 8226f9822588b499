"""One query per operator of this package, over the whole of its table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import (
    chat,
    exact_dedup,
    fill_middle,
    language,
    minhash_dedup,
    mixing,
    quality_knn,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    source_audit,
    toxicity,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
PRODUCTION_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_documents(spark, sf_dir), words=2, percent=80)


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_documents(spark, sf_dir))


@_query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    formatted = chat.format_conversations(
        turns.select("conv_id", "turn", "role", "text").unionByName(own),
        _file(public_tokenizers.path("byte_bpe_50k.json")).decode(),
    )
    return formatted.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(
        _read_back,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint",
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the turns and of the learned text, from the output alone."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns = chat.parse(row["formatted"])
            loss = chat.learned_text(row["formatted"], row["loss_from"], row["loss_to"])
            rows.append(
                {
                    "conv_id": row["conv_id"],
                    "n_turns": len(turns),
                    "turns_sha256": _sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                    "loss_chars": len(loss),
                    "loss_sha256": _sha(loss),
                    "formatted_chars": len(row["formatted"]),
                }
            )
        if rows:
            yield pa.RecordBatch.from_pylist(rows)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _file(path: str) -> bytes:
    """A tokenizer's definition, read where the query is planned."""
    with open(path, "rb") as file:
        return file.read()


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(str(rule) for rule in PRODUCTION_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


@_query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _file(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_codec.encode_documents(
        _documents(spark, sf_dir), model, decoded=True
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias(
            "ids_sha256"
        ),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        # Of the source bytes of every piece, which the operator aligns.
        F.xxhash64("starts", "ends").alias("spans_hash"),
    )


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_ids(_documents(spark, sf_dir))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@_query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir))

    def counted(kind: str):
        own = F.filter("findings", lambda f: f["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    def joined(findings):
        spans = F.transform(
            findings,
            lambda f: F.concat_ws(
                ":", f["kind"], f["start"].cast("string"), f["end"].cast("string")
            ),
        )
        return F.concat_ws(",", spans)

    base = F.filter("findings", lambda f: f["kind"] != secret_scan.MODEL)
    return found.select(
        "doc_id",
        *[counted(kind) for kind in secret_scan.RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


@_query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(_documents(spark, sf_dir))


@_query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_documents(spark, sf_dir))
    return fill_middle.restore(made.drop("pieces")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        "output_sha256",
        F.sha2("restored", 256).alias("restored_sha256"),
    )
