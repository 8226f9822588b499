import pytest
from pyspark.sql import functions as F

from labelloom.functions import with_row_id
from labelloom.sources import (
    LABELLED_SCHEMA,
    build_once,
    constant_source,
    filtered_source,
    is_built,
    label_mapped_source,
    load_all,
    resolve_column,
    taxonomy_source,
    write_document,
    write_table,
)


def test_constant_label(spark):
    rows = [("Wie spät ist es?", 5), ("", 6), (None, 7), (" ", 8)]
    df = spark.createDataFrame(rows, "ask string, extra int")
    got = constant_source(df, y=1, source="clock", subtype="harmful", candidates=("say", "ask"))
    assert got.schema.names == LABELLED_SCHEMA.names
    assert sorted(tuple(r) for r in got.collect()) == [
        (text, 1, "clock", "harmful") for text in (" ", "Wie spät ist es?")
    ]


def test_label_mapped(spark):
    labels = ["benign", "BENIGN", "Benign ", "", None, "other", "17"]
    rows = [(f"text {i}", label) for i, label in enumerate(labels)] + [(None, "benign")]
    df = spark.createDataFrame(rows, "prompt string, type string")
    got = {r.prompt: (r.y, r.subtype) for r in label_mapped_source(df, source="s").collect()}
    assert got == {
        f"text {i}": (0, "safe") if i < 2 else (1, "jailbreak") for i in range(len(labels))
    }
    kept = label_mapped_source(df, source="s", null_policy="stringify")
    assert kept.where("prompt = 'None'").count() == 1
    with pytest.raises(ValueError):
        label_mapped_source(df, source="s", null_policy="keep")


def test_filtered_source_takes_the_first_text(spark):
    """All mixes of present, empty and null in the three candidates, in every format."""
    names = ("redteam_query", "jailbreak_query", "prompt")
    rows, want = [], []
    for kind in ("text", "Text", "audio", None):
        for a in ("alpha", "", None):
            for b in ("beta", "", None):
                for c in ("gamma", "", None):
                    rows.append((kind, a, b, c))
                    first = next((x for x in (a, b, c) if x), None)
                    if kind in ("text", "Text") and first:
                        want.append(first)
    df = spark.createDataFrame(rows, "format string, " + ", ".join(f"{n} string" for n in names))
    got = filtered_source(df, source="s")
    assert sorted(r.prompt for r in got.collect()) == sorted(want)
    assert filtered_source(df.drop("format"), source="s").count() == 0


def test_taxonomy(spark):
    df = spark.createDataFrame([("q", "O1"), ("r", None)], "question string, domain string")
    got = {r.prompt: r.subtype for r in taxonomy_source(df, source="s").collect()}
    assert got == {"q": "O1", "r": "None"}
    plain = taxonomy_source(df.drop("domain"), source="s")
    assert {r.subtype for r in plain.collect()} == {"harmful"}


def test_candidates_in_order(spark):
    names = ("prompt", "instruction", "input", "text")
    for first in range(len(names)):
        columns = list(reversed(names[first:]))
        df = spark.createDataFrame([tuple(columns)], ", ".join(f"{c} string" for c in columns))
        row = constant_source(df, y=0, source="b", subtype="safe", candidates=names).first()
        assert (row.prompt, row.y, row.subtype) == (names[first], 0, "safe")
    with pytest.raises(ValueError, match="text"):
        resolve_column(df, ("prompt", "goal"))


def test_one_source_with_another_shape_does_not_harm_the_rest(spark):
    """Sources with string, number and no row ids still make one table."""
    df = spark.createDataFrame([("ein Satz", 3)], "prompt string, n bigint")

    def source(name, row_id):
        return lambda: constant_source(df, y=1, source=name, subtype="x", row_id=row_id)

    loaded = load_all(
        spark,
        {
            "numbers": source("numbers", "n"),
            "names": source("names", F.lit("name-1")),
            "none": source("none", None),
            "odd": lambda: df.select("prompt"),
        },
    )
    rows = {r.source: r.row_id for r in loaded.table.collect()}
    assert rows["numbers"] == "3" and rows["names"] == "name-1" and rows["none"]
    status = {r.source: r.status for r in loaded.status.collect()}
    assert status == {"numbers": "loaded", "names": "loaded", "none": "loaded", "odd": "failed"}


def test_load_all_reports_failures(spark):
    good = spark.createDataFrame([("rain",), ("snow",)], "prompt string")

    def fail():
        raise RuntimeError("unavailable")

    loaded = load_all(
        spark,
        {
            "good": lambda: constant_source(good, y=1, source="good", subtype="harmful"),
            "down": fail,
            "gone": lambda: spark.read.parquet("/nonexistent/table"),
            "odd": lambda: constant_source(
                good, y=1, source="odd", subtype="harmful", candidates=("goal",)
            ),
        },
    )
    assert [tuple(r) for r in loaded.counts().collect()] == [("good", 2)]
    status = {r.source: r.status for r in loaded.status.collect()}
    assert status == {"good": "loaded", "down": "failed", "gone": "failed", "odd": "failed"}


def test_all_sources_failing_gives_a_typed_empty_table(spark):
    def fail():
        raise RuntimeError("unavailable")

    loaded = load_all(spark, {"down": fail})
    assert loaded.table.schema.names[:4] == LABELLED_SCHEMA.names
    assert loaded.table.count() == 0


def test_row_ids_do_not_depend_on_partitions(labelled):
    df = labelled([(f"text {i}", i % 2, "s", "safe") for i in range(50)]).drop("row_id")
    one, many = (with_row_id(df.repartition(n)) for n in (1, 7))
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.select("row_id").distinct().count() == 50


def test_sinks(spark, tmp_path, labelled):
    path = str(tmp_path / "deep" / "table")
    calls = []

    def build():
        calls.append(1)
        return labelled([("a", 1, "s", "safe"), ("b", 0, "s", "safe")])

    assert not is_built(spark, path)
    for _ in range(2):
        assert build_once(spark, path, build, partition_by=["y"]).count() == 2
    assert is_built(spark, path) and len(calls) == 1
    write_table(build(), path, mode="append")
    write_document(build().agg(F.count("*").alias("n")), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first().n == 2


def test_a_truncated_file_fails_its_source_alone(spark, tmp_path):
    """One of two files of a table is cut short: none of its rows may come through."""
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    rows = spark.range(400).select("id", F.concat(F.lit("text "), "id").alias("text"))
    rows.repartition(2).write.parquet(good)
    rows.repartition(2).write.parquet(bad)
    victim = sorted((tmp_path / "bad").glob("part-*.parquet"))[0]
    data = victim.read_bytes()
    victim.write_bytes(data[:100] + b"\0" * (len(data) - 200) + data[-100:])

    def source(name, path):
        return lambda: constant_source(
            spark.read.schema("id bigint, text string").parquet(path),
            y=0, source=name, subtype="safe", candidates=("text",),
        )

    loaded = load_all(
        spark, {"good": source("good", good), "bad": source("bad", bad)}, staged=True
    )
    assert {r.source: r.status for r in loaded.status.collect()} == {
        "good": "loaded", "bad": "failed"
    }
    assert {r.source: r.n for r in loaded.counts().collect()} == {"good": 400}
