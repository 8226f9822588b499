import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import metrics, models, scoring, selection, splits


def test_tfidf_matches_the_formula(labelled):
    texts = ["red fish blue fish", "one red fish", "blue sky ünï", "a red fish"]
    df = labelled([(t, 0, "s", "safe") for t in texts])
    features = models.fit_text_features(df, models.TfidfSettings(min_df=1))
    vocabulary = features.vocabulary
    docs = []
    for text in texts:
        words = [w for w in text.split() if len(w) > 1]
        docs.append(words + [" ".join(pair) for pair in zip(words, words[1:])])
    assert set(vocabulary) == {t for d in docs for t in d}
    frequency = {t: sum(t in d for d in docs) for t in vocabulary}
    rows = features.transform(df).select("row_id", vector_to_array("features").alias("v"))
    for row in rows.collect():
        doc = docs[row.row_id]
        want = [
            (1 + math.log(doc.count(t))) * (math.log(5 / (1 + frequency[t])) + 1)
            if t in doc
            else 0.0
            for t in vocabulary
        ]
        norm = math.sqrt(sum(w * w for w in want))
        assert row.v == pytest.approx([w / norm for w in want])


def test_entries_are_those_of_the_vectors(labelled):
    df = labelled([("red fish blue fish", 0, "s", "safe"), (None, 0, "s", "safe"), ("a red", 1, "s", "x")])
    features = models.fit_text_features(df, models.TfidfSettings(min_df=1))
    got = {(r.row_id, r.term): r.weight for r in features.weights(df).collect()}
    want = {
        (r.row_id, features.vocabulary[i]): w
        for r in features.transform(df).select("row_id", vector_to_array("features").alias("v")).collect()
        for i, w in enumerate(r.v)
        if w
    }
    assert got == pytest.approx(want) and len(got) == 7


@pytest.mark.parametrize("limit", [1, 7, 40, 41, 500, 5000])
def test_vocabulary_equals_a_sort(spark, monkeypatch, limit):
    """Cuts in the counts and among ties, by the bytes of long and short names."""
    monkeypatch.setattr(selection, "FEW_TIES", 3)
    monkeypatch.setattr(selection, "BINS", 4)
    rng = random.Random(3)
    names = {"".join(rng.choice("abé漢") for _ in range(rng.choice([1, 2, 9, 30]))) for _ in range(900)}
    names |= {"same long beginning " + n for n in list(names)[:200]}
    rows = [(n, rng.choice([1, 1, 2, 3, 10**9, 10**12 + 5])) for n in names]
    df = spark.createDataFrame(rows, "term string, tf bigint").repartition(3)
    keys = [-F.col("tf"), *selection.byte_keys("term")]
    got = selection.first_rows(df, keys, limit, last="term")
    want = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:limit]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vocabulary_is_not_ranked_in_one_place(labelled, monkeypatch):
    """More terms than wanted, most of them tied: no task sorts the table."""
    monkeypatch.setattr(selection, "FEW_TIES", 10)
    df = labelled([(f"word{i} other{i} third{i}", 0, "s", "x") for i in range(300)])
    terms = models.term_statistics(df, min_df=1, max_features=500)
    assert terms.count() == 500
    plan = terms._jdf.queryExecution().executedPlan().toString()
    limits = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert all(n <= 10 for n in limits) and " Sort " not in plan


def test_equal_rows_train_as_one(spark):
    """Dense and sparse forms, weights and counts; the fit is that of all rows."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.randrange(3)
        values = [float(kind == k) for k in range(3)]
        vector = Vectors.dense(values) if i % 2 else Vectors.sparse(3, [kind], [1.0])
        rows.append((int(rng.random() < 0.2 + 0.3 * kind), vector))
    df = spark.createDataFrame(rows, ["y", "features"])
    merged = models.compressed(models.with_balanced_weights(df))
    assert merged.count() == 6 and merged.agg(F.sum("n")).first()[0] == 400
    whole = models.fit_logistic(df, c=1e6, tol=1e-10)
    small = models.fit_logistic(df, c=1e6, tol=1e-10, compress=True)
    probe = spark.createDataFrame([(i, Vectors.sparse(3, [i], [1.0])) for i in range(3)], ["i", "features"])
    for model in (whole, small):
        for r in models.predictions(model, probe).collect():
            ones = sum(y for y, v in rows if v[r.i]) / sum(y for y, _ in rows)
            zeros = sum(1 - y for y, v in rows if v[r.i]) / sum(1 - y for y, _ in rows)
            assert r.y_prob == pytest.approx(ones / (ones + zeros), abs=1e-4)


def test_a_text_without_known_terms_is_a_zero_vector(labelled):
    train = labelled([("red fish", 0, "s", "safe"), ("red sky", 1, "s", "x")])
    features = models.fit_text_features(train, models.TfidfSettings(min_df=1))
    other = labelled([("unseen words", 0, "s", "safe"), (None, 0, "s", "safe")])
    rows = features.transform(other).select(vector_to_array("features").alias("v"))
    assert all(not any(r.v) for r in rows.collect())


def test_tfidf_classifier_learns(labelled):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        words = rng.choices(["tea", "book", "road", "lamp", "tree"], k=8)
        if i % 4 == 0:
            words.insert(rng.randrange(8), "attack")
        rows.append((" ".join(words), int(i % 4 == 0), f"s{i % 2}", "x"))
    made = splits.make_splits(labelled(rows)).cache()
    model = models.fit_tfidf_classifier(made.where("split = 'train'"))
    report = scoring.evaluate(made.where("split = 'test'"), model.score, model="m1").first()
    assert report.model == "m1" and report.f1 > 0.9 and report.auroc > 0.95


def test_balanced_weights(labelled):
    df = labelled([("t", int(i < 2), "s", "x") for i in range(10)])
    got = {r.y: r.weight for r in models.with_balanced_weights(df).collect()}
    assert got == {1: 2.5, 0: 0.625}


def embedded(spark, n=120):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        y = i % 3 == 0
        rows.append((i, int(y), [float(x) for x in rng.normal(1.5 if y else -1.5, 1, 4)]))
    return spark.createDataFrame(rows, "row_id bigint, y int, embedding array<float>")


def test_embedding_head(spark):
    df = embedded(spark)
    head = models.fit_embedding_head(df, hidden=8, max_iter=30)
    scored = models.predictions(head, models.with_vector(df))
    assert metrics.binary_report(scored).first().f1 > 0.9


def test_cross_validation(spark):
    df = embedded(spark)
    folded = splits.assign_folds(df, k=3, stratum=F.col("y").cast("string"))

    def fit(train):
        assert len({r["count"] for r in train.groupBy("y").count().collect()}) == 1
        model = models.fit_logistic(models.with_vector(train))
        return lambda rows: models.predictions(model, models.with_vector(rows))

    reports = models.cross_validate(folded, fit, k=3)
    rows = reports.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2]
    assert sum(r.tp + r.tn + r.fp + r.fn for r in rows) == 120
    summary = {r.metric: r for r in models.cv_summary(reports).collect()}
    assert summary["f1"].mean == pytest.approx(np.mean([r.f1 for r in rows]))
    assert summary["f1"].std == pytest.approx(np.std([r.f1 for r in rows], ddof=1))


def test_scores_stay_with_their_rows(labelled):
    df = labelled([("x" * i, i % 2, "s", "safe") for i in range(1, 50)]).repartition(6)

    def predict(texts):
        p = np.array([len(t) / 50 for t in texts])
        return (p > 0.5).astype(int), p

    for r in scoring.score_text(df, predict).collect():
        assert r.y_prob == len(r.prompt) / 50 and r.y_pred == int(r.y_prob > 0.5)


def test_texts_are_encoded_once(spark, labelled, tmp_path):
    log = spark.sparkContext.accumulator(0)

    def encoder(texts):
        log.add(len(texts))
        return np.array([[len(t), t.count("a")] for t in texts])

    cache = str(tmp_path / "cache")
    first = labelled([("aa", 0, "s", "x"), ("bbb", 0, "s", "x"), ("aa", 1, "s", "x")])
    got = scoring.embed_with_cache(first, encoder, cache=cache, model="toy")
    assert sorted((r.row_id, r.embedding) for r in got.collect()) == [
        (0, [2.0, 2.0]), (1, [3.0, 0.0]), (2, [2.0, 2.0]),
    ]
    assert log.value == 2
    more = labelled([("aa", 0, "s", "x"), ("cccc", 0, "s", "x")])
    got = scoring.embed_with_cache(more, encoder, cache=cache, model="toy")
    assert got.count() == 2 and log.value == 3
    scoring.embed_with_cache(more, encoder, cache=cache, model="other").count()
    assert log.value == 5


def test_embeddings_of_null_texts_and_of_doubled_cache_entries(labelled, tmp_path, spark):
    reads = spark.sparkContext.accumulator(0)
    rows = labelled([("aa", 0, "s", "x"), (None, 0, "s", "x"), ("b", 0, "s", "x")])

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    cache = str(tmp_path / "cache")
    df = rows.mapInPandas(counted, rows.schema)

    def encoder(texts):
        return np.array([[len(t)] for t in texts])

    got = scoring.embed_with_cache(df, encoder, cache=cache, model="toy")
    assert sorted((r.row_id, r.embedding) for r in got.collect()) == [
        (0, [2.0]), (1, None), (2, [1.0])
    ]
    assert reads.value == 3
    target = f"{cache}/model=toy"
    entries = spark.read.parquet(target).toPandas()
    doubled = spark.createDataFrame(entries, scoring.CACHE_SCHEMA).withColumn("run", F.lit("z"))
    with scoring._cache_table(spark, target, scoring.CACHE_BUCKETS) as table:
        doubled.write.insertInto(table)
    assert spark.read.parquet(target).count() == 4
    assert scoring.embed_with_cache(rows, encoder, cache=cache, model="toy").count() == 3
    compact = str(tmp_path / "compact")
    assert scoring.compact_cache(spark, target, compact).count() == 2
    assert spark.read.parquet(compact).count() == 2


def test_cached_vectors_are_not_shuffled(labelled, tmp_path, spark):
    """A run with a few new texts: an exchange lies over the rows, none over the cache."""

    def encoder(texts):
        return np.array([[len(t)] for t in texts])

    cache = str(tmp_path / "cache")
    old = [(f"text {i}", 0, "s", "x") for i in range(200)]
    scoring.embed_with_cache(labelled(old), encoder, cache=cache, model="toy")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = labelled(old + [("new a", 0, "s", "x"), ("new b", 0, "s", "x")])
        got = scoring.embed_with_cache(rows, encoder, cache=cache, model="toy")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 202 and got.where("embedding IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    (at,) = [k for k, line in enumerate(lines) if "FileScan" in line and "embedding" in line]
    depth = [len(line) - len(line.lstrip(" :|+-")) for line in lines]
    above = [k for k in range(at) if all(depth[k] < depth[j] for j in range(k + 1, at + 1))]
    assert "Exchange" not in "".join(lines[k] for k in above), plan
    assert "Exchange" in plan
    assert spark.read.parquet(f"{cache}/model=toy").count() == 202


def test_each_row_is_scored_once(labelled, tmp_path, spark):
    scored = spark.sparkContext.accumulator(0)

    def predict(texts):
        scored.add(len(texts))
        p = np.array([len(t) / 10 for t in texts])
        return p > 0.5, p

    df = labelled([("a" * (1 + i % 9), i % 2, f"s{i % 3}", "x") for i in range(40)])
    sources = str(tmp_path / "sources")
    scoring.evaluate(
        df,
        lambda rows: scoring.score_text(rows, predict),
        model="m",
        reports=str(tmp_path / "reports"),
        source_reports=sources,
    ).collect()
    assert scored.value == 40
    latest = scoring.latest_source_metrics(spark.read.parquet(sources))
    assert sorted((r.source, r.n) for r in latest.collect()) == [("s0", 14), ("s1", 13), ("s2", 13)]


def test_outside_scores_must_match_row_by_row(labelled, spark):
    df = labelled([("a", 0, "s", "x"), ("b", 1, "s", "x")])
    schema = "row_id bigint, y_pred int, y_prob double"
    good = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (5, 1, 0.5)], schema)
    rows = scoring.join_scores(df, good).collect()
    assert sorted((r.row_id, r.y_pred, r.y_prob) for r in rows) == [(0, 0, 0.1), (1, 1, 0.9)]
    for scores, fault in (([(0, 0, 0.1)], "row_id 1 has no"), ([(0, 0, 0.1), (1, 1, 0.9)] * 2, "several")):
        with pytest.raises(Exception, match=fault):
            joined = scoring.join_scores(df, spark.createDataFrame(scores, schema))
            metrics.confusion(joined).collect()


def test_reports_are_appended(labelled, tmp_path, spark):
    df = labelled([("a", 0, "s", "x"), ("b", 1, "s", "x")])
    path = str(tmp_path / "reports")

    def scorer(flip):
        p = F.when(F.col("y") == flip, 0.9).otherwise(0.1)
        return lambda rows: rows.withColumn("y_prob", p).withColumn(
            "y_pred", (p > 0.5).cast("int")
        )

    assert scoring.evaluate(df, scorer(0), model="m1", reports=path).first().f1 == 0
    assert scoring.evaluate(df, scorer(1), model="m1", reports=path).first().f1 == 1
    assert spark.read.parquet(path).count() == 2
    assert metrics.comparison(spark.read.parquet(path)).first().f1 == 1


def test_runs_that_break_off_are_not_seen(labelled, tmp_path, spark):
    """The record is the last thing a run writes: without it neither table shows the run."""
    df = labelled([("a", 0, "s", "x"), ("b", 1, "t", "x")])
    reports, rates, log = (str(tmp_path / n) for n in ("reports", "rates", "log"))

    def scorer(rows):
        p = F.when(F.col("y") == 1, 0.9).otherwise(0.1)
        return rows.withColumn("y_prob", p).withColumn("y_pred", (p > 0.5).cast("int"))

    paths = {"reports": reports, "source_reports": rates, "log": log}
    first = scoring.evaluate(df, scorer, model="m", **paths).first()
    with pytest.raises(Exception, match="boom"):
        # Rates are written, then the report fails on a check of its own.
        broken = df.withColumn("y", F.when(F.col("row_id") < 9, F.col("y")))
        with pytest.MonkeyPatch.context() as patch:
            def fail(*args, **kwargs):
                raise RuntimeError("boom")
            patch.setattr(metrics, "report_of", fail)
            scoring.evaluate(broken, scorer, model="m", **paths)
    assert spark.read.parquet(rates).select("run_id").distinct().count() == 2
    finished = spark.read.parquet(log)
    for path in (reports, rates):
        seen = scoring.committed(spark.read.parquet(path), finished)
        assert {r.run_id for r in seen.select("run_id").collect()} == {first.run_id}


def test_closed_form_folds_learn_from_the_others(spark):
    """Statistics of one scan; each fold's model equals one trained without it."""
    df = embedded(spark)
    folded = splits.assign_folds(df.withColumn("source", F.lit("e")), k=3).cache()
    statistics = models.fold_statistics(folded)
    plan = statistics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(fold") <= 2 and plan.count("Generate") <= 2
    terms = {r.fold: r.terms for r in models.naive_bayes_parameters(statistics, k=3).collect()}
    rows = folded.collect()
    for fold in range(3):
        for y in (0, 1):
            x = np.array([r.embedding for r in rows if r.fold != fold and r.y == y], dtype=float)
            for t in terms[fold]:
                own = t.y1 if y else t.y0
                assert own.mean == pytest.approx(x[:, t.dim].mean())
                assert own.variance == pytest.approx(x[:, t.dim].var())
    scored = models.naive_bayes_scores(folded, models.naive_bayes_parameters(statistics, k=3))
    assert metrics.binary_report(scored).first().f1 > 0.9


def test_terms_are_looked_up_without_python_strings():
    names = sorted(f"term{i:04d}" for i in range(500))
    lists = [[names[(i * 7 + j * j) % 500] for j in range(i % 900)] + ["unknown"] for i in range(3000)]
    terms, vocabulary = pa.array(lists), pa.array(names)
    idf = np.linspace(1, 3, 500)
    assert pa.concat_arrays(list(models._in_slices(terms))).equals(terms)
    tracemalloc.start()
    at = 0
    for part in models._in_slices(terms):
        row, term, weight = models._weights(part, vocabulary, idf, True)
        found = {}
        for r, t, w in zip(row.tolist()[:800], term.tolist(), weight.tolist()):
            found.setdefault(r, {})[names[t]] = w
        for r in sorted(found)[:-1]:
            own = lists[at + r][:-1]
            raw = {t: (1 + math.log(own.count(t))) * idf[names.index(t)] for t in set(own)}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            assert found[r] == pytest.approx({t: v / norm for t, v in raw.items()})
        at += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The strings and numbers of all lists at once took over 100 MB.
    assert peak < 60 << 20
