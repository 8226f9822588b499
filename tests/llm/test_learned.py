"""Toxicity, language and quality: held-out accuracy on fixtures, and what is learned from."""

import random
import re
import zlib

import numpy as np
import pytest

from labelloom.llm import language, learning, quality_knn, toxicity

DOCS = "doc_id bigint, text string, lang string, source string"
WORDS = {
    "en": ["the", "and", "with", "house", "river", "shine", "thing", "of"],
    "de": ["der", "und", "schön", "fluß", "haus", "zeit", "nicht", "über"],
    "fr": ["le", "être", "maison", "rivière", "où", "ça", "les", "une"],
}
INSULTS = ["grobian", "flegel", "rowdy"]


def part(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def sentence(rng, lang, n, extra=()):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "a", "e", "n", "s"]) for _ in range(n)]
    for word in extra:
        words.insert(rng.randrange(len(words)), word)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(list(WORDS))
        toxic, good = rng.random() < 0.15, rng.random() < 0.8
        extra = [rng.choice(INSULTS) + rng.choice(["", "x", "y"]) for _ in range(4)] if toxic else ()
        text = sentence(rng, lang, rng.randint(30, 200), extra)
        if not good:
            text = text.replace(" ", " ### ")
        docs.append((i, text, lang, "s"))
        if rng.random() < 0.6:
            labels.append((i, int(good), int(toxic)))
    edge = [(1001, None, None, None), (1002, "", "en", "s"), (1003, "12 !?", "en", "s")]
    edge += [(None, "the house", "en", "s"), (0, docs[0][1], "en", "s")]
    edge += [(1004, sentence(rng, "de", 40_000), "de", "s")]
    return docs + edge, labels


@pytest.fixture
def tables(spark, corpus):
    return (
        spark.createDataFrame(corpus[0], DOCS + "").repartition(4),
        spark.createDataFrame(corpus[1], "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_on_held_out_rows(tables, corpus):
    truth = {i: toxic for i, _, toxic in corpus[1]}
    rows = toxicity.score_toxicity(*tables).collect()
    assert len(rows) == len(corpus[0])
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (part(r["doc_id"], 5) == 0) for r in rows if r["doc_id"] is not None)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert len(held) > 60 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1001, 1002, 1003, 1004))


def test_toxicity_needs_no_confirmed_clean_text(spark, tables):
    docs, labels = tables
    only = toxicity.fit(docs, labels.where("toxic = 1"))
    assert only[1] == 1.0 and len(only[0]) == toxicity.CLASSIFIERS


def test_non_negative_risk_turns_back():
    """Few positives that the unlabelled texts repeat: the risk must not run below zero."""
    weights = toxicity.train(["bad word"] * 6, ["fine text", "bad word"] * 6, 0.5)
    assert all(np.isfinite(w) for w in weights.values())


@pytest.mark.parametrize("n", [200, 299, 300, 400])
def test_significance_is_the_same_for_all_sizes(n):
    """A word about 6.5 sigmas more frequent in toxic texts counts, however many they are."""
    m = 4000
    u = 0.02
    p = u + 6.5 * np.sqrt(u * (1 - u) * (1 / n + 1 / m))
    hits, misses = round(p * n), round(u * m) - 1
    positive = [{"flegel"} if i < hits else {"a"} for i in range(n)]
    unlabelled = [{"flegel"} if i < misses else {"a"} for i in range(m)]
    assert toxicity.select_features(positive, unlabelled) == ["flegel"]


def test_held_out_labels_do_not_matter(spark, tables, corpus):
    docs, _ = tables
    turned = [
        (i, 1 - q, 1 - t) if part(i, 5) == 0 else (i, q, t) for i, q, t in corpus[1]
    ]
    other = spark.createDataFrame(turned, "doc_id bigint, quality int, toxic int")
    for score, labels in ((toxicity.score_toxicity, "toxic"), (quality_knn.score_quality, "q")):
        one = sorted(map(str, score(docs, tables[1]).collect()))
        assert one == sorted(map(str, score(docs, other).collect())), labels


def test_language_on_held_out_rows(tables, corpus):
    truth = {i: lang for i, _, lang, _ in corpus[0][:900]}
    rows = language.identify_languages(tables[0]).collect()
    assert len(rows) == len(corpus[0])
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id in (1001, 1002, 1003):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    assert by_id[1004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_first_norm_leaves_weights_at_zero():
    rng = np.random.default_rng(0)
    rows = [
        (np.array([label, 5 + rng.integers(1000)]), np.array([0.9, 0.1]), label)
        for label in rng.integers(0, 2, 300)
    ]
    weights = language.train(rows, 2)
    assert (weights == 0).mean() > 0.9 and weights[0, 0] > 0 > weights[0, 1]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(4000, 3))
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert language.fit_temperature(scores * 4, labels) == pytest.approx(4, rel=0.25)


def test_quality_on_held_out_rows(tables, corpus):
    truth = {i: good for i, good, _ in corpus[1]}
    rows = quality_knn.score_quality(*tables).collect()
    assert len(rows) == len(corpus[0])
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    labelled = quality_knn._unit(rng.normal(size=(60, 6)))
    model = {
        "vectors": labelled,
        "labels": rng.integers(0, 2, 60).astype(float),
        "votes": rng.uniform(0.5, 2, 60),
    }
    queries = quality_knn._unit(rng.normal(size=(9, 6)))
    for query, got in zip(queries, quality_knn.vote(queries, model)):
        cosines = labelled @ query
        best = np.argsort(-cosines)[: quality_knn.NEIGHBOURS]
        weights = np.maximum(cosines[best], 1e-6) ** quality_knn.SHARPNESS * model["votes"][best]
        assert got == pytest.approx((weights * model["labels"][best]).sum() / weights.sum())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 1), (2, None, None)]])
def test_without_labels_or_with_one_kind(spark, labels):
    docs = spark.createDataFrame([(1, "a", "en", "s"), (2, None, None, None)], DOCS)
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 2
    assert quality_knn.score_quality(docs, labels).count() == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).collect() == []
    assert quality_knn.score_quality(docs, labels).collect() == []
    assert language.identify_languages(docs).collect() == []


def test_clashing_columns_are_left_aside(spark):
    docs = spark.createDataFrame(
        [(1, "the house", "en", 0.5, "x", True), (2, "der fluß", "de", 0.1, "y", False)],
        "doc_id bigint, text string, lang string, score double, label string, held_out boolean",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 2
    assert quality_knn.score_quality(docs, labels).count() == 2
    assert language.identify_languages(docs).count() == 2


def worded(seed, n=600):
    """Texts of one shape, whose words alone tell whether they are good or toxic."""
    rng = random.Random(seed)
    good = ["lemon", "cedar", "amber", "ivory", "olive"]
    bad = ["nolem", "racde", "merba", "royvi", "vileo"]
    docs, labels = [], []
    for i in range(n):
        label = i % 3 > 0
        words = [rng.choice(good if label else bad) for _ in range(30)]
        docs.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, int(label), int(not label)))
    return docs, labels


def test_quality_that_only_words_show(spark):
    docs, labels = worded(1)
    rows = quality_knn.score_quality(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    ).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([(r["score"] > 0.5) == truth[r["doc_id"]] for r in held]) > 0.97


def test_toxicity_where_every_row_is_labelled(spark):
    """No text is without a label: the sample of all texts still makes a classifier."""
    docs, labels = worded(2)
    rows = toxicity.score_toxicity(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    ).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["held_out"]]
    least = min(r["score"] for r in held if truth[r["doc_id"]])
    most = max(r["score"] for r in held if not truth[r["doc_id"]])
    assert least > most and least > 0.5


def test_rows_of_one_id_teach_their_own_language(spark):
    rows = [(3, "das haus", None), (3, "the house", "en"), (4, "der fluß", "de"), (4, "le fleuve", "fr")]
    rows += [(4, "le fleuve", "fr")] * 5 + [(6, None, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = df.where("lang IS NOT NULL").fillna("", ["text"])
    sample, counts = learning.sample_rows(known.select("doc_id", "lang", "text"), "lang", 100, 3)
    assert sorted(map(tuple, sample.collect())) == [
        (3, "en", "the house"), (4, "de", "der fluß"), (4, "fr", "le fleuve"), (6, "en", "")
    ]
    assert counts == {"en": 2, "de": 1, "fr": 6}


def test_predictions_equal_a_dense_computation(spark, corpus):
    """The scores of a fitted language model, from all buckets at once."""
    docs = [r for r in corpus[0] if r[1] and r[0] is not None][:200]
    model = language.fit(spark.createDataFrame(docs, DOCS))
    got = language.predict(spark.createDataFrame(docs, DOCS).repartition(3), model).collect()
    texts = {}
    for r in docs:
        texts.setdefault(r[0], []).append(r[1])
    for row in got:
        found = []
        for text in texts[row["doc_id"]]:
            counts = language.gram_counts(text)
            if counts is None:
                found.append(("und", 0.0))
                continue
            values = np.log1p(counts) * model["idf"]
            scores = values / np.linalg.norm(values) @ model["weights"] / model["temperature"]
            p = np.exp(scores - scores.max())
            p /= p.sum()
            found.append((model["languages"][int(p.argmax())], pytest.approx(p.max())))
        assert (row["lang_pred"], row["score"]) in found


def test_toxicity_scores_equal_a_plain_loop(spark):
    """The mean of the classifiers' chances, from features spelt out one by one."""
    models = [
        {"": -2.0, "grob*": 3.0, "flegel": 2.5}, {"": -1.0, "gro*": 1.5, "rowdy": 2.0, "row*": 0.5}
    ]
    texts = ["Ein Grobian und ein Flegel", "rowdy rowdy, rowdies", "ganz still", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, models, 0.1).collect()}
    for i, text in enumerate(texts):
        words = set(re.findall(r"\w+", (text or "").lower()))
        features = words | {w[:k] + "*" for w in words for k in range(3, 8) if len(w) > k}
        chances = [
            1 / (1 + np.exp(-(m[""] + sum(m.get(f, 0) for f in features if f) * toxicity.scale(len(words)))))
            for m in models
        ]
        assert got[i] == pytest.approx(np.mean(chances))


def test_equally_near_neighbours_vote_by_their_order():
    """More neighbours at one cosine than may vote: the first ones do, in any block."""
    near = quality_knn._unit(np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 5))
    model = {"vectors": near, "labels": np.array([0.0] * 10 + [1.0] * 35), "votes": np.ones(45)}
    queries = quality_knn._unit(np.array([[1.0, 0.2], [1.0, 0.1], [1.0, 0.0]]))
    together = quality_knn.vote(queries, model)
    assert together == pytest.approx([5 / 15] * 3)
    assert [quality_knn.vote(q[None], model)[0] for q in queries] == together.tolist()


def test_the_decomposition_equals_the_exact_one():
    rng = np.random.default_rng(3)
    matrix = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 500))).astype(np.float32)
    basis = quality_knn.decompose(matrix)
    _, _, exact = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(matrix @ basis @ basis.T, matrix, atol=1e-2)
    assert np.abs(np.abs(np.sum(basis[:, :5] * exact[:5].T, axis=0)) - 1).max() < 1e-3
