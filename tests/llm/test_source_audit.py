import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm import source_audit
from labelloom.llm.source_audit import Forest, audit_sources, count_terms, term_pieces

SCHEMA = "doc_id bigint, text string, lang string, source string, value string, term string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return ["".join(c.lower() if c < "\x80" else c for c in t) for t in TERM.findall(text)]


def by_hand(rows, min_docs=10):
    """The rows of the audit, term by term, in Python's whole numbers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = terms_of(text or "")
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(own):
            size = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (size + 2 * len(kept)) for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [
                (sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s
            ]
            top = [
                (f(ps[s][t], q[t]), t)
                for t in kept
                if counts[lang, s][t] and ps[s][t] > q[t]
            ]
            for part, found, limit in (("pair", pairs, None), ("term", top, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [
                    (lang, s, part, item, value, rank)
                    for rank, (value, item) in enumerate(found[:limit], 1)
                ]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i % 7, t, lang, s, "x", "y") for i, (t, lang, s) in enumerate(rows)], SCHEMA
    )


def corpus(seed, sources=9):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(120)] + ["Ab", "AB", "ß"]
    rows = []
    for k in range(400):
        lang = rng.choice(["en", "fr", None, ""])
        source = rng.choice([f"s{n}" for n in range(sources)] + [None, ""])
        shift = 5 * ord(source[1]) % 40 if source else 0
        text = " ".join(
            rng.choice(words[shift : shift + 60]) + rng.choice(["", ".", "7", "_"])
            for _ in range(rng.randrange(30))
        )
        rows.append((rng.choice([text, text, text, None, ""]), lang, source))
    rows += [("only here", "xx", "a"), (None, "xx", "b"), ("", "yy", "alone")]
    return rows + rows[:40]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_the_definition(spark, seed):
    rows = corpus(seed)
    assert got(audit_sources(frame(spark, rows))) == by_hand(rows)


def test_blocks_and_tiles_do_not_change_the_result(spark):
    rows = corpus(3)
    docs = frame(spark, rows).repartition(5)
    tiled = audit_sources(docs, min_docs=3, block_terms=16, tile=4)
    assert got(tiled) == by_hand(rows, min_docs=3)


def test_large_counts_stay_exact():
    sizes = [3 * 10**13, 5 * 10**13 + 1]
    counts = np.array([[10**13, 2 * 10**13, 0], [1, 5 * 10**13, 0]])
    forest = Forest(counts)
    tables = [source_audit.shares(forest.leaves, s, 3) for s in sizes]
    a, b, times = forest.leaf_pairs(0, 1)
    value = int((source_audit.distance(tables[0][a], tables[1][b]) * times).sum())
    want = 0
    for x, y in zip(*counts.tolist()):
        p, q = (1 + 10**9 * (c + 2) // (s + 6) for c, s in zip((x, y), sizes))
        want += (p - q) ** 2 // (p + q)
    assert value == want


def test_identical_subtrees_are_shared_and_priced_once():
    counts = np.zeros((5, 1024), dtype=np.int64)
    counts[3, 5], counts[4, 700] = 2, 2
    forest = Forest(counts)
    assert forest.roots[0] == forest.roots[1] == forest.roots[2]
    # The empty node of each level, and the path to the one count.
    assert all(len(left) <= 3 for left, _ in forest.levels)
    a, b, times = forest.leaf_pairs(3, 4)
    assert len(a) == 3 and times.sum() == 1024


@pytest.mark.parametrize("terms", [1, 2, 3, 100, 257])
def test_walking_two_trees_meets_every_term(terms):
    rng = np.random.default_rng(terms)
    counts = rng.integers(0, 4, (6, terms))
    forest = Forest(counts)
    for i in range(6):
        for j in range(6):
            a, b, times = forest.leaf_pairs(i, j)
            met = Counter()
            for x, y, n in zip(forest.leaves[a], forest.leaves[b], times):
                if x >= 0:
                    met[x, y] += n
            assert met == Counter(zip(counts[i].tolist(), counts[j].tolist()))


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    text = "ÀB cd, " * 300_000 + "x" * 2_500_000 + " Cd"
    lists = list(term_pieces(text.encode()))
    assert len(lists) > 2
    met = Counter(t.decode() for terms in lists for t in terms)
    assert met == Counter(terms_of(text))
    monkeypatch.setattr(source_audit, "HELD_TERMS", 3)
    rows = [(text, "en", "a"), ("cd a b c d", "en", "a"), ("cd", "en", "b")]
    found = {
        (r["source"], r["term"]): (r["count"], r["docs"])
        for r in count_terms(frame(spark, rows)).collect()
    }
    assert found["a", "cd"] == (met["cd"] + 1, 2)
    assert found["b", "cd"] == (1, 1)
    assert ("a", None) in found and ("b", None) in found


def test_empty_table(spark):
    assert audit_sources(frame(spark, corpus(1)).limit(0)).count() == 0
