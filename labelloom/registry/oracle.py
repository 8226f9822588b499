"""SQL that computes the registered queries independently, for DuckDB."""

from __future__ import annotations

SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The test texts hold nothing that NFKC changes, so plain SQL can normalise them.


def _norm(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '{SPACE}', ' ', 'g'))"


PRIORITY = (
    "CASE subtype WHEN 'harmful' THEN 0 WHEN 'jailbreak' THEN 1 WHEN 'safe' THEN 2 "
    "ELSE 3 END"
)

RAW = """raw AS (
  SELECT d.doc_id::VARCHAR AS row_id, d.text AS prompt, d.source,
         CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS y,
         CASE WHEN l.toxic = 1 THEN 'jailbreak' ELSE 'safe' END AS subtype
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(d.text) > 0)"""

SOURCES = """raw AS (
  SELECT 'item-' || item_id AS row_id, text AS prompt, 'benchmark' AS source, 1 AS y,
         'harmful' AS subtype FROM benchmark WHERE length(text) > 0
  UNION ALL
  SELECT 'doc-' || d.doc_id, d.text, 'labelled',
         CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END,
         CASE WHEN l.toxic = 1 THEN 'jailbreak' ELSE 'safe' END
  FROM documents d JOIN labels l USING (doc_id) WHERE length(d.text) > 0
  UNION ALL
  SELECT 'doc-' || doc_id, text, 'unlabelled', 0, 'safe' FROM documents
  WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT 'turn-' || conv_id || '-' || turn, text, 'turns', 1, 'jailbreak'
  FROM conversations WHERE lower(role) = 'user' AND length(text) > 0
  UNION ALL
  SELECT 'lang-' || doc_id, text, 'languages', 1, coalesce(lang, 'None')
  FROM documents WHERE length(text) > 0)"""

NORMED = f"""normed AS (
  SELECT * FROM (SELECT *, {_norm('prompt')} AS prompt_norm,
                        {PRIORITY} AS priority FROM raw)
  WHERE length(prompt_norm) BETWEEN 5 AND 20000)"""

EXACT = """exact AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_norm ORDER BY priority, row_id) AS rn,
           count(*) OVER (PARTITION BY prompt_norm) AS copies,
           substr(sha256('42|near_dup|' || row_id), 1, 16) AS turn FROM normed)
  WHERE rn = 1)"""

SCORED = """scored AS (
  SELECT row_id, y, source, prompt, model, p AS y_prob, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM (
    SELECT d.doc_id AS row_id, l.toxic AS y, d.source, d.text AS prompt, m.model,
           floor((('0x' || substr(md5(m.model || '|' || d.doc_id), 1, 6))::BIGINT::DOUBLE
                  / 16777216::DOUBLE + m.pull * l.toxic) / (1::DOUBLE + m.pull) * 1000)
           / 1000::DOUBLE AS p
    FROM documents d JOIN labels l USING (doc_id)
    CROSS JOIN (VALUES ('m1', 0::DOUBLE), ('m2', 0.25::DOUBLE), ('m3', 0.5::DOUBLE),
                       ('m4', 0.75::DOUBLE)) AS m(model, pull)))"""

WHOLE_SCORES = """scored AS (
  SELECT y, m.model, (('0x' || substr(md5(m.model || '|' || row_id), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496::DOUBLE + m.pull * y) / (1::DOUBLE + m.pull) AS y_prob
  FROM raw CROSS JOIN (VALUES ('m1', 0::DOUBLE), ('m2', 0.25::DOUBLE), ('m3', 0.5::DOUBLE),
                              ('m4', 0.75::DOUBLE)) AS m(model, pull))"""

CONFUSION = """confusion AS (
  SELECT model, count(*) FILTER (y = 0 AND y_pred = 0) AS tn,
         count(*) FILTER (y = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (y = 1 AND y_pred = 0) AS fn,
         count(*) FILTER (y = 1 AND y_pred = 1) AS tp
  FROM scored GROUP BY model)"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif(({whole}), 0), 0)"


F1 = _ratio("2 * tp", "2 * tp + fp + fn")
FPR = _ratio("fp", "fp + tn")
FNR = _ratio("fn", "fn + tp")
PRECISION = _ratio("tp", "tp + fp")
RECALL = _ratio("tp", "tp + fn")
ACCURACY = _ratio("tn + tp", "tn + fp + fn + tp")

RANKING = """ranks AS (
  SELECT model, y, rank() OVER w + (count(*) OVER (PARTITION BY model, y_prob) - 1) / 2::DOUBLE AS r
  FROM scored WINDOW w AS (PARTITION BY model ORDER BY y_prob)),
roc AS (
  SELECT model, CASE WHEN min(y) < max(y) THEN
           (sum(r) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
           / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc
  FROM ranks GROUP BY model),
steps AS (
  SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
  FROM (SELECT model, y_prob, sum(y) AS pos, count(*) AS n FROM scored GROUP BY ALL)
  WINDOW w AS (PARTITION BY model ORDER BY y_prob DESC)),
pr AS (
  SELECT model, sum(pos * (tp::DOUBLE / seen)) / nullif(sum(pos), 0) AS auprc
  FROM steps GROUP BY model)"""

GRID = """grid AS (
  SELECT model, k::INTEGER AS k,
         count(*) FILTER (y = 0 AND y_prob < k * 0.005::DOUBLE) AS tn,
         count(*) FILTER (y = 0 AND y_prob >= k * 0.005::DOUBLE) AS fp,
         count(*) FILTER (y = 1 AND y_prob < k * 0.005::DOUBLE) AS fn,
         count(*) FILTER (y = 1 AND y_prob >= k * 0.005::DOUBLE) AS tp
  FROM scored CROSS JOIN range(201) AS t(k) GROUP BY ALL)"""

BEST = f"""best AS (
  SELECT model, coalesce(arg_max(k * 0.005::DOUBLE, (f1, -k)) , 0.5) AS threshold,
         coalesce(max(f1), 0) AS f1, coalesce(arg_max(fnr, (f1, -k)), 1) AS fnr
  FROM (SELECT DISTINCT model FROM grid) LEFT JOIN (
    SELECT * FROM (SELECT model, k, {F1} AS f1, {FPR} AS fpr, {FNR} AS fnr FROM grid)
    WHERE fpr <= 0.05 AND f1 > 0) USING (model)
  GROUP BY model)"""

# MinHash, as integer arithmetic over the code points.
SIGNATURES = """lanes AS (
  SELECT j, ('0x' || substr(md5('a1:' || j), 1, 8))::BIGINT // 2 * 2 + 1 AS a,
         ('0x' || substr(md5('b1:' || j), 1, 8))::BIGINT AS b
  FROM range(128) AS t(j)),
points AS (
  SELECT row_id, [ord(c)::BIGINT FOR c IN regexp_extract_all(prompt_norm, '(?s).')] AS p
  FROM {table}),
poly AS (
  SELECT DISTINCT row_id, unnest([
    ((((p[i] * 1000003 + p[i+1]) % 2147483647 * 1000003 + p[i+2]) % 2147483647
      * 1000003 + p[i+3]) % 2147483647 * 1000003 + p[i+4]) % 2147483647
    FOR i IN range(1, len(p) - 3)]) AS v FROM points),
mixed AS (
  SELECT row_id, (v * v % 2147483647) * (v * v % 2147483647) % 2147483647 * v
         % 2147483647 AS h FROM poly),
lows AS (
  SELECT row_id, j, min((a * h + b) & 4294967295) AS low FROM mixed CROSS JOIN lanes
  GROUP BY row_id, j),
signatures AS (
  SELECT row_id, list(low ORDER BY j) AS sig FROM lows GROUP BY row_id)"""

BUCKETS = (
    SIGNATURES.format(table="exact")
    + """,
buckets AS (
  SELECT priority, turn, row_id, band, sig[13 * band + 1 : 13 * band + 13] AS part
  FROM signatures JOIN exact USING (row_id) CROSS JOIN range(9) AS t(band))"""
)

PAIRS = """pairs AS (
  SELECT DISTINCT a.row_id AS earlier, b.row_id AS later
  FROM buckets a JOIN buckets b USING (band, part)
  WHERE (a.priority, a.turn, a.row_id) < (b.priority, b.turn, b.row_id))"""

SIMILAR = """
gram_lists AS (
  SELECT row_id, list_distinct([substr(prompt_norm, i, 5)
           FOR i IN range(1, length(prompt_norm) - 3)]) AS g
  FROM exact WHERE row_id IN (SELECT earlier FROM pairs UNION SELECT later FROM pairs)),
jaccards AS (
  SELECT earlier, later, len(list_intersect(a.g, b.g))::DOUBLE
         / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS jaccard
  FROM pairs JOIN gram_lists a ON a.row_id = earlier JOIN gram_lists b ON b.row_id = later)"""

# Every similar pair, without bands: two sets that share four fifths of their grams have one
# in common among the rarest fifth of each.
ALL_ALIKE = """numbered AS MATERIALIZED (
  SELECT row_id, regexp_extract_all(prompt_norm, '(?s).') AS c,
         row_number() OVER (ORDER BY priority, turn, row_id) AS place
  FROM exact),
points AS (SELECT place, unnest(c) AS p, generate_subscripts(c, 1) AS i FROM numbered),
grams AS (
  SELECT DISTINCT place, gram FROM (
    SELECT place, p || lead(p, 1) OVER w || lead(p, 2) OVER w || lead(p, 3) OVER w
                    || lead(p, 4) OVER w AS gram
    FROM points WINDOW w AS (PARTITION BY place ORDER BY i))
  WHERE gram IS NOT NULL),
sized AS MATERIALIZED (
  SELECT place, gram, count(*) OVER (PARTITION BY place) AS n,
         count(*) OVER (PARTITION BY gram) AS rows FROM grams),
rarest AS MATERIALIZED (
  SELECT place, n, gram FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY rows, gram) AS r FROM sized)
  WHERE r <= n - ceil(0.8 * n) + 1),
met AS MATERIALIZED (
  SELECT DISTINCT a.place AS earlier, b.place AS later, a.n + b.n AS total
  FROM rarest a JOIN rarest b ON a.gram = b.gram AND a.place < b.place
   AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
alike AS MATERIALIZED (
  SELECT x.row_id AS earlier, y.row_id AS later
  FROM (SELECT earlier, later, any_value(total) AS total, count(*) AS shared
        FROM met JOIN sized a ON a.place = earlier
        JOIN sized b ON b.place = later AND b.gram = a.gram GROUP BY earlier, later)
  JOIN numbered x ON x.place = earlier JOIN numbered y ON y.place = later
  WHERE shared::DOUBLE / (total - shared) >= 0.8)"""

WALK = """nodes AS (
  SELECT row_number() OVER (ORDER BY priority, turn, row_id) AS i, row_id, before
  FROM (SELECT later AS row_id, list(earlier) AS before FROM {pairs} GROUP BY later)
  JOIN exact USING (row_id)),
walk(i, dropped) AS (
  SELECT 0::BIGINT, []::VARCHAR[]
  UNION ALL
  SELECT nodes.i, CASE WHEN list_has_all(walk.dropped, before) THEN walk.dropped
                       ELSE list_append(walk.dropped, row_id) END
  FROM walk JOIN nodes ON nodes.i = walk.i + 1),
gone AS (SELECT unnest(dropped) AS row_id FROM walk WHERE i = (SELECT max(i) FROM walk))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)


def _order(seed: int, purpose: str) -> str:
    return f"sha256(concat_ws('|', '{seed}', '{purpose}', row_id::VARCHAR))"


def _quotas(sizes: str, total: str, name: str) -> str:
    """Largest-remainder shares of a total over (stratum, n)."""
    return f"""{name} AS (
  SELECT stratum, n, (fl + CASE WHEN row_number() OVER (ORDER BY share - fl DESC, stratum)
         <= total - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota
  FROM (SELECT *, floor(share) AS fl FROM (
    SELECT *, n::DOUBLE * total / sum(n) OVER () AS share FROM (
      SELECT *, {total} AS total FROM {sizes}))))"""


def _split(stratum: str) -> str:
    return ",\n".join(
        [
            f"keyed AS (SELECT *, {stratum} AS stratum FROM raw)",
            "sizes AS (SELECT stratum, count(*) AS n FROM keyed GROUP BY stratum)",
            _quotas("sizes", "ceil(sum(n) OVER () * 0.15::DOUBLE)", "test_quota"),
            "rest AS (SELECT stratum, n - quota AS n FROM test_quota)",
            _quotas(
                "rest", f"ceil(sum(n) OVER () * {0.15 / (1 - 0.15)!r}::DOUBLE)", "val_quota"
            ),
            f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_order(42, 'split')}) AS place
  FROM keyed)""",
            """split_rows AS (
  SELECT placed.* EXCLUDE (place), CASE WHEN place <= t.quota THEN 'test'
                        WHEN place <= t.quota + v.quota THEN 'val' ELSE 'train' END AS split
  FROM placed JOIN test_quota t USING (stratum) JOIN val_quota v USING (stratum))""",
        ]
    )


def _balance(table: str, name: str, ratio: float = 1.0) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (place, quota) FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_order(42, 'balance')}) AS place,
           (SELECT floor(least(count(*) FILTER (y = 1), count(*) FILTER (y = 0))
                         * {ratio}) FROM {table}) AS quota
    FROM {table}) WHERE place <= quota)"""


def _prevalence(table: str, name: str, frac: float) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (place, block, total) FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_order(42, 'prevalence')}) AS place,
           (SELECT round_even(count(*) * {frac}::DOUBLE, 0) FROM {table}) AS block,
           (SELECT count(*) FROM {table}) AS total
    FROM {table}) WHERE place <= CASE WHEN y = 1 THEN block ELSE total - block END)"""


def _folds(table: str, name: str, k: int = 5) -> str:
    """Rank ranges of the sizes that dealing the rows out in turn gives."""
    return f"""{name} AS (
  SELECT * EXCLUDE (place), (SELECT count(*) FROM range({k - 1}) AS t(f)
      WHERE place > (SELECT sum((n - (e.e - before) % {k} - CASE WHEN (e.e - before) % {k} < 0
             THEN {k} ELSE 0 END + {k - 1}) // {k}) FROM range({k}) AS e(e) WHERE e.e <= f))::INTEGER AS fold
  FROM (SELECT t.*, z.n, z.before, row_number() OVER (
          PARTITION BY t.stratum ORDER BY {_order(42, 'fold')}) AS place
        FROM (SELECT *, y || '_' || source AS stratum FROM {table}) t JOIN (
          SELECT stratum, n, sum(n) OVER (ORDER BY stratum) - n AS before FROM (
            SELECT y || '_' || source AS stratum, count(*) AS n FROM {table} GROUP BY 1)) z
        USING (stratum)))"""


def _fingerprint(table: str) -> str:
    word = (
        "('0x' || substr(sha256(concat_ws(chr(31), prompt, y::VARCHAR, source, subtype)),"
        " 1, 15))::BIGINT"
    )
    return (
        f"substr(sha256((SELECT concat_ws('|', count(*)::VARCHAR, sum({word})::VARCHAR, "
        f"bit_xor({word})::VARCHAR) FROM {table})), 1, 16)"
    )


MAKE_SPLITS = ",\n".join(
    [
        _split("y || '_' || source"),
        "train0 AS (SELECT * FROM split_rows WHERE split = 'train')",
        "test0 AS (SELECT * FROM split_rows WHERE split = 'test')",
        _balance("train0", "train1"),
        _prevalence("test0", "test1", 0.5),
        """made AS (SELECT row_id, y, split FROM train1 UNION ALL
  SELECT row_id, y, split FROM test1 UNION ALL
  SELECT row_id, y, split FROM split_rows WHERE split = 'val')""",
    ]
)

BUILT = ",\n".join([RAW, NORMED, EXACT, BUCKETS, PAIRS, WALK.format(pairs="pairs")])

FUNNEL = """left_over AS (
  SELECT * FROM exact WHERE row_id NOT IN (SELECT row_id FROM gone)),
funnel AS (
  SELECT * FROM (VALUES
    (0, 'raw_total', (SELECT count(*) FROM raw)),
    (1, 'dropped_length', (SELECT count(*) FROM raw) - (SELECT count(*) FROM normed)),
    (2, 'dropped_exact_dedup', (SELECT count(*) FROM normed) - (SELECT count(*) FROM exact)),
    (3, 'dropped_minhash_dedup', (SELECT count(*) FROM gone)),
    (4, 'dropped_leak_check', (SELECT count(*) FROM left_over l WHERE y = 0 AND EXISTS (
      SELECT 1 FROM left_over r WHERE r.y = 1 AND r.prompt_norm = l.prompt_norm))),
    (5, 'total_after_dedup', (SELECT count(*) FROM left_over l WHERE y = 1 OR NOT EXISTS (
      SELECT 1 FROM left_over r WHERE r.y = 1 AND r.prompt_norm = l.prompt_norm))))
  AS t(position, stage, n))"""

QUANTILES = ", ".join(
    f"round(quantile_cont(length(prompt), {q}), 6) AS p{p}"
    for q, p in ((0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95))
)

HISTOGRAM = """limits AS (
  SELECT y, min(length(prompt))::DOUBLE AS low,
         quantile_cont(length(prompt), 0.99) AS cap FROM raw GROUP BY y),
clipped AS (
  SELECT y, low, least(length(prompt), cap) AS x, max(least(length(prompt), cap))
         OVER (PARTITION BY y) AS top FROM raw JOIN limits USING (y)),
edges AS (
  SELECT DISTINCT y, i, low + i * ((top - low) / 50) AS low_edge,
         low + (i + 1) * ((top - low) / 50) AS high_edge
  FROM clipped CROSS JOIN range(50) AS t(i))"""

COMPARED = f"""SELECT model, round({F1}, 6) AS f1, round({PRECISION}, 6) AS precision,
  round({RECALL}, 6) AS recall, round({FPR}, 6) AS fpr, {FPR} <= 0.05 AS fpr_ok,
  round({FNR}, 6) AS fnr, {FNR} <= 0.10 AS fnr_ok, round(auroc, 6) AS auroc
FROM confusion JOIN roc USING (model)"""

TERMS = r"""words AS (
  SELECT row_id, regexp_extract_all(lower(prompt), '[\p{L}\p{M}\p{N}\p{Pc}]{2,}') AS w FROM raw),
terms AS (
  SELECT row_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT row_id, unnest([w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))]) FROM words)"""


EMBEDDED = """raw AS (
  SELECT vec_id AS row_id, (label < 5)::INTEGER AS y, 'embeddings' AS source, embedding
  FROM embeddings)"""

# Means and variances of the other folds, and the odds of each row by them.
NAIVE_BAYES = """entries AS (
  SELECT row_id, fold, y, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) AS dim FROM folded),
learned AS (
  SELECT f AS fold, y, dim, avg(x) AS mean,
         greatest(sum(x * x) / count(*) - avg(x) * avg(x), 1e-9) AS variance
  FROM entries JOIN range(5) AS t(f) ON fold <> f GROUP BY f, y, dim),
scored AS (
  SELECT e.row_id, e.fold AS model, any_value(e.y) AS y,
         1 / (1 + exp(-sum(CASE l.y WHEN 1 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END
             * (ln(l.variance) + (x - l.mean) * (x - l.mean) / l.variance)))) AS y_prob
  FROM entries e JOIN learned l ON e.fold = l.fold AND e.dim = l.dim
  GROUP BY e.row_id, e.fold)"""


def oracle_sql() -> dict[str, str]:
    scored = _with(SCORED)
    confusion = _with(SCORED, CONFUSION)
    raw = _with(RAW)
    exact = _with(RAW, NORMED, EXACT)
    all_sources = _with(SOURCES, NORMED, EXACT)
    conflicts = """conflicts AS (SELECT prompt_norm FROM normed GROUP BY prompt_norm
  HAVING min(y) = 0 AND max(y) = 1)"""
    return {
        "load_all_counts": f"{_with(SOURCES)} SELECT source, y, subtype, count(*) AS n FROM raw GROUP BY ALL",
        "load_staged_status": """SELECT 'whole' AS source, 'loaded' AS status, count(*) AS n
FROM documents WHERE length(text) > 0 UNION ALL SELECT 'broken', 'failed', 0""",
        "load_status": f"""{_with(SOURCES)} SELECT s.source, s.status, count(raw.source) AS n
FROM (VALUES ('benchmark', 'loaded'), ('labelled', 'loaded'), ('unlabelled', 'loaded'),
  ('turns', 'loaded'), ('languages', 'loaded'), ('absent', 'failed')) AS s(source, status)
LEFT JOIN raw ON raw.source = s.source GROUP BY ALL""",
        "normalized_texts": f"""SELECT doc_id, sha256({_norm('text')}) AS norm_hash,
  length({_norm('text')})::INTEGER AS norm_length, length(text)::INTEGER AS raw_length
FROM documents""",
        "text_measures": f"""WITH words AS (SELECT doc_id, text,
  [w FOR w IN regexp_split_to_array(text, '{SPACE}') IF w <> ''] AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS words, substr(text, 1, 120) AS preview,
  sha256(coalesce(array_to_string(w[1:512], ' '), '')) AS head_hash FROM words""",
        "ngram_counts": """SELECT doc_id, greatest(length(text) - 4, 0)::INTEGER AS n_grams,
  md5(coalesce(array_to_string([substr(text, i, 5) FOR i IN range(1, length(text) - 3)], '|'), ''))
  AS grams_md5 FROM documents""",
        "subtype_priorities": f"{_with(SOURCES)} SELECT subtype, {PRIORITY} AS priority, count(*) AS n FROM raw GROUP BY ALL",
        "unify_counts": f"{exact} SELECT source, y, count(*) AS n FROM exact GROUP BY ALL",
        "exact_dedup_rows": f"{exact} SELECT row_id, y, subtype, copies FROM exact",
        "exact_dedup_all_sources": f"{all_sources} SELECT row_id, source, y, subtype, copies FROM exact",
        "exact_dedup_prefer_label": f"""{_with(SOURCES, NORMED)} SELECT row_id, source, y, subtype FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_norm ORDER BY
    priority + CASE WHEN y = 1 THEN 0 ELSE 10 END, row_id) AS rn FROM normed) WHERE rn = 1""",
        "leak_rows": f"""{_with(SOURCES, NORMED, conflicts)} SELECT row_id, source, subtype FROM normed
WHERE y = 0 AND prompt_norm IN (SELECT prompt_norm FROM conflicts)""",
        "leak_free_counts": f"""{_with(SOURCES, NORMED, conflicts)} SELECT source, y, count(*) AS n FROM normed
WHERE y = 1 OR prompt_norm NOT IN (SELECT prompt_norm FROM conflicts) GROUP BY ALL""",
        "minhash_signatures": f"""{_with(RAW, NORMED, SIGNATURES.format(table='normed'))}
SELECT row_id, array_to_string(sig, ',') AS signature FROM signatures""",
        "lsh_first_neighbours": f"""{_with(RAW, NORMED, EXACT, BUCKETS)},
firsts AS (SELECT band, part, min((priority, row_id)) AS first FROM buckets GROUP BY ALL),
met AS (SELECT row_id, first, count(*) AS shared FROM buckets JOIN firsts USING (band, part)
  WHERE first < (priority, row_id) GROUP BY ALL)
SELECT row_id, min((first, shared))[1][2] AS neighbour_id, min((first, shared))[2] AS shared
FROM met GROUP BY row_id""",
        "near_dup_keep": f"""{_with(BUILT, recursive=True)}
SELECT row_id, source, y FROM exact WHERE row_id NOT IN (SELECT row_id FROM gone)""",
        "similar_keep": f"""{_with(RAW, NORMED, EXACT, ALL_ALIKE, WALK.format(pairs="alike"), recursive=True)}
SELECT row_id, source, y FROM exact WHERE row_id NOT IN (SELECT row_id FROM gone)""",
        "near_dup_keep_verified": f"""{_with(RAW, NORMED, EXACT, BUCKETS, PAIRS, SIMILAR,
  "alike AS (SELECT earlier, later FROM jaccards WHERE jaccard >= 0.8)",
  WALK.format(pairs="alike"), recursive=True)}
SELECT row_id, source, y FROM exact WHERE row_id NOT IN (SELECT row_id FROM gone)""",
        "near_dup_listing": f"""{_with(BUILT, SIMILAR, recursive=True)}
SELECT (min((e.priority, e.turn, e.row_id)))[3] AS kept_id, later AS dropped_id,
  round(arg_min(jaccard, (e.priority, e.turn, e.row_id)), 6) AS jaccard
FROM jaccards JOIN exact e ON e.row_id = earlier
WHERE later IN (SELECT row_id FROM gone) AND earlier NOT IN (SELECT row_id FROM gone)
GROUP BY later""",
        "stage_funnel": f"{_with(BUILT, FUNNEL, recursive=True)} SELECT * FROM funnel",
        "build_statistics": f"""{_with(BUILT, FUNNEL, recursive=True)},
kept AS (SELECT * FROM exact WHERE row_id NOT IN (SELECT row_id FROM gone)),
q AS (SELECT {QUANTILES} FROM kept)
SELECT stage, 'rows' AS key, n::DOUBLE AS value FROM funnel
UNION ALL SELECT 'per_source', source || '/' || y, count(*)::DOUBLE FROM kept GROUP BY source, y
UNION ALL SELECT 'per_label', y::VARCHAR, count(*)::DOUBLE FROM kept GROUP BY y
UNION ALL SELECT 'length_quantiles', name, v FROM (UNPIVOT q ON p25, p50, p75, p95 INTO NAME name VALUE v)""",
        "label_counts": f"{raw} SELECT y, count(*) AS n FROM raw GROUP BY y",
        "source_pivot": f"""{raw} SELECT source, count(*) FILTER (y = 0) AS safe,
  count(*) FILTER (y = 1) AS block FROM raw GROUP BY source""",
        "length_quantiles": f"{exact} SELECT {QUANTILES} FROM exact",
        "length_histogram": f"""{_with(RAW, HISTOGRAM)}
SELECT edges.y, i AS bin, round(low_edge, 6) AS low, round(high_edge, 6) AS high, count(x) AS n
FROM edges LEFT JOIN clipped ON clipped.y = edges.y
 AND (x >= low_edge OR i = 0) AND (x < high_edge OR i = 49) GROUP BY ALL""",
        "word_describe": f"""{raw}, words AS (SELECT y, len(
  [w FOR w IN regexp_split_to_array(prompt, '{SPACE}') IF w <> ''])::INTEGER AS w FROM raw)
SELECT y, count(*) AS count, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std,
  min(w) AS min, round(quantile_cont(w, 0.25), 6) AS p25, round(quantile_cont(w, 0.5), 6) AS p50,
  round(quantile_cont(w, 0.75), 6) AS p75, max(w) AS max FROM words GROUP BY y""",
        "content_fingerprint": f"{raw} SELECT {_fingerprint('raw')} AS content_hash",
        "length_sketches": f"""{raw} SELECT source, y, count(*) AS n, true AS near FROM raw
GROUP BY source, y""",
        "stored_digests": f"""{raw}, left_over AS (SELECT * FROM raw WHERE source <> 'src3')
SELECT {_fingerprint('left_over')} AS content_hash""",
        "top_long": f"""{raw} SELECT row_id, source, length(prompt)::INTEGER AS char_len FROM raw
WHERE y = 1 AND length(prompt) > 3000 ORDER BY char_len DESC, row_id LIMIT 10""",
        "long_count": f"{raw} SELECT count(*) AS n FROM raw WHERE y = 1 AND length(prompt) > 3000",
        "source_preview": f"""{raw} SELECT row_id, source, substr(prompt, 1, 200) AS preview FROM raw
WHERE source = 'src3' ORDER BY row_id LIMIT 5""",
        "split_assign": f"{_with(RAW, _split('y::VARCHAR'))} SELECT row_id, y, split FROM split_rows",
        "split_by_source": f"""{_with(SOURCES, _split("y || '_' || source"))}
SELECT row_id, stratum, split FROM split_rows""",
        "split_counts": f"""{_with(SOURCES, MAKE_SPLITS)} SELECT split, count(*) AS n,
  count(*) FILTER (y = 1) AS block, count(*) FILTER (y = 0) AS safe FROM made GROUP BY split""",
        "split_manifest": f"""{_with(SOURCES, MAKE_SPLITS)} SELECT {_fingerprint('raw')} AS content_hash,
  42 AS seed, 0.15::DOUBLE AS test_frac, 0.15::DOUBLE AS val_frac, 0.5::DOUBLE AS block_frac,
  1::DOUBLE AS ratio, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'train' AND y = 1) AS train_block,
  count(*) FILTER (split = 'train' AND y = 0) AS train_safe,
  count(*) FILTER (split = 'test' AND y = 1) AS test_block,
  count(*) FILTER (split = 'test' AND y = 0) AS test_safe FROM made""",
        "balanced_rows": f"{_with(RAW, _balance('raw', 'kept'))} SELECT row_id, y FROM kept",
        "prevalence_rows": f"{_with(RAW, _prevalence('raw', 'kept', 0.02))} SELECT row_id, y FROM kept",
        "prevalence_achieved": f"""{_with(RAW, _prevalence('raw', 'kept', 0.5))} SELECT count(*) AS n,
  count(*) FILTER (y = 1) AS block, round(count(*) FILTER (y = 1)::DOUBLE / count(*), 6) AS block_frac
FROM kept""",
        "fold_assign": f"{_with(RAW, _folds('raw', 'folded'))} SELECT row_id, stratum, fold FROM folded",
        "fold_train_balanced": f"""{_with(RAW, _folds('raw', 'folded'))},
outside AS (
  SELECT f AS of_fold, y, count(*) AS n FROM folded JOIN range(5) AS t(f) ON fold <> f GROUP BY ALL)
SELECT of_fold::INTEGER AS of_fold, 'train' AS part, y, least(n, min(n) OVER (PARTITION BY of_fold)) AS n FROM outside
UNION ALL SELECT fold, 'validation', y, count(*) FROM folded GROUP BY fold, y""",
        "sample_n": f"{raw} SELECT row_id, source FROM raw ORDER BY {_order(7, 'sample')} LIMIT 50",
        "sample_fraction": f"""{raw} SELECT row_id, source FROM raw
QUALIFY row_number() OVER (ORDER BY {_order(42, 'sample')})
  <= (SELECT round_even(count(*) * 0.1::DOUBLE, 0) FROM raw)""",
        "cv_subsample": f"""{_with(RAW,
  "keyed AS (SELECT *, y || '_' || source AS stratum FROM raw)",
  "sizes AS (SELECT stratum, count(*) AS n FROM keyed GROUP BY stratum)",
  _quotas('sizes', 'round_even(sum(n) OVER () * 0.15::DOUBLE, 0)', 'quotas'))}
SELECT row_id, stratum FROM keyed JOIN quotas USING (stratum)
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_order(42, 'subsample')}) <= quota""",
        "shuffled_rows": f"{raw} SELECT row_id, y FROM raw ORDER BY {_order(42, 'shuffle')}, row_id",
        "confusion_counts": f"{confusion} SELECT model, tn, fp, fn, tp FROM confusion",
        "rate_metrics": f"""{confusion} SELECT model, round({F1}, 6) AS f1,
  round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall,
  round({ACCURACY}, 6) AS accuracy, round({FPR}, 6) AS fpr, round({FNR}, 6) AS fnr FROM confusion""",
        "ranking_by_model": f"""{_with(SCORED, RANKING)} SELECT model, round(auroc, 6) AS auroc,
  round(auprc, 6) AS auprc FROM roc JOIN pr USING (model)""",
        "ranking_exact_scores": f"""{_with(RAW, WHOLE_SCORES, RANKING)} SELECT model,
  round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM roc JOIN pr USING (model)""",
        "threshold_scan": f"""{_with(SCORED, GRID, BEST)} SELECT model, round(threshold, 6) AS threshold,
  round(f1, 6) AS f1, round(fnr, 6) AS fnr FROM best""",
        "threshold_table": f"{_with(SCORED, GRID)} SELECT * FROM grid",
        "per_source_by_model": f"""{scored}, c AS (
  SELECT model, source, count(*) AS n, count(*) FILTER (y = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (y = 0 AND y_pred = 1) AS fp, count(*) FILTER (y = 1 AND y_pred = 0) AS fn,
    count(*) FILTER (y = 1 AND y_pred = 1) AS tp FROM scored GROUP BY model, source)
SELECT model, source, n, round({F1}, 6) AS f1, round({FPR}, 6) AS fpr, round({FNR}, 6) AS fnr FROM c""",
        "report": f"""{_with(SCORED, CONFUSION, RANKING, GRID, BEST)} SELECT model, round({F1}, 6) AS f1,
  round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall,
  round({ACCURACY}, 6) AS accuracy, round({FPR}, 6) AS fpr, round({FNR}, 6) AS fnr,
  round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, tp, fp, tn, fn,
  round(threshold, 6) AS threshold, {FPR} <= 0.05 AS fpr_ok, {FNR} <= 0.10 AS fnr_ok
FROM confusion JOIN roc USING (model) JOIN pr USING (model)
JOIN (SELECT model, threshold FROM best) USING (model)""",
        "model_comparison": f"{_with(SCORED, CONFUSION, RANKING)} {COMPARED}",
        "comparison_series": f"""{_with(SCORED, CONFUSION, RANKING)}, c AS ({COMPARED})
SELECT 'f1' AS metric, model, f1 AS value, NULL::DOUBLE AS target FROM c
UNION ALL SELECT 'fpr', model, fpr, 0.05 FROM c UNION ALL SELECT 'fnr', model, fnr, 0.1 FROM c""",
        "error_rows": f"""{scored} SELECT row_id, y, y_pred, round_even(y_prob, 3) AS p,
  substr(prompt, 1, 120) AS preview FROM (SELECT * FROM scored WHERE model = 'm3'
  ORDER BY {_order(7, 'sample')} LIMIT 50) WHERE y <> y_pred""",
        "scored_texts": f"""{raw} SELECT row_id, y, (length(prompt) % 97 >= 48)::INTEGER AS y_pred,
  round(length(prompt) % 97 / 96::DOUBLE, 6) AS y_prob FROM raw""",
        "evaluate_scorer": f"""{raw}, scored AS (SELECT 'length' AS model, y,
  (length(prompt) % 97 >= 48)::INTEGER AS y_pred, length(prompt) % 97 / 96::DOUBLE AS y_prob FROM raw),
{CONFUSION},
{RANKING} SELECT model, tp, fp, tn, fn, round({F1}, 6) AS f1, round(auroc, 6) AS auroc
FROM confusion JOIN roc USING (model)""",
        "stored_source_metrics": f"""{raw}, counts AS (
  SELECT source, count(*) AS n,
         count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp,
         count(*) FILTER (y = 1 AND NOT p) AS fn, count(*) FILTER (y = 1 AND p) AS tp
  FROM (SELECT *, length(prompt) % 97 >= 48 AS p FROM raw) GROUP BY source)
SELECT 'length' AS model, source, n, round({F1}, 6) AS f1, round({FPR}, 6) AS fpr,
  round({FNR}, 6) AS fnr FROM counts""",
        "committed_runs": f"""{raw}, scored AS (
  SELECT y, source, (length(prompt) % 97 >= 48)::INTEGER AS y_pred FROM raw)
SELECT 'length' AS model, count(*) FILTER (y = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (y = 0 AND y_pred = 1) AS fp, count(*) FILTER (y = 0 AND y_pred = 0) AS tn,
  count(*) FILTER (y = 1 AND y_pred = 0) AS fn, count(*) AS rows,
  count(DISTINCT source) AS sources FROM scored""",
        "external_scores": f"""{raw}, counts AS (
  SELECT count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp,
         count(*) FILTER (y = 1 AND NOT p) AS fn, count(*) FILTER (y = 1 AND p) AS tp
  FROM (SELECT *, length(prompt) % 97 >= 48 AS p FROM raw))
SELECT tn, fp, fn, tp, round({F1}, 6) AS f1, round({ACCURACY}, 6) AS accuracy FROM counts""",
        "saved_splits_manifest": f"""{_with(SOURCES, MAKE_SPLITS)}, counts AS (
  SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
         count(*) FILTER (split = 'test') AS test FROM made)
SELECT {_fingerprint('raw')} AS content_hash, train, val, test,
  train AS n_train, val AS n_val, test AS n_test FROM counts""",
        "report_files": f"{confusion} SELECT model, tn, fp, fn, tp FROM confusion",
        "report_documents": f"""{confusion} SELECT '{{"model":"' || model || '","tn":' || tn || ',"fp":' || fp
  || ',"fn":' || fn || ',"tp":' || tp || '}}' AS document FROM confusion""",
        "tfidf_terms": f"""{_with(RAW, TERMS)},
counts AS (SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df FROM terms GROUP BY term)
SELECT term, tf, df, round(ln(((SELECT count(*) FROM raw) + 1)::DOUBLE / (df + 1)) + 1, 6) AS idf
FROM counts WHERE df >= 3 ORDER BY tf DESC, term LIMIT 200000""",
        "tfidf_vectors": f"""{_with(RAW, TERMS)},
counts AS (SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df FROM terms GROUP BY term),
vocabulary AS (
  SELECT term, ln(((SELECT count(*) FROM raw) + 1)::DOUBLE / (df + 1)) + 1 AS idf
  FROM counts WHERE df >= 3 ORDER BY tf DESC, term LIMIT 2000),
entries AS (
  SELECT row_id, term, (1 + ln(count(*))) * any_value(idf) AS w
  FROM terms JOIN vocabulary USING (term) GROUP BY row_id, term)
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight
FROM entries""",
        "logistic_saturated": """WITH t AS (
  SELECT coalesce(lang, '') AS lang, coalesce((toxic = 1)::INTEGER, 0) AS y
  FROM documents LEFT JOIN labels USING (doc_id)),
shares AS (
  SELECT lang, sum(y)::DOUBLE / (SELECT sum(y) FROM t) AS ones,
         sum(1 - y)::DOUBLE / (SELECT sum(1 - y) FROM t) AS zeros FROM t GROUP BY lang)
SELECT lang, round(ones / (ones + zeros), 3) AS p FROM shares""",
        "cv_closed_form": f"""{_with(EMBEDDED, _folds('raw', 'folded'), NAIVE_BAYES)},
counts AS (
  SELECT model AS fold, count(*) FILTER (y = 1 AND y_prob >= 0.5) AS tp,
         count(*) FILTER (y = 0 AND y_prob >= 0.5) AS fp,
         count(*) FILTER (y = 0 AND y_prob < 0.5) AS tn,
         count(*) FILTER (y = 1 AND y_prob < 0.5) AS fn FROM scored GROUP BY model),
{RANKING}
SELECT fold, tp, fp, tn, fn, round({F1}, 6) AS f1, round(auroc, 6) AS auroc
FROM counts JOIN roc ON fold = model""",
        "embed_cache": f"""{raw} SELECT row_id, length(prompt)::BIGINT AS chars,
  (length(prompt) - length(replace(prompt, ' ', '')))::BIGINT AS spaces,
  (length(prompt) - length(replace(prompt, 'e', '')))::BIGINT AS letter_e FROM raw""",
        "embed_reuse": f"""{raw} SELECT 1 AS run, count(DISTINCT prompt) FILTER (y = 1) AS encoded FROM raw
UNION ALL SELECT 2, count(DISTINCT prompt) - count(DISTINCT prompt) FILTER (y = 1) FROM raw
UNION ALL SELECT 3, 0""",
        "class_weights": f"""{raw} SELECT y, round((SELECT count(*) FROM raw)::DOUBLE / (2 * count(*)), 6) AS weight
FROM raw GROUP BY y""",
    }
