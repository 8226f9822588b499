"""The same results as DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), ranked AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (
                       PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept,
               sha256(norm) AS text_sha256
        FROM ranked
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), placed AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n
            FROM t
        ), pairs_of_words AS (
            SELECT doc_id, n, word,
                   lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS next
            FROM placed
        ), sets AS (
            SELECT DISTINCT doc_id, word || ' ' || coalesce(next, '') AS shingle
            FROM pairs_of_words WHERE next IS NOT NULL OR n = 1
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
        ), sized AS (
            SELECT doc_id, n, shingle FROM sets JOIN sizes USING (doc_id)
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total,
                   count(*) AS shared
            FROM sized a JOIN sized b
              ON a.shingle = b.shingle AND a.doc_id < b.doc_id
             AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT a, b FROM common WHERE 100 * shared >= 80 * (total - shared)
            UNION ALL
            SELECT b, a FROM common WHERE 100 * shared >= 80 * (total - shared)
        ), reach AS (
            SELECT doc_id AS id, doc_id AS seen FROM documents
            UNION
            SELECT reach.id, links.b FROM reach JOIN links ON reach.seen = links.a
        ), least AS (
            SELECT id AS doc_id, min(seen) AS component_id FROM reach GROUP BY id
        )
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
               doc_id = component_id AS kept
        FROM least LEFT JOIN sizes USING (doc_id)
    """,
    "op6_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://')
                        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), u AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                   ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        )
        SELECT u.page_id, u.host, u.path, best.rule,
               coalesce(best.verdict, 'allow') AS verdict
        FROM u LEFT JOIN LATERAL (
            SELECT rule_host || rule_path AS rule, verdict
            FROM rules
            WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host))
              AND starts_with(u.path, rule_path)
            ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC
            LIMIT 1
        ) best ON true
    """,
    "op8_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(doc_id::VARCHAR) AS h,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT
                       AS size
            FROM documents
        ), totals AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), ranked AS (
            SELECT source, source_size, 2 * source_size AS cap,
                   [5.0, 2.0, 1.0][1 + (rank - 1) % 3]::DOUBLE AS weight
            FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank
                  FROM totals)
        ), levels AS (
            -- The candidates for the set of limited sources: all below a ratio.
            SELECT a.cap / a.weight AS ratio,
                   1.5 * (SELECT sum(source_size) FROM ranked)
                     - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)
                     AS rest,
                   sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS left_over
            FROM ranked a CROSS JOIN ranked b
            GROUP BY a.source, a.cap, a.weight
        ), chosen AS (
            SELECT ratio, rest, left_over FROM levels
            WHERE rest / left_over <= ratio ORDER BY ratio LIMIT 1
        ), targets AS (
            SELECT source, source_size,
                   CASE WHEN cap / weight < (SELECT ratio FROM chosen) THEN cap::DOUBLE
                        ELSE weight * (SELECT rest FROM chosen)::DOUBLE
                             / (SELECT left_over FROM chosen) END AS target
            FROM ranked
        ), placed AS (
            SELECT doc_id, size, source_size, target,
                   coalesce(sum(size) OVER (
                       PARTITION BY s.source ORDER BY h, doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     + size / 2.0 AS middle
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (size * ((middle < target)::BIGINT
                        + (source_size + middle < target)::BIGINT))::BIGINT AS taken
        FROM placed
    """,
    "op10_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), placed AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t
        ), grams AS (
            SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o,
                       lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
                       lead(word, 5) OVER o, lead(word, 6) OVER o) AS gram,
                   lead(word, 7) OVER o AS last
            FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram, last) AS n
            FROM grams WHERE last IS NOT NULL
        ), covered AS (
            SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
                  FROM windows WHERE n > 1)
            GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
            GROUP BY doc_id
        ), m AS (
            SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words,
                   length(array_to_string(w, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   coalesce(n_lines, 0)::BIGINT AS n_lines,
                   coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
                   coalesce(covered.n, 0)::BIGINT AS n_repeat_words
            FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
        ), base AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
            FROM m
        ), long AS (
            SELECT doc_id, lang, source, base_failed, r.rule, r.value, r.spread
            FROM (SELECT *, unnest([
                {'rule': 'symbols', 'spread': 50,
                 'value': 1000 * n_symbols // greatest(n_words, 1)},
                {'rule': 'repeats', 'spread': 50,
                 'value': 1000 * n_repeat_words // greatest(n_words, 1)},
                {'rule': 'dup_lines', 'spread': 50,
                 'value': 1000 * n_dup_lines // greatest(n_lines, 1)},
                {'rule': 'word_length', 'spread': 100,
                 'value': 100 * word_chars // greatest(n_words, 1)}]) AS r
                  FROM base)
        ), binned AS (
            SELECT lang, source, rule, spread,
                   (value >> shift) << shift AS start
            FROM (SELECT *, greatest(length(bin(value)) - 6, 0) AS shift FROM long
                  WHERE NOT base_failed)
        ), own AS (
            SELECT lang, source, rule, any_value(spread) AS spread, start, count(*) AS n
            FROM binned GROUP BY lang, source, rule, start
        ), every AS (
            SELECT rule, start, sum(n) AS n FROM own GROUP BY rule, start
        ), every_upto AS (
            SELECT rule, start, sum(n) OVER (PARTITION BY rule ORDER BY start) AS upto,
                   sum(n) OVER (PARTITION BY rule) AS rows
            FROM every
        ), lang_upto AS (
            -- Rows of each language up to every bin that occurs anywhere.
            SELECT l.lang, e.rule, e.start,
                   coalesce(sum(o.n) FILTER (o.start <= e.start), 0) AS upto,
                   sum(o.n) AS rows, any_value(e.upto) AS every_upto,
                   any_value(e.rows) AS every_rows
            FROM (SELECT DISTINCT lang FROM own) l CROSS JOIN every_upto e
            JOIN own o ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = e.rule
            GROUP BY l.lang, e.rule, e.start
        ), inherited AS (
            -- The language's rows and 200 more distributed as the corpus, times `unit`.
            SELECT lang, rule, start, (rows + 200)::HUGEINT * every_rows AS unit,
                   upto::HUGEINT * every_rows + 200::HUGEINT * every_upto AS upto
            FROM lang_upto
        ), pooled AS (
            -- The source's rows and 200 more distributed as those, times `unit`.
            SELECT g.lang, g.source, g.rule, any_value(g.spread) AS spread, i.start,
                   any_value(i.unit) AS unit, sum(g.n) + 200 AS rows,
                   coalesce(sum(g.n) FILTER (g.start <= i.start), 0) * any_value(i.unit)
                     + 200 * any_value(i.upto) AS upto
            FROM own g JOIN inherited i
              ON g.lang IS NOT DISTINCT FROM i.lang AND g.rule = i.rule
            GROUP BY g.lang, g.source, g.rule, i.start
        ), limits AS (
            SELECT lang, source, rule, any_value(spread) AS spread,
                   min(start) FILTER (100 * upto >= 25 * rows * unit) AS a,
                   min(start) FILTER (100 * upto >= 75 * rows * unit) AS b
            FROM pooled GROUP BY lang, source, rule
        ), outside AS (
            SELECT DISTINCT doc_id FROM long
            JOIN limits ON long.lang IS NOT DISTINCT FROM limits.lang
                AND long.source IS NOT DISTINCT FROM limits.source
                AND long.rule = limits.rule
            WHERE value > b + 3 * greatest(b - a, limits.spread)
               OR (long.rule = 'word_length' AND value < a - 3 * greatest(b - a, limits.spread))
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               base_failed,
               NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
        FROM base
    """,
    "op12_source_audit": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), placed AS (
            SELECT r, lang, source, unnest(w) AS term FROM t
        ), kept AS (
            SELECT lang, term, count(*) AS total FROM placed
            GROUP BY lang, term HAVING count(DISTINCT r) >= 10
        ), langs AS (
            SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
        ), every AS (
            SELECT DISTINCT lang, source FROM t
        ), counts AS (
            SELECT lang, source, term, count(*) AS c
            FROM placed JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), sizes AS (
            SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source
        ), priced AS (
            SELECT every.lang, every.source, kept.term, coalesce(c, 0) AS c,
                   1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2))
                       // (coalesce(sizes.n, 0) + 2 * v) AS p,
                   1 + (1000000000::HUGEINT * (total + 2)) // (langs.n + 2 * v) AS q
            FROM every JOIN kept USING (lang) JOIN langs USING (lang)
            LEFT JOIN sizes USING (lang, source)
            LEFT JOIN counts USING (lang, source, term)
        ), distances AS (
            SELECT a.lang, a.source, b.source AS item,
                   sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM priced a JOIN priced b
              ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), rows_of AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   coalesce(value, 0)::BIGINT AS value
            FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN distances d
              ON a.lang = d.lang AND a.source = d.source AND b.source = d.item
            UNION ALL
            SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
            FROM priced WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
            FROM rows_of
        )
        SELECT lang, source, part, item, value, rank FROM ranked
        WHERE part = 'pair' OR rank <= 10
    """,
    "op13_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents
        ), drawn AS (
            SELECT doc_id, text, lines, len(lines) AS n,
                   ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS first,
                   ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS second,
                   ('0x' || substr(h, 17, 8))::BIGINT % 100 AS rate,
                   ('0x' || substr(h, 25, 8))::BIGINT % 100 AS share
            FROM t
        ), cut AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR rate >= 100 OR contains(text, '<P>')
                             OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                        WHEN share < 50 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(lines[1:least(first, second)], '') AS prefix,
                   array_to_string(
                       lines[least(first, second) + 1:greatest(first, second)], '') AS middle,
                   array_to_string(lines[greatest(first, second) + 1:], '') AS suffix
            FROM drawn
        )
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END)
                   AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut
    """,
}
