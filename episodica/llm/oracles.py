"""The corpus queries written directly in SQL, for comparison on small tables."""

from __future__ import annotations

from episodica.llm import quality, warc

_WORDS = r"'[^\x20\x09-\x0D]+'"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_sql() -> str:
    words = ", ".join(f"'{w}'" for w in quality.WORDS)
    langs = ", ".join(f"'{x}'" for x in quality.LANGUAGES)
    out = lambda p: f"length(t) - length(regexp_replace(t, '{p}+', '', 'g'))"
    marks = quality.CLASSES["mark"].replace("'", "''")
    space = r"[ \t-\r]"
    return rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                      list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'), lambda x: list_contains([{words}], x)) AS known
               FROM documents),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
    twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
    c AS (SELECT *, {out('[a-z]')} AS lo, {out('[A-Z]')} AS up, {out(chr(92) + 'p{L}')} AS letters, {out('[0-9]')} AS digits, {out(space)} AS spaces, {out(marks)} AS marks
          FROM d),
    h AS (SELECT doc_id, lang, 'class' AS kind, unnest([lo, up, letters - lo - up, digits, spaces, marks, length(t) - letters - digits - spaces - marks]) AS n,
                 unnest(range(1, 8)) AS k FROM c
          UNION ALL SELECT doc_id, lang, 'word', unnest(list_transform([{words}], lambda y: len(list_filter(known, lambda x: x = y)))), unnest(range(1, {len(quality.WORDS) + 1})) FROM c),
    sums AS (SELECT lang, kind, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, kind) AS total FROM h WHERE lang IN ({langs}) GROUP BY 1, 2, 3),
    refs AS (SELECT lang, kind, k, n / total AS q FROM sums
             WHERE lang IN (SELECT lang FROM sums GROUP BY 1 HAVING min(total) > 0)),
    p AS (SELECT doc_id, kind, k, n, sum(n) OVER (PARTITION BY doc_id, kind) AS total FROM h),
    terms AS (SELECT doc_id, p.kind, lang, total, n / total AS p, q, (n / total + q) / 2 AS m FROM p JOIN refs r ON r.kind = p.kind AND r.k = p.k),
    dist AS (SELECT doc_id, kind, lang, CASE WHEN any_value(total) = 0 THEN 1.0 ELSE
               sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 0)) END AS x
             FROM terms GROUP BY 1, 2, 3),
    near AS (SELECT doc_id, round(min(x) FILTER (kind = 'class'), 4) AS class_distance, round(min(x) FILTER (kind = 'word'), 4) AS word_distance FROM dist GROUP BY 1),
    f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 coalesce(lang IN ({langs}), TRUE) AND 2 * (letters - lo - up) <= letters AS judged,
                 CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, coalesce(class_distance, 0.0) AS class_distance, coalesce(word_distance, 0.0) AS word_distance
          FROM c d LEFT JOIN covered v ON v.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id),
    b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR judged AND (n_words >= {quality.CLASS_WORDS} AND class_distance > {quality.CLASS_DISTANCE}
                OR n_words >= {quality.COMMON_WORDS_NEEDED} AND word_distance > {quality.WORD_DISTANCE})) AS kept, class_distance, word_distance
    FROM b
    """


def jaccard_sql(size: int = 3, percent: int = 90) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), {_WORDS}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE {shingle} END AS g
          FROM d, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) u(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON b.g = a.g AND b.doc_id <> a.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) m ON m.a = d.doc_id
    """


def divergence_sql(least: int = 10, top: int = 10) -> str:
    p = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v.kept)"
    f = "(x.p - {q}) * (x.p - {q}) // (x.p + {q})"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_CAPITALS}', '{_CAPITALS.lower()}') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {least}),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
    v AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM k GROUP BY 1),
    g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s
          LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY 1, 2),
    x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", total="g.total")} AS p, {p.format(n="k.n", total="v.total")} AS q
          FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum({f.format(q="y.p")}), 0) AS value
          FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source
          LEFT JOIN x y ON y.lang = g.lang AND y.source = h.source AND y.term = x.term GROUP BY 1, 2, 3, 4
          UNION ALL SELECT lang, source, 'term', term, {f.format(q="x.q")} FROM x WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM r QUALIFY part = 'pair' OR rank <= {top}
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op1_distribution_quality": quality_sql(),
        "op3_ngram_jaccard": jaccard_sql(),
        "op11_source_divergence": divergence_sql(),
        "op6_revisit_resolution": warc.RESOLVED_SQL,
    }
