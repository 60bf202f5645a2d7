"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op9_quality_ledger": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT rid, doc_id, w, len(w) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM w),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, n_words - 7)) AS i FROM m)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt, i + 8) - i)) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
f AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 3 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
      + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END AS fail_bits FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_upper AS BIGINT) AS n_upper,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(fail_bits AS BIGINT) AS fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
""",
    "op6_site_line_dedup": r"""
WITH h AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, n_chars, text, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT rid, source, unnest(list_distinct(list_filter(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM k GROUP BY source, line),
f AS (SELECT h.source, list(line) AS flagged FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n >= 5 AND n > CAST(0.1 AS DOUBLE) * n_pages GROUP BY h.source),
r AS (SELECT d.*, list_filter(l, lambda x: NOT list_contains(coalesce(flagged, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
      FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source, n_chars, len(l) AS n_lines, len(l) - len(kept) AS n_dropped FROM r
""",
    "op8_source_mixing": r"""
WITH t AS (SELECT doc_id, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
           CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books'
                WHEN regexp_matches(source, '^src1[5-8]$') THEN 'forums' ELSE 'other' END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(4 * sum(n_tokens) AS BIGINT) AS cap FROM t GROUP BY ALL),
root AS (SELECT CAST(least(floor(sum(supply) * 60 / 100.0), sum(cap)) AS BIGINT) AS budget FROM leaf),
d0 AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CAST(CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 30 WHEN 'forums' THEN 15 WHEN 'other' THEN 5 ELSE 1 END AS HUGEINT) AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, (SELECT budget FROM root) AS budget,
       coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM d0),
d2 AS (SELECT *, cap * after <= w * (budget - before) AS is_full FROM d1),
d3 AS (SELECT domain, CASE WHEN is_full THEN cap ELSE w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS budget FROM d2),
l0 AS (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap, CAST(CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 20 ELSE 1 END AS HUGEINT) AS w FROM leaf GROUP BY domain, lang),
l1 AS (SELECT l0.*, budget,
       coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / CAST(w AS DOUBLE), lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(w) OVER (PARTITION BY domain ORDER BY cap / CAST(w AS DOUBLE), lang NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM l0 JOIN d3 USING (domain)),
l2 AS (SELECT *, cap * after <= w * (budget - before) AS is_full FROM l1),
l3 AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain)) // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain) END AS budget FROM l2),
s0 AS (SELECT leaf.domain, leaf.lang, source, supply, CAST(cap AS HUGEINT) AS cap, CAST(CASE source WHEN 'src0' THEN 3 ELSE 1 END AS HUGEINT) AS w, budget FROM leaf JOIN l3 ON leaf.domain = l3.domain AND leaf.lang IS NOT DISTINCT FROM l3.lang),
s1 AS (SELECT *,
       coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / CAST(w AS DOUBLE), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / CAST(w AS DOUBLE), source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s0),
s2 AS (SELECT *, cap * after <= w * (budget - before) AS is_full FROM s1),
s3 AS (SELECT domain, lang, source, supply, CASE WHEN is_full THEN cap ELSE w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang)) // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang) END AS alloc FROM s2),
p AS (SELECT *, CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END AS epochs, alloc - CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END * supply AS rest FROM s3),
j AS (SELECT t.*, epochs, rest, md5('mix-1:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
      FROM t JOIN p ON t.domain = p.domain AND t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS cum FROM j)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
""",
    "op13_filter_audit": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
e AS (SELECT t, min(doc_id) AS earliest FROM t GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > earliest, false) AS e
      FROM w JOIN e USING (t) LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
m AS (SELECT part, filter_order, step, n, good, toxic, fails, substr(filter_order, step, 1) AS x,
             (SELECT min(strpos(filter_order, c)) FROM (SELECT unnest(string_split(fails, '')) AS c) WHERE fails <> '') AS gone FROM k, g),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone < step AND contains(fails, x) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
""",
}
