"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

from __future__ import annotations

_DAY = "CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(date AS DATE) END"
_NAME = r"strip_accents(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')))"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_CLEAN = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_TERMS = (
    f"w AS (SELECT article_id AS id, unnest({_WORDS.format('text')}) AS term FROM articles WHERE text IS NOT NULL), "
    "wn AS (SELECT count(text) AS total FROM articles), cn AS (SELECT count(category) AS total FROM articles), "
    f"c AS (SELECT {_NAME.format('category')} AS term FROM articles WHERE category IS NOT NULL), "
    "t AS (SELECT 'text' AS field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM w GROUP BY term "
    "UNION ALL SELECT 'category', term, count(*), count(*) FROM c GROUP BY term), "
    "m AS (SELECT t.*, CASE WHEN field = 'text' AND records <= 2 OR field = 'category' AND records * 1000 < cn.total THEN 'rare' "
    "WHEN field = 'text' AND records * 4 > wn.total OR field = 'category' AND records * 20 > cn.total THEN 'common' END AS mark FROM t, wn, cn)"
)
_PAIRS = (
    f"w AS (SELECT article_id AS id, {_WORDS.format('text')} AS w FROM articles WHERE text IS NOT NULL), "
    "s AS (SELECT id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 20), "
    "n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), "
    "p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), "
    "f AS (SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.7)"
)
_FORMATS = (
    "l AS (SELECT article_id AS id, title, text, coalesce(link, '') AS link, instr(coalesce(link, ''), '?') AS q FROM articles), "
    f"k AS (SELECT id, {_CLEAN.format('title')} AS a, {_CLEAN.format('text')} AS b, "
    f"{_CLEAN.format('CASE WHEN q > 0 THEN substr(link, 1, q - 1) ELSE link END')} || "
    "CASE WHEN q > 0 THEN array_to_string(list_sort(list_transform(string_split(substr(link, q + 1), '&'), "
    f"lambda x: {_CLEAN.format('x')})), '') ELSE '' END AS u FROM l), "
    "g AS (SELECT u, least(a, b) AS lo, greatest(a, b) AS hi, min(id) AS first_id, count(*) AS copies FROM k GROUP BY 1, 2, 3)"
)

_SPLITS = f"d AS (SELECT article_id AS id, split, category FROM (SELECT article_id, {_NAME.format('category')} AS category, {_DAY} AS day FROM articles) JOIN split_periods ON day >= date_from AND day < date_to)"
#: Classes of equal words, and the pairs of different ones by their least ids.
_CLASSES = (
    f"w AS (SELECT article_id AS id, {_WORDS.format('text')} AS w FROM articles WHERE text IS NOT NULL), "
    "k AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS equal_rows FROM w WHERE len(w) >= 20), "
    "s AS (SELECT id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM k WHERE id = rep), "
    "n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), "
    "p AS (SELECT a.id AS rep_a, b.id AS rep_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), "
    "f AS (SELECT rep_a, rep_b, c / (x.n + y.n - c)::DOUBLE AS similarity FROM p JOIN n x ON x.id = rep_a JOIN n y ON y.id = rep_b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.7)"
)
#: Quotas by largest remainder with floors and caps: in each round the targets below their floor or above what is available are fixed.
_I = "generate_series(1, len(sh))"
_FREE = "list_sum(list_transform(" + _I + ", lambda i: CASE WHEN fx[i] IS NULL THEN {0} ELSE 0 END))"
_QUOTAS = (
    f"e AS (SELECT article_id AS id, year({_DAY}) AS y, {_NAME.format('category')} AS name FROM articles WHERE category IS NOT NULL), "
    "c AS (SELECT y, name, count(*) AS n FROM e WHERE y IS NOT NULL GROUP BY 1, 2), t AS (SELECT y, sum(n) AS n FROM c GROUP BY 1), "
    f"tg AS (SELECT target_set, target_year, category, {_NAME.format('category')} AS name, target_pct, min_rows, floor(coalesce(t.n, 0) * sample_pct / 100)::BIGINT AS sample_rows, coalesce(c.n, 0)::BIGINT AS available "
    f"FROM category_targets LEFT JOIN c ON c.y = target_year AND c.name = {_NAME.format('category')} LEFT JOIN t ON t.y = target_year), "
    "fl AS (SELECT *, row_number() OVER o AS i, greatest(0, least(least(min_rows, available), sample_rows - coalesce(sum(least(min_rows, available)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS least_rows "
    "FROM tg WINDOW o AS (PARTITION BY target_set ORDER BY target_pct DESC, category)), "
    "rn AS (SELECT target_set AS ts, any_value(sample_rows) AS size, list(target_pct::BIGINT ORDER BY i) AS sh, list(available ORDER BY i) AS av, list(least_rows ORDER BY i) AS lo, list(NULL::BIGINT ORDER BY i) AS fx, false AS done FROM fl GROUP BY 1 "
    "UNION ALL SELECT ts, size, sh, av, lo, CASE WHEN un >= ov AND nl > 0 THEN list_transform(" + _I + ", lambda i: CASE WHEN fx[i] IS NULL AND rest * sh[i] < lo[i] * w THEN lo[i] ELSE fx[i] END) "
    "ELSE list_transform(" + _I + ", lambda i: CASE WHEN fx[i] IS NULL AND rest * sh[i] > av[i] * w THEN av[i] ELSE fx[i] END) END, w = 0 OR (nl = 0 AND nh = 0) "
    "FROM (SELECT *, " + _FREE.format("CASE WHEN rest * sh[i] < lo[i] * w THEN 1 ELSE 0 END") + " AS nl, " + _FREE.format("CASE WHEN rest * sh[i] > av[i] * w THEN 1 ELSE 0 END") + " AS nh, "
    + _FREE.format("greatest(lo[i] * w - rest * sh[i], 0)") + " AS un, " + _FREE.format("greatest(rest * sh[i] - av[i] * w, 0)") + " AS ov "
    "FROM (SELECT *, " + _FREE.format("sh[i]") + " AS w, size - coalesce(list_sum(fx), 0) AS rest FROM rn WHERE NOT done))), "
    "fd AS (SELECT *, " + _FREE.format("sh[i]") + " AS w, size - coalesce(list_sum(fx), 0) AS rest FROM rn WHERE done), "
    "un AS (SELECT ts, w, rest, unnest(" + _I + ") AS i, unnest(sh) AS sh, unnest(lo) AS lo, unnest(fx) AS fx FROM fd), "
    "wh AS (SELECT *, CASE WHEN w > 0 AND fx IS NULL THEN rest * sh // w END AS whole, CASE WHEN w > 0 AND fx IS NULL THEN (rest * sh) % w END AS part FROM un), "
    "qt AS (SELECT ts, i, CASE WHEN w = 0 THEN greatest(coalesce(fx, 0), lo) WHEN fx IS NOT NULL THEN fx "
    "ELSE whole + CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY part DESC NULLS LAST, i) <= rest - sum(whole) OVER (PARTITION BY ts) THEN 1 ELSE 0 END END AS quota FROM wh), "
    "qa AS (SELECT fl.*, quota::BIGINT AS quota, greatest(ceil(sample_rows * target_pct / 100), min_rows)::BIGINT AS wanted FROM fl JOIN qt ON ts = target_set AND qt.i = fl.i), "
    "dr AS (SELECT target_set, category, id AS article_id FROM qa JOIN e ON e.y = target_year AND e.name = qa.name "
    "QUALIFY row_number() OVER (PARTITION BY target_set, category ORDER BY ('0x' || substr(md5('vazante' || target_set || ':' || id), 1, 15))::BIGINT, id) <= quota)"
)

ORACLE_SQL: dict[str, str] = {
    "p2_terms": f"WITH {_TERMS} SELECT * FROM m",
    "p2_found": f"WITH {_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_found": f"WITH {_PAIRS} SELECT * FROM f",
    "p4_links": f"WITH {_CLASSES} SELECT rep_a, rep_b, round(similarity, 8) AS similarity FROM f",
    "p4_groups": f"WITH RECURSIVE {_CLASSES}, ed AS (SELECT rep_a AS a, rep_b AS b FROM f UNION ALL SELECT rep_b, rep_a FROM f), dg AS (SELECT a, count(*) AS links FROM ed GROUP BY 1), "
    "rc AS (SELECT DISTINCT rep AS a, rep AS c FROM k UNION SELECT ed.b, rc.c FROM rc JOIN ed ON ed.a = rc.a), gr AS (SELECT a, min(c) AS c FROM rc GROUP BY 1) "
    "SELECT article_id AS id, coalesce(gr.c, article_id) AS group_id, coalesce(equal_rows, 1) AS equal_rows, coalesce(links, 0) AS links FROM articles LEFT JOIN k ON k.id = article_id LEFT JOIN gr ON gr.a = rep LEFT JOIN dg ON dg.a = rep",
    "p5_records": f"WITH {_FORMATS} SELECT first_id AS article_id, copies FROM g",
    "p5_found": f"WITH {_FORMATS} SELECT first_id AS id_a, id AS id_b FROM k JOIN g ON k.u = g.u AND least(a, b) = lo AND greatest(a, b) = hi WHERE id <> first_id",
    "p6_found": f"WITH {_PAIRS}, d AS (SELECT article_id AS id, split FROM (SELECT article_id, {_DAY} AS day FROM articles) JOIN split_periods ON day >= date_from AND day < date_to) "
    "SELECT DISTINCT id_a, id_b FROM f JOIN d x ON x.id = id_a JOIN d y ON y.id = id_b WHERE (x.split = 'train' AND y.split IN ('valid', 'test')) OR (y.split = 'train' AND x.split IN ('valid', 'test'))",
    "p6_report": f"WITH {_PAIRS}, {_SPLITS}, r AS (SELECT d.id, d.split, d.category, count(g.id_a) AS pairs, coalesce(max(g.same), 0) AS same FROM d LEFT JOIN "
    "(SELECT v.id, f.id_a, (f.c = x.n AND f.c = y.n)::INTEGER AS same FROM (SELECT f.id_a, f.id_b, p.c FROM f JOIN p USING (id_a, id_b)) f JOIN n x ON x.id = f.id_a JOIN n y ON y.id = f.id_b "
    "JOIN d v ON v.id IN (f.id_a, f.id_b) AND v.split <> 'train' JOIN d u ON u.id IN (f.id_a, f.id_b) AND u.split = 'train' AND u.id <> v.id) g ON g.id = d.id WHERE d.split <> 'train' GROUP BY ALL) "
    "SELECT split, category, count(*) AS rows, count(*) FILTER (pairs > 0) AS overlapping_rows, sum(same)::BIGINT AS rows_with_equal_shingles, sum(pairs)::BIGINT AS pairs FROM r GROUP BY 1, 2",
    "p7_quotas": f"WITH RECURSIVE {_QUOTAS} SELECT target_set, target_year, category, name, target_pct, min_rows, sample_rows, available, wanted, quota, (SELECT count(*) FROM dr WHERE dr.target_set = qa.target_set AND dr.category = qa.category) AS drawn, "
    "greatest(wanted - (SELECT count(*) FROM dr WHERE dr.target_set = qa.target_set AND dr.category = qa.category), 0) AS shortfall FROM qa",
    "p7_sample": f"WITH RECURSIVE {_QUOTAS} SELECT target_set, category, article_id FROM dr",
    "p7_found": f"WITH e AS (SELECT year({_DAY}) AS y, {_NAME.format('category')} AS name FROM articles WHERE category IS NOT NULL), "
    "c AS (SELECT y, name, count(*) AS n FROM e WHERE y IS NOT NULL GROUP BY 1, 2), t AS (SELECT y, sum(n) AS n FROM c GROUP BY 1) "
    f"SELECT target_set, category FROM category_targets LEFT JOIN c ON c.y = target_year AND c.name = {_NAME.format('category')} LEFT JOIN t ON t.y = target_year "
    "WHERE coalesce(c.n, 0) < greatest(ceil(floor(coalesce(t.n, 0) * sample_pct / 100) * target_pct / 100), min_rows)",
}
