"""DuckDB statements that give the same rows as the core queries."""

from __future__ import annotations

from .queries import PARTS

_ANY = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'
_SIX = '^("(?:[^"]|"")*"|[^",\\r\\n]*)' + ',("(?:[^"]|"")*"|[^",\\r\\n]*)' * 5 + "$"
_GROUP = '("(?:[^"]|"")*"|[^",\\r\\n]*)'
_BAD = "[\\x{FFFD}\\x7F\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
# the s flag lets the dollar stand for the end of text only
_FIELDS = (
    "f AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '" + _ANY + "(?:," + _ANY + ")*') AS readable, "
    "regexp_full_match(raw_line, '" + _ANY + "(?:," + _ANY + "){5}') AS six, "
    + ", ".join(f"regexp_extract(raw_line, '{_SIX}', {k}) AS q{k}" for k in range(1, 7))
    + " FROM articles_raw), "
    "v AS (SELECT line_id, readable, six, "
    + ", ".join(f"CASE WHEN starts_with(q{k}, '\"') THEN replace(substr(q{k}, 2, length(q{k}) - 2), '\"\"', '\"') ELSE q{k} END AS f{k}" for k in range(1, 7))
    + " FROM f), "
    "r AS (SELECT *, CASE WHEN readable IS NULL OR NOT readable THEN 'quoting' WHEN NOT six THEN 'columns' "
    "WHEN f3 <> '' AND NOT coalesce(regexp_full_match(f3, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(f3 AS DATE) IS NOT NULL, false) THEN 'date' "
    "WHEN regexp_matches(f2, '" + _BAD + "') THEN 'text' END AS reason FROM v)"
)
ORACLE_SQL: dict[str, str] = {
    "p1_found": f"WITH {_FIELDS} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_loaded": f"WITH {_FIELDS} SELECT line_id, "
    + ", ".join(f"nullif(f{k}, '') AS {n}" for k, n in enumerate(("title", "text", "date", "category", "subcategory", "link"), 1))
    + " FROM r WHERE reason IS NULL",
}
# a prefix holds while its fields can be read and those with a rule keep it
_PREFIXES = ", ".join(f"regexp_matches(raw_line, '^{_ANY}" + f"(?:,{_ANY}){{{k}}}(?:,|$)') AS r{k + 1}" for k in range(6))
_GROUPS = ", ".join(f"regexp_extract(raw_line, '^{_GROUP}{''.join(f',{_GROUP}' for _ in range(k))}(?:,|$)', {k + 1}) AS p{k + 1}" for k in (1, 2))
_BROKEN = (
    f"b AS (SELECT line_id, file_name, raw_line, {_PREFIXES}, {_GROUPS} FROM articles_raw), "
    "g AS (SELECT *, CASE WHEN starts_with(p3, '\"') THEN substr(p3, 2, length(p3) - 2) ELSE p3 END AS d FROM b), "
    f"h AS (SELECT *, NOT regexp_matches(p2, '{_BAD}') AS t, d = '' OR coalesce(regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(d AS DATE) IS NOT NULL, false) AS v FROM g), "
    "k AS (SELECT line_id, file_name, CASE WHEN raw_line IS NULL OR NOT r1 THEN 1 WHEN NOT (r2 AND t) THEN 2 WHEN NOT (r3 AND v) THEN 3 WHEN NOT r4 THEN 4 WHEN NOT r5 THEN 5 WHEN NOT r6 THEN 6 ELSE 7 END AS broken_field FROM h)"
)
ORACLE_SQL["p1_report"] = f"WITH {_FIELDS}, {_BROKEN} SELECT file_name, reason, broken_field::INTEGER AS broken_field, count(*) AS records FROM r JOIN k USING (line_id) WHERE reason IS NOT NULL GROUP BY ALL"
for _part in PARTS:
    ORACLE_SQL |= _part.ORACLE_SQL
