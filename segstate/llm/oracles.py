"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from segstate.llm import hosts

_LOWER = f"translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, {_SPACES}), '{hosts.UPPER}', '{hosts.LOWER}') AS key FROM l),
c AS (SELECT key AS common FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON key = common GROUP BY doc_id
"""

FM_INDEX = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT di.doc_id, di.i, di.n, item_id FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
g AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM g LEFT JOIN n USING (doc_id)
"""


def _level(units: str, key: str, prior: str) -> str:
    """CTEs of one level: ``{key}_s`` has the strength of the prior, ``{key}_m``
    the shrunk rate of each unit. ``units`` selects key columns, n, y, m."""
    return f"""
{key}_u AS ({units}),
{key}_w AS (SELECT sum(n) AS n, sum(n * n) AS n2, count(*) AS k, sum(n * pow(y / n - {prior}, 2)) AS ss,
                   sum(n * {prior} * (1 - {prior})) AS v FROM {key}_u WHERE n > 0),
{key}_r AS (SELECT CASE WHEN n > 0 AND n - n2 / n > 0 AND v > 0 THEN (ss - (k - 1) * (v / n)) / (n - n2 / n) / (v / n) END AS rho
            FROM {key}_w),
{key}_s AS (SELECT CASE WHEN rho > 0 THEN round(least(greatest(1 / rho - 1, {hosts.MIN_STRENGTH}), {hosts.MAX_STRENGTH}), 6)
                   ELSE {hosts.MAX_STRENGTH} END AS s FROM {key}_r),
{key}_m AS (SELECT u.*, s, (y + s * {prior}) / (n + s) AS post FROM {key}_u u, {key}_s)"""


def _rules() -> tuple[str, str]:
    rule = verdict = ""
    for kind, h, p in sorted(hosts.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule += f" {fits} THEN '{h}{p}'"
        verdict += f" {fits} THEN '{kind}'"
    return f"CASE{rule} END", f"CASE{verdict} ELSE CASE WHEN lower > {hosts.LIFT} * g.m THEN 'block' ELSE 'allow' END END"


_LONG = "array_to_string(string_split(host, '.')[-2:], '.') IN (" + ", ".join(f"'{s}'" for s in hosts.SUFFIXES) + ")"

HOSTS = rf"""
WITH o AS (SELECT doc_id AS key, CAST(2 * sum(bad) >= count(*) AS INTEGER) AS bad FROM (
  SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad
  FROM labels) WHERE doc_id IS NOT NULL AND bad IS NOT NULL GROUP BY doc_id),
q AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS key FROM q),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS y,
             array_to_string(string_split(host, '.')[CASE WHEN {_LONG} THEN -3 ELSE -2 END:], '.') AS domain,
             array_to_string(string_split(host, '.')[CASE WHEN {_LONG} THEN -2 ELSE -1 END:], '.') AS suffix
      FROM p LEFT JOIN o USING (key) GROUP BY host),
g AS (SELECT (coalesce(sum(y), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m FROM h),
{_level("SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(m) AS m FROM h, g GROUP BY suffix", "sfx", "m")},
{_level("SELECT h.domain, suffix, sum(h.n) AS n, sum(h.y) AS y, any_value(post) AS m FROM h JOIN sfx_m USING (suffix) GROUP BY ALL", "dom", "m")},
{_level("SELECT h.host, h.n, h.y, post AS m FROM h JOIN dom_m USING (domain, suffix)", "hst", "m")},
v AS (SELECT host, round(greatest(post - {hosts.Z} * sqrt(post * (1 - post) / (n + s + 1)), 0), 6) AS lower FROM hst_m)
SELECT page_id, host, path, {_rules()[0]} AS rule, {_rules()[1]} AS verdict FROM p JOIN v USING (host), g
"""

ORACLES = {
    "op4_host_reputation": HOSTS,
    "op5_fm_index": FM_INDEX,
    "op6_line_dedup": LINES,
    "op7_near_duplicates": NEAR_DUPLICATES,
}
