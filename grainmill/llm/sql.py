"""SQL of the queries that plain SQL can express."""

from __future__ import annotations

from grainmill.llm.survivors import ROUND, TRACKING

#: Programs as connected components: all pairs that can be reached over equal titles or pages.
GROUPS = rf"""WITH RECURSIVE u AS (SELECT grant_id, title, nullif(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g'), '') AS t, regexp_replace(regexp_replace(trim(source_url), '#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS bare FROM grants),
k AS (SELECT grant_id, title, t, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/(index\.(html?|php))?)+$', '') AS path,
list_aggregate(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '(?i)^({TRACKING})(=|$)'))), 'string_agg', '&') AS asked FROM u),
n AS (SELECT grant_id, t, CASE WHEN host <> '' AND (path <> '' OR coalesce(asked, '') <> '') THEN host || path || coalesce('?' || nullif(asked, ''), '') || chr(1) || coalesce(list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(title, '{ROUND}', 1), lambda x: replace(lower(x), ' ', '')))), 'string_agg', '|'), '') END AS p FROM k),
e AS (SELECT a.grant_id AS a, b.grant_id AS b FROM n a JOIN n b ON a.t = b.t UNION SELECT a.grant_id, b.grant_id FROM n a JOIN n b ON a.p = b.p),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT min(a) AS group_id, b AS grant_id FROM r GROUP BY b HAVING count(DISTINCT a) > 1"""


def oracle_sql() -> dict[str, str]:
    """Query name -> equivalent SQL over the same tables."""
    return {"p5_groups": GROUPS}
