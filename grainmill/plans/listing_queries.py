"""Queries over the listing and the captured tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import amounts, dates, html, text, urls
from grainmill.operators import aggregates, predicates, rules, upsert, windows
from grainmill.operators.change import latest_capture
from grainmill.operators.ordering import decision_order, order_of, page_of
from grainmill.operators.predicates import ListingQuery, display_status, listed
from grainmill.plans.listing import AS_OF, as_of, expenses, listing, with_amounts
from grainmill.runtime import table
from grainmill.sources import adapters, exports
from grainmill.streaming.limiter import limited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LISTING_SQL = f"""WITH am AS (SELECT l_orderkey, CAST(floor(min(l_extendedprice)) AS BIGINT) AS amount_min, CAST(floor(max(l_extendedprice)) AS BIGINT) AS amount_max FROM lineitem GROUP BY l_orderkey),
listing AS (SELECT o_orderkey AS id, o_orderkey AS seq, c_name || ' ' || o_orderpriority AS title, c_mktsegment || ' program in ' || n_name || ', ' || r_name AS description, n_name AS source_name, r_name, n_name,
'https://' || lower(c_mktsegment) || '.example.org/p/' || CAST(o_orderkey % 400 AS VARCHAR) AS source_url,
CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'FORECASTED' END AS status,
CASE o_orderpriority WHEN '1-URGENT' THEN 'FEDERAL' WHEN '2-HIGH' THEN 'STATE' WHEN '3-MEDIUM' THEN 'LOCAL' ELSE 'PRIVATE' END AS grant_type,
CASE c_mktsegment WHEN 'BUILDING' THEN 'STARTUP' WHEN 'MACHINERY' THEN 'EXISTING' ELSE 'BOTH' END AS business_stage,
CASE c_nationkey % 5 WHEN 0 THEN 'WOMEN' WHEN 1 THEN 'VETERAN' WHEN 2 THEN 'MINORITY' WHEN 3 THEN 'GENERAL' ELSE 'ANY' END AS gender,
CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS deadline, o_orderdate - INTERVAL 60 DAY AS created_at, amount_min, amount_max
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN am ON l_orderkey = o_orderkey)
"""
NOW = f"TIMESTAMP '{AS_OF}'"
DAY = "%Y-%m-%d %H:%M:%S"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def over_listing(select: str) -> str:
    """SQL over the listing."""
    return LISTING_SQL + select


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


LIST = "SELECT id, title, status, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline, amount_max, CASE WHEN deadline < {now} THEN 'CLOSED' ELSE status END AS display_status FROM listing ORDER BY {order} LIMIT {n} OFFSET {skip}"


def _list_sql(order: str, n: int = 20, skip: int = 0) -> str:
    return over_listing(LIST.format(now=NOW, order=order, n=n, skip=skip))


def _list(spark, folder, sort, page=None, limit=None, direction=None) -> DataFrame:
    order = order_of(sort, direction)
    if sort == "amount":
        rows = page_of(listing(spark, folder), order, page, limit)
    else:
        rows = with_amounts(spark, folder, page_of(listing(spark, folder, amounts=False), order, page, limit), order)
    return rows.select("id", "title", "status", _stamp("deadline"), "amount_max", display_status(as_of()).alias("display_status"))


@query(_list_sql("deadline ASC NULLS LAST, created_at DESC, id"))
def list_default(spark, folder):
    return _list(spark, folder, None)


@query(_list_sql("deadline ASC NULLS FIRST, created_at DESC, id"))
def list_rolling_first(spark, folder):
    return _list(spark, folder, "rollingFirst")


@query(_list_sql("amount_max DESC NULLS LAST, deadline ASC NULLS LAST, id"))
def list_amount_desc(spark, folder):
    return _list(spark, folder, "amount")


@query(_list_sql("created_at DESC, id"))
def list_recent(spark, folder):
    return _list(spark, folder, "recent")


@query(_list_sql("title ASC, id"))
def list_title(spark, folder):
    return _list(spark, folder, "title")


@query(_list_sql("deadline ASC NULLS LAST, created_at DESC, id", 50, 100))
def list_page_3(spark, folder):
    return _list(spark, folder, "deadline", 3, 50)


def _filtered(params: dict[str, str], where: str):
    def run(spark, folder):
        q = ListingQuery.parse(params)
        return listed(listing(spark, folder), q, as_of(), expenses(spark, folder) if q.expenses else None).select("id", "title", "status", "grant_type")

    return run, over_listing(f"SELECT id, title, status, grant_type FROM listing WHERE {where}")


OPEN_SQL = f"(status = 'OPEN' AND (deadline IS NULL OR deadline >= {NOW}))"
CLOSED_SQL = f"(status = 'CLOSED' OR (status = 'OPEN' AND deadline < {NOW}))"
SOME_SQL = "id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'STANDARD'))"
for _name, _params, _where in (
    ("filter_search", {"search": "Building"}, "(contains(lower(title), 'building') OR contains(lower(description), 'building'))"),
    ("filter_enum_in", {"grant_type": "FEDERAL, PRIVATE,BOGUS", "gender": "ANY"}, "grant_type IN ('FEDERAL', 'PRIVATE') AND gender = 'ANY'"),
    ("filter_unknown_enum", {"grant_type": "BOGUS", "business_stage": "STARTUP"}, "business_stage = 'STARTUP'"),
    ("filter_open", {"status": "OPEN"}, OPEN_SQL),
    ("filter_closed", {"status": "CLOSED"}, CLOSED_SQL),
    ("filter_forecasted", {"status": "FORECASTED"}, "status = 'FORECASTED'"),
    ("filter_open_or_closed", {"status": "OPEN,CLOSED"}, f"({OPEN_SQL} OR {CLOSED_SQL})"),
    ("filter_amount_overlap", {"amount_min": "20000", "amount_max": "30000"}, "amount_max >= 20000 AND amount_min <= 30000"),
    ("filter_location_has", {"location": "NATION_3"}, "(r_name = 'NATION_3' OR n_name = 'NATION_3')"),
    ("filter_expense_some", {"expenses": "ECONOMY,STANDARD"}, SOME_SQL),
    ("filter_all", {"search": "building", "grant_type": "FEDERAL,PRIVATE", "status": "OPEN", "amount_min": "20000", "expenses": "ECONOMY,STANDARD"}, f"(contains(lower(title), 'building') OR contains(lower(description), 'building')) AND grant_type IN ('FEDERAL', 'PRIVATE') AND {OPEN_SQL} AND amount_max >= 20000 AND {SOME_SQL}"),
):
    QUERIES[_name], SQL[_name] = _filtered(_params, _where)


@query(over_listing(f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM listing WHERE {OPEN_SQL}"))
def list_total_pages(spark, folder):
    rows = listed(listing(spark, folder, amounts=False), ListingQuery(status=["OPEN"]), as_of())
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))


CAL_SQL = "status = 'OPEN' AND deadline >= TIMESTAMP '1998-07-01 00:00:00' AND deadline <= TIMESTAMP '1998-07-31 23:59:59'"


@query(over_listing(f"SELECT id, title, status, grant_type, strftime(deadline, '{DAY}') AS deadline FROM listing WHERE {CAL_SQL}"))
def calendar_month(spark, folder):
    return aggregates.calendar_month(listing(spark, folder, amounts=False), 1998, 7).select("id", "title", "status", "grant_type", _stamp("deadline"))


@query(over_listing(f"SELECT strftime(deadline, '%Y-%m-%d') AS day, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY deadline, id) AS ids FROM listing WHERE {CAL_SQL} GROUP BY 1"))
def calendar_by_day(spark, folder):
    days = aggregates.by_day(aggregates.calendar_month(listing(spark, folder, amounts=False), 1998, 7))
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT DISTINCT x AS value FROM (SELECT unnest(locations) AS x FROM grants) WHERE x IS NOT NULL AND x <> '' ORDER BY 1")
def facet_locations(spark, folder):
    return aggregates.facet(table(spark, folder, "grants"), "locations")


@query("SELECT DISTINCT x AS value FROM (SELECT unnest(industries) AS x FROM grants) WHERE x IS NOT NULL AND x <> '' ORDER BY 1")
def facet_industries(spark, folder):
    return aggregates.facet(table(spark, folder, "grants"), "industries")


@query(over_listing("SELECT id, count(*) AS n, string_agg(x, '; ' ORDER BY x) AS industries FROM (SELECT DISTINCT id, p_type AS x FROM listing JOIN lineitem ON l_orderkey = id JOIN part ON p_partkey = l_partkey) GROUP BY id"))
def relation_include(spark, folder):
    rows = listing(spark, folder, amounts=False, industries=True).where("industries is not null")
    return rows.select("id", F.size("industries").cast("bigint").alias("n"), F.array_join("industries", "; ").alias("industries"))


@query(over_listing(f""", c AS (SELECT id, grant_type, row_number() OVER (PARTITION BY grant_type ORDER BY deadline ASC NULLS LAST, created_at DESC, id) AS k FROM listing WHERE {OPEN_SQL}),
p AS (SELECT a.id, c.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY c.k) AS place FROM listing a JOIN c ON c.grant_type = a.grant_type AND c.id <> a.id AND c.k <= 4) SELECT id, CAST(place AS BIGINT) AS place, other FROM p WHERE place <= 3"""))
def similar_top3(spark, folder):
    rows = listing(spark, folder, amounts=False).withColumn("gm_candidate", predicates.status_is(["OPEN"], as_of()))
    out = windows.nearest_of_kind(rows, "grant_type", order_of("deadline"))
    return out.select("id", F.col("place").cast("bigint").alias("place"), "other")


@query(over_listing("SELECT id, title FROM listing ORDER BY deadline ASC NULLS LAST, created_at DESC, id LIMIT 1000"))
def export_top1000(spark, folder):
    return listing(spark, folder, amounts=False).orderBy(*order_of("deadline", "asc")).limit(1000).select("id", "title")


@query(over_listing("""SELECT id, title || ',"' || description || '",' || source_name || ',' || source_url || ',' || coalesce(CAST(amount_min AS VARCHAR), '') || ',' || coalesce(CAST(amount_max AS VARCHAR), '') || ',' || coalesce(strftime(deadline, '%Y-%m-%d'), '') || ',' || grant_type || ',' || status || ',' || gender || ',' || r_name || '; ' || n_name AS line FROM listing"""))
def export_csv_projection(spark, folder):
    return exports.csv_lines(listing(spark, folder), exports.COLUMNS[:-1])


@query(over_listing(f"SELECT 'total' AS measure, 'all' AS value, count(*) AS n FROM listing UNION ALL SELECT 'status', status, count(*) FROM listing GROUP BY 2 UNION ALL SELECT 'type', grant_type, count(*) FROM listing GROUP BY 2 UNION ALL SELECT 'closing soon', CASE WHEN status = 'OPEN' AND deadline >= {NOW} AND deadline <= {NOW} + INTERVAL 30 DAY THEN 'yes' ELSE 'no' END, count(*) FROM listing GROUP BY 2"))
def summary_by_status_type(spark, folder):
    return aggregates.summary(listing(spark, folder, amounts=False), as_of())


@query(over_listing(f"SELECT id, strftime(deadline, '{DAY}') AS deadline FROM listing WHERE status = 'OPEN' AND deadline >= {NOW} AND deadline <= {NOW} + INTERVAL 30 DAY"))
def closing_soon(spark, folder):
    rows = listing(spark, folder, amounts=False)
    return rows.where((F.col("status") == "OPEN") & F.col("deadline").between(as_of(), as_of() + F.expr("INTERVAL 30 DAY"))).select("id", _stamp("deadline"))


@query(over_listing("SELECT id, status FROM listing ORDER BY CASE status WHEN 'OPEN' THEN 0 WHEN 'FORECASTED' THEN 1 WHEN 'CLOSED' THEN 2 ELSE 3 END, deadline ASC NULLS LAST, id LIMIT 100"))
def decision_top100(spark, folder):
    return listing(spark, folder, amounts=False).orderBy(*decision_order()).limit(100).select("id", "status")


@query(over_listing(f"SELECT status, CASE WHEN deadline IS NULL THEN 'rolling' WHEN deadline < {NOW} THEN 'past' ELSE 'ahead' END AS at, CASE WHEN deadline < {NOW} THEN 'CLOSED' ELSE status END AS shown, count(*) AS n FROM listing GROUP BY 1, 2, 3"))
def display_status_matrix(spark, folder):
    rows = listing(spark, folder, amounts=False)
    at = F.when(F.col("deadline").isNull(), "rolling").when(F.col("deadline") < as_of(), "past").otherwise("ahead")
    return rows.groupBy("status", at.alias("at"), display_status(as_of()).alias("shown")).agg(F.count("*").alias("n"))


DAYS_SQL = f"CAST(ceil((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0) AS BIGINT)"


@query(over_listing(f"SELECT id, CASE WHEN d < 0 THEN 'EXPIRED' WHEN d <= 7 THEN 'THIS WEEK' WHEN d <= 14 THEN 'NEXT WEEK' WHEN d <= 30 THEN 'THIS MONTH' WHEN d <= 60 THEN 'UPCOMING' END AS bucket FROM (SELECT id, {DAYS_SQL} AS d FROM listing)"))
def urgency_bucket(spark, folder):
    return listing(spark, folder, amounts=False).select("id", dates.urgency_bucket(F.col("deadline"), as_of()).alias("bucket"))


@query(over_listing(f"SELECT id, {DAYS_SQL} AS days, CASE WHEN deadline > {NOW} AND epoch_us(deadline) - epoch_us({NOW}) < 7 * 86400000000 THEN CASE WHEN {DAYS_SQL} = 1 THEN 'Closing tomorrow' ELSE 'Closing in ' || CAST({DAYS_SQL} AS VARCHAR) || 'd' END END AS label FROM listing"))
def days_left_label(spark, folder):
    rows = listing(spark, folder, amounts=False)
    return rows.select("id", dates.days_left(F.col("deadline"), as_of()).alias("days"), dates.urgency_label(F.col("deadline"), as_of()).alias("label"))


SHOWN_SQL = "strftime(timezone('America/Chicago', deadline AT TIME ZONE 'UTC'), '%b %-d, %Y')"
DAYS_SQL = f"CAST(ceil((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0) AS BIGINT)"


@query(over_listing(f"SELECT id, CASE WHEN deadline IS NULL THEN 'No deadline' WHEN {DAYS_SQL} < 0 THEN 'Closed ' || {SHOWN_SQL} WHEN {DAYS_SQL} <= 30 THEN {DAYS_SQL} || 'd left - ' || {SHOWN_SQL} ELSE {SHOWN_SQL} END AS shown FROM listing"))
def short_deadline(spark, folder):
    return listing(spark, folder, amounts=False).select("id", dates.short_deadline(F.col("deadline"), as_of()).alias("shown"))


@query(over_listing("SELECT min(id) AS id, source_url FROM listing GROUP BY source_url"))
def dedupe_first_by_url(spark, folder):
    return windows.first_wins(listing(spark, folder, amounts=False), ["source_url"], "seq").select("id", "source_url")


KEY_SQL = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"


@query(over_listing(f"SELECT min(id) AS id, {KEY_SQL} AS title_key FROM listing GROUP BY 2"))
def dedupe_first_by_title_key(spark, folder):
    rows = listing(spark, folder, amounts=False).withColumn("title_key", text.alnum_key(F.col("title")))
    return windows.first_wins(rows, ["title_key"], "seq").select("id", "title_key")


@query(over_listing("SELECT id, source_name FROM (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY seq) AS k FROM listing) WHERE k <= 10"))
def cap_n_per_source(spark, folder):
    return windows.cap_per_group(listing(spark, folder, amounts=False), ["source_name"], [F.asc("seq")], 10).select("id", "source_name")


@query(over_listing("SELECT id, source_name, CAST((row_number() OVER (PARTITION BY source_name ORDER BY seq) - 1) // 8 AS BIGINT) AS batch FROM listing"))
def model_batches(spark, folder):
    return windows.batches(listing(spark, folder, amounts=False), [F.asc("seq")], 8, ["source_name"]).select("id", "source_name", "batch")


def _halves(spark, folder):
    rows = listing(spark, folder)
    snapshot = windows.first_wins(rows.where("id % 2 = 0"), ["source_url"], "seq")
    batch = rows.where("id % 2 = 1").withColumn("source_url", F.concat(F.lit("https://b.example.org/p/"), (F.col("id") % 700).cast("string")))
    return snapshot, batch.withColumn("source_url", F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://building.example.org/p/"), (F.col("id") % 400 - F.col("id") % 2).cast("string"))).otherwise(F.col("source_url")))


HALVES_SQL = f""", snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY seq) AS k FROM listing WHERE id % 2 = 0) WHERE k = 1),
bat AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'https://building.example.org/p/' || CAST(id % 400 - id % 2 AS VARCHAR) ELSE 'https://b.example.org/p/' || CAST(id % 700 AS VARCHAR) END AS source_url) FROM listing WHERE id % 2 = 1)
"""


@query(over_listing(HALVES_SQL + ", f AS (SELECT source_url, min(seq) AS q FROM bat GROUP BY 1) SELECT bat.id, CASE WHEN bat.source_url NOT IN (SELECT source_url FROM snap) AND bat.seq = f.q THEN 'created' ELSE 'duplicate' END AS outcome FROM bat JOIN f ON f.source_url = bat.source_url"))
def bulk_insert_created_vs_duplicate(spark, folder):
    return upsert.bulk_insert(*_halves(spark, folder), "source_url", "seq").select("id", "outcome")


@query(over_listing("SELECT id, source_url FROM listing WHERE source_url NOT IN (SELECT 'https://building.example.org/p/' || CAST(p_partkey % 400 AS VARCHAR) FROM part WHERE p_size < 10)"))
def blacklist_anti(spark, folder):
    listed_out = table(spark, folder, "part").where("p_size < 10").select(F.concat(F.lit("https://building.example.org/p/"), (F.col("p_partkey") % 400).cast("string")).alias("source_url"))
    return upsert.without_keys(listing(spark, folder, amounts=False), listed_out, "source_url").select("id", "source_url")


@query("SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'click')")
def retention_prune(spark, folder):
    gone = (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")) & (F.col("event_type") != "click")
    return table(spark, folder, "events").where(~gone).select("event_id")


@query("SELECT grant_id, strftime(last_verified, '%Y-%m-%d %H:%M:%S') AS last_verified FROM grants ORDER BY grants.last_verified, grant_id LIMIT 200")
def revalidate_oldest(spark, folder):
    return table(spark, folder, "grants").orderBy("last_verified", "grant_id").limit(200).select("grant_id", _stamp("last_verified"))


CONF_SQL = "CASE id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"


def _verdicts(spark, folder):
    rows = listing(spark, folder, amounts=False)
    conf = F.when(F.col("id") % 3 == 0, "HIGH").when(F.col("id") % 3 == 1, "MEDIUM").otherwise("LOW")
    return rows.select("id", "deadline", F.when(F.col("id") % 4 != 0, F.col("created_at")).alias("found"), conf.alias("confidence"))


@query(over_listing(f""", v AS (SELECT id, deadline, CASE WHEN id % 4 <> 0 THEN created_at END AS found, {CONF_SQL} AS c FROM listing)
SELECT id, strftime(CASE WHEN found IS NOT NULL AND (c = 'HIGH' OR (c = 'MEDIUM' AND deadline IS NULL)) THEN found ELSE deadline END, '{DAY}') AS deadline,
CASE WHEN found IS NOT NULL AND (c = 'HIGH' OR (c = 'MEDIUM' AND deadline IS NULL)) THEN 'ai' WHEN found IS NOT NULL AND c = 'MEDIUM' THEN 'merged' ELSE 'regex' END AS method,
CASE WHEN found IS NOT NULL AND c = 'HIGH' THEN 'overwritten' WHEN found IS NOT NULL AND c = 'MEDIUM' AND deadline IS NULL THEN 'filled' WHEN found IS NOT NULL AND c = 'MEDIUM' AND deadline <> found THEN 'disagreement' ELSE 'unchanged' END AS outcome FROM v"""))
def reconcile_deadline(spark, folder):
    r = upsert.reconciled_deadline(F.col("deadline"), F.col("found"), F.col("confidence"))
    return _verdicts(spark, folder).select("id", r.alias("r")).select("id", F.date_format("r.deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"), "r.method", "r.outcome")


@query(over_listing(f"SELECT id, strftime(CASE WHEN deadline IS NULL THEN f WHEN f IS NULL THEN deadline WHEN deadline > f THEN deadline ELSE f END, '{DAY}') AS deadline FROM (SELECT id, deadline, CASE WHEN id % 4 <> 0 THEN created_at + INTERVAL 75 DAY END AS f FROM listing)"))
def pdf_merge_deadline(spark, folder):
    rows = listing(spark, folder, amounts=False)
    found = F.when(F.col("id") % 4 != 0, F.col("created_at") + F.expr("INTERVAL 75 DAY"))
    return rows.select("id", F.date_format(upsert.later_of(F.col("deadline"), found), "yyyy-MM-dd HH:mm:ss").alias("deadline"))


@query("SELECT grant_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal FROM grants")
def normalize_title(spark, folder):
    return table(spark, folder, "grants").select("grant_id", text.normal_title(F.col("title")).alias("normal"))


@query("SELECT grant_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_key FROM grants")
def title_key(spark, folder):
    return table(spark, folder, "grants").select("grant_id", text.alnum_key(F.col("title")).alias("title_key"))


@query("SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 5000 THEN regexp_replace(substring(text, 1, 4985), '\\s+$', '') || '… [truncated]' ELSE text END AS s FROM documents)")
def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.shortened(F.col("text")).alias("s")).select("doc_id", F.length("s").cast("bigint").alias("n"), F.md5("s").alias("digest"))


@query("SELECT doc_id, CASE WHEN length(title) > 40 THEN substring(title, 1, 37) || '...' ELSE title END AS short FROM documents")
def elide_title(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.elided(F.col("title"), 40).alias("short"))


_SSN = r"regexp_replace({0}, '(^|\D)\d{{3}}-\d{{2}}-\d{{4}}(\D|$)', '\1[REDACTED-SSN]\2', 'g')"


@query(f"SELECT doc_id, md5({_SSN.format(_SSN.format('text'))}) AS digest FROM documents")
def redact_numbers(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.redacted(F.col("text"))).alias("digest"))


@query("SELECT grant_id, lower(regexp_extract(source_url, '^(?i)(https?)://([^/?#]+)([^?#]*)', 1)) AS scheme, lower(regexp_extract(source_url, '^(?i)(https?)://([^/?#]+)([^?#]*)', 2)) AS host, regexp_extract(source_url, '^(?i)(https?)://([^/?#]+)([^?#]*)', 3) AS path FROM grants")
def url_parts(spark, folder):
    u = F.col("source_url")
    return table(spark, folder, "grants").select("grant_id", urls.part(u, "scheme").alias("scheme"), urls.part(u, "host").alias("host"), urls.part(u, "path").alias("path"))


@query("SELECT grant_id, regexp_replace(source_url, '[?#].*$', '') AS canonical FROM grants")
def url_canonical(spark, folder):
    return table(spark, folder, "grants").select("grant_id", urls.canonical(F.col("source_url")).alias("canonical"))


@query("SELECT hit_row, CASE WHEN award_floor > 0 AND award_ceiling > 0 THEN format('${:,}', award_floor) || ' - ' || format('${:,}', award_ceiling) WHEN award_ceiling > 0 THEN 'Up to ' || format('${:,}', award_ceiling) WHEN estimated_funding > 0 THEN format('${:,}', estimated_funding) || ' (estimated total)' END AS award FROM grants_gov_hits")
def award_text(spark, folder):
    return table(spark, folder, "grants_gov_hits").select("hit_row", amounts.award_text(F.col("award_floor"), F.col("award_ceiling"), F.col("estimated_funding")).alias("award"))


RULES = [
    rules.Rule("closed", ("applications are closed", "no longer accepting", "deadline has passed"), ("apply now", "next cycle")),
    rules.Rule("news", ("news from", "minutes of", "was named"), ("applications are accepted", "apply online by")),
    rules.Rule("loan", ("loan", "refinance")),
]
RULE_SQL = """CASE WHEN (contains(t, 'applications are closed') OR contains(t, 'no longer accepting') OR contains(t, 'deadline has passed')) AND NOT (contains(t, 'apply now') OR contains(t, 'next cycle')) THEN 'closed'
WHEN (contains(t, 'news from') OR contains(t, 'minutes of') OR contains(t, 'was named')) AND NOT (contains(t, 'applications are accepted') OR contains(t, 'apply online by')) THEN 'news' WHEN contains(t, 'loan') OR contains(t, 'refinance') THEN 'loan' END"""
DOCS_SQL = "(SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"


@query(f"SELECT doc_id, {RULE_SQL} AS drop_reason FROM {DOCS_SQL}")
def rule_drop_reason(spark, folder):
    return table(spark, folder, "documents").select("doc_id", rules.reason_of(F.col("text"), RULES).alias("drop_reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {RULE_SQL} AS reason FROM {DOCS_SQL}) WHERE reason IS NOT NULL GROUP BY 1")
def rule_drop_counts(spark, folder):
    return rules.reason_counts(table(spark, folder, "documents").select(rules.reason_of(F.col("text"), RULES).alias("drop_reason")))


TAGS = {"EQUIPMENT": ("equipment", "machine"), "TRAINING": ("training", "workshop"), "ENERGY": ("energy", "solar"), "EXPORT": ("export", "buyers abroad")}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{k}' END" for k, ps in TAGS.items()) + f") AS tags FROM {DOCS_SQL}")
def categorize_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(rules.tags_of(F.col("text"), TAGS), ",").alias("tags"))


@query(f"SELECT doc_id, CASE WHEN contains(t, 'women') THEN 'WOMEN' WHEN contains(t, 'veteran') THEN 'VETERAN' WHEN contains(t, 'tribal') OR contains(t, 'immigrant') THEN 'MINORITY' ELSE 'ANY' END AS audience FROM {DOCS_SQL}")
def categorize_first(spark, folder):
    audience = {"WOMEN": ("women",), "VETERAN": ("veteran",), "MINORITY": ("tribal", "immigrant")}
    return table(spark, folder, "documents").select("doc_id", rules.first_tag(F.col("text"), audience, "ANY").alias("audience"))


def _pages(spark, folder):
    rows = table(spark, folder, "grants").where(F.col("raw_data").contains('"pageHtml"'))
    return rows.select("grant_id", "source_url", F.get_json_object("raw_data", "$.pageHtml").alias("page")).where("page is not null")


@query()
def html_to_text(spark, folder):
    return _pages(spark, folder).select("grant_id", html.html_text("page").alias("text"))


@query()
def page_links(spark, folder):
    links = _pages(spark, folder).select("grant_id", F.posexplode(html.page_links("page", "source_url")).alias("pos", "x"))
    return links.select("grant_id", "pos", "x.url", "x.text")


@query()
def heading_sections(spark, folder):
    parts = _pages(spark, folder).select("grant_id", F.posexplode(html.page_sections("page")).alias("pos", "x"))
    return parts.select("grant_id", "pos", "x.heading", "x.body")


@query("SELECT notice_id, title FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY sam_row) AS k FROM sam_opportunities) WHERE k = 1 OR notice_id IS NULL")
def source_notices(spark, folder):
    return adapters.notices(table(spark, folder, "sam_opportunities")).select(F.col("id").alias("notice_id"), "title")


@query("SELECT opp_id, title, CASE WHEN lower(opp_status) = 'forecasted' THEN 'FORECASTED' ELSE 'OPEN' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY hit_row) AS k FROM grants_gov_hits) WHERE k = 1 OR opp_id IS NULL")
def source_search_hits(spark, folder):
    return adapters.search_hits(table(spark, folder, "grants_gov_hits")).select(F.col("id").alias("opp_id"), "title", "status")


@query("SELECT 'notices' AS source, 'success' AS status, count(notice_id) AS found FROM sam_opportunities UNION ALL SELECT 'hits', 'success', count(opp_id) FROM grants_gov_hits UNION ALL SELECT 'feeds', 'error', 0")
def source_union_log(spark, folder):
    parts = {"notices": table(spark, folder, "sam_opportunities").select(F.col("notice_id").alias("id")), "hits": table(spark, folder, "grants_gov_hits").select(F.col("opp_id").alias("id")), "feeds": None}
    return aggregates.source_log(parts)


@query("SELECT grant_id, json_extract_string(raw_data, '$.oppNumber') AS number, json_extract_string(raw_data, '$.closedReason.method') AS method, CAST(json_extract_string(raw_data, '$.closedReason.status') AS BIGINT) AS code FROM grants WHERE raw_data IS NOT NULL AND json_valid(raw_data)")
def json_props(spark, folder):
    spec = "oppNumber string, closedReason struct<method: string, status: bigint>"
    rows = table(spark, folder, "grants").where("raw_data is not null").select("grant_id", F.from_json("raw_data", spec).alias("r"))
    return rows.select("grant_id", F.col("r.oppNumber").alias("number"), F.col("r.closedReason.method").alias("method"), F.col("r.closedReason.status").alias("code"))


@query("SELECT grant_id FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY last_verified DESC, seq DESC) AS k FROM grants) WHERE k = 1")
def latest_capture_per_url(spark, folder):
    return latest_capture(table(spark, folder, "grants").select("source_url", "grant_id", "last_verified", "seq"), "source_url", "last_verified", "seq").select("grant_id")


@query(over_listing("SELECT a.id, a.title FROM listing a WHERE a.source_name IN (SELECT s.n_name FROM nation s JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)"))
def existence_semi(spark, folder):
    rich = table(spark, folder, "supplier").where("s_acctbal > 9000").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source_name"))
    return listing(spark, folder, amounts=False).join(rich.distinct(), "source_name", "left_semi").select("id", "title")


_ENTRY = "(CAST(row_number() OVER w AS VARCHAR) || '. ' || title) || chr(10) || '   ' || CASE WHEN length(description) > 120 THEN left(description, 117) || '...' ELSE description END || chr(10) || '   ' || source_url"


@query(over_listing(f"SELECT CAST(row_number() OVER w AS INTEGER) AS place, {_ENTRY} AS entry FROM listing WINDOW w AS (ORDER BY CASE status WHEN 'OPEN' THEN 0 WHEN 'FORECASTED' THEN 1 WHEN 'CLOSED' THEN 2 ELSE 3 END, deadline ASC NULLS LAST, id) ORDER BY place LIMIT 100"))
def text_export(spark, folder):
    return exports.text_entries(listing(spark, folder, amounts=False), decision_order(), 100)


@query(over_listing(f"SELECT id, title, status, strftime(deadline, '{DAY}') AS deadline, amount_max, CASE WHEN deadline < {NOW} THEN 'CLOSED' ELSE status END AS display_status FROM listing WHERE {SQL['filter_all'].split(' FROM listing WHERE ')[1]} ORDER BY listing.deadline ASC NULLS LAST, created_at DESC, id LIMIT 20"))
def flagship(spark, folder):
    params = {"search": "building", "grant_type": "FEDERAL,PRIVATE", "status": "OPEN", "amount_min": "20000", "expenses": "ECONOMY,STANDARD"}
    rows = listed(listing(spark, folder), ListingQuery.parse(params), as_of(), expenses(spark, folder))
    return page_of(rows, order_of()).select("id", "title", "status", _stamp("deadline"), "amount_max", display_status(as_of()).alias("display_status"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of this module's queries."""
    return dict(QUERIES)
