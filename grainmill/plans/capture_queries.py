"""Queries over captured records: parsing, merging in order, verdicts, sweeps, ledgers; each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import amounts, dates, text, urls
from grainmill.operators import change, ledger, liveness, records, upsert, verdicts
from grainmill.plans.listing import AS_OF, as_of
from grainmill.runtime import table
from grainmill.sources import adapters, articles, exports
from grainmill.streaming.limiter import limited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The moment that captures are judged at, and the same in SQL.
AT = "2026-04-05 12:00:00"
AT_SQL = f"TIMESTAMP '{AT}'"
DAY = "%Y-%m-%d %H:%M:%S"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _at():
    return F.expr(f"TIMESTAMP_NTZ '{AT}'")


def _stamp(c, name: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


# ---- sums


SUMS_SQL = r"""SELECT grant_id, amount, regexp_extract_all(amount, '\$\s*(\d[\d,]*(?:\.\d+)?)\s*((?:[KMBkmb]|thousand|million|billion)\b)?', 1) AS n,
regexp_extract_all(amount, '\$\s*(\d[\d,]*(?:\.\d+)?)\s*((?:[KMBkmb]|thousand|million|billion)\b)?', 2) AS s FROM grants"""


@query(
    r"""WITH f AS ("""
    + SUMS_SQL
    + r"""), v AS (SELECT grant_id, amount, list_filter(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN coalesce(s[i], '') <> '' OR CAST(replace(n[i], ',', '') AS DOUBLE) >= 100 THEN
CAST(floor(CAST(replace(n[i], ',', '') AS DOUBLE) * CASE lower(left(coalesce(s[i], ''), 1)) WHEN 'k' THEN 1000 WHEN 't' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END) AS BIGINT) END), lambda x: x IS NOT NULL) AS v FROM f)
SELECT grant_id, CASE WHEN r AND len(v) >= 2 THEN list_min(v) ELSE v[1] END AS low, CASE WHEN r AND len(v) >= 2 THEN list_max(v) ELSE v[1] END AS high
FROM (SELECT *, regexp_matches(amount, '\$[\d,.]+\s*(?:[KMBkmb]|thousand|million|billion)?\s*(?:-|–|—|to)\s*\$[\d,.]+') AS r FROM v)"""
)
def parse_amount(spark, folder):
    return table(spark, folder, "grants").select("grant_id", amounts.amount_bounds(F.col("amount")).alias("b")).select("grant_id", "b.low", "b.high")


def _num(x: str) -> str:
    return rf"TRY_CAST(regexp_extract({x}, '^(\d*\.?\d*)', 1) AS DOUBLE)"


def _bounds_sql(ranged: str, upper: str, single: str, scale: str, key: str, source: str) -> str:
    r1, r2, u, s = (f"regexp_extract(t, '{p}', {g})" for p, g in ((ranged, 1), (ranged, 2), (upper, 1), (single, 1)))
    return f"""SELECT {key}, {scale.format(f"CASE WHEN {r1} <> '' THEN {_num(r1)} WHEN {u} <> '' THEN NULL ELSE {_num(s)} END")} AS low, {scale.format(f"CASE WHEN {r1} <> '' THEN {_num(r2)} WHEN {u} <> '' THEN {_num(u)} ELSE {_num(s)} END")} AS high
FROM (SELECT {key}, amount, replace(amount, ',', '') AS t FROM {source})"""


@query(_bounds_sql(r"(?i)\$\s*([\d.]+)\s*(?:to|-|–|—)\s*\$\s*([\d.]+)", r"(?i)up\s+to\s+\$\s*([\d.]+)", r"\$\s*([\d.]+)", "{0}", "raw_id", "raw_grants"))
def article_amount(spark, folder):
    return table(spark, folder, "raw_grants").select("raw_id", amounts.article_bounds(F.col("amount")).alias("b")).select("raw_id", "b.low", "b.high")


@query("SELECT grant_id, CASE WHEN k AND low < 1000 THEN low * 1000 ELSE low END AS low, CASE WHEN k AND high < 1000 THEN high * 1000 ELSE high END AS high FROM (SELECT x.*, contains(lower(g.amount), 'k') AS k FROM (" + _bounds_sql(r"\$?([\d.]+)\s*[kK]?\s*(?:-|–|—|to)+\s*\$?([\d.]+)", r"(?i)up\s+to\s+\$?([\d.]+)", r"\$?([\d.]+)", "{0}", "grant_id", "grants") + ") x JOIN grants g USING (grant_id))")
def table_amount(spark, folder):
    return table(spark, folder, "grants").select("grant_id", amounts.table_bounds(F.col("amount")).alias("b")).select("grant_id", "b.low", "b.high")


# ---- dates and fields


@query(
    r"""SELECT raw_id, strftime(CASE WHEN NOT open AND year(d) >= 2024 THEN d END, '%Y-%m-%d') AS day, open FROM (SELECT raw_id, coalesce(regexp_matches(deadline, '(?i)rolling|ongoing|year-round|open|varies|tbd|n/a'), false) AS open,
CASE WHEN t IS NULL THEN NULL ELSE coalesce(try_strptime(nullif(regexp_extract(t, '^(\d{4}-\d{2}-\d{2})', 1), ''), '%Y-%m-%d'), CASE WHEN regexp_full_match(t, '[A-Za-z]+ \d{1,2}, \d{4}') THEN coalesce(try_strptime(t, '%B %d, %Y'), try_strptime(t, '%b %d, %Y')) END, CASE WHEN regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(t, '%m/%d/%Y') END) END AS d
FROM (SELECT *, trim(deadline) AS t FROM raw_grants))"""
)
def article_deadline(spark, folder):
    d = F.col("deadline")
    return table(spark, folder, "raw_grants").select("raw_id", F.date_format(dates.written_day(d), "yyyy-MM-dd").alias("day"), dates.open_ended(d).alias("open"))


@query()
def deadline_in_text(spark, folder):
    return table(spark, folder, "raw_grants").select("raw_id", dates.labelled_deadline(2026)(F.concat_ws(" ", F.concat(F.lit("Deadline: "), "deadline"), "description")).alias("day"))


@query()
def date_candidates(spark, folder):
    rows = table(spark, folder, "grants").select("grant_id", F.try_to_timestamp(F.regexp_extract("deadline", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).alias("d"), dates.date_candidates(2026)(F.col("description")).alias("found"))
    return rows.select("grant_id", F.size("found").alias("n"), dates.needs_check(F.col("d"), F.col("found"), _at().cast("timestamp")).alias("check"))


@query(f"SELECT id, strftime(CASE WHEN year(deadline) >= year(TIMESTAMP '{AS_OF}') - 1 AND year(deadline) <= year(TIMESTAMP '{AS_OF}') + 10 THEN deadline END, '{DAY}') AS deadline FROM (SELECT o_orderkey AS id, o_orderdate AS deadline FROM orders)")
def deadline_in_years(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _stamp(dates.in_years(F.col("o_orderdate"), as_of()), "deadline"))


FIELD_LABELS = ["Deadline", "Match required", "Contact", "Phone"]
_FIELD = "CASE WHEN {0} <> '' AND NOT regexp_matches({0}, '(?i)^(?:amount|deadline|eligibility|apply|award|who can)') THEN {0} END"


@query("SELECT grant_id, coalesce(" + ", ".join(_FIELD.format(rf"trim(regexp_extract(description, '(?im)(?:^|\n)\s*{x}[.:\s]+([^\n]{{3,150}})', 1))") for x in FIELD_LABELS) + ") AS value FROM grants")
def labeled_fields(spark, folder):
    return table(spark, folder, "grants").select("grant_id", text.labeled_field(F.col("description"), FIELD_LABELS).alias("value"))


@query(r"SELECT raw_id, trim(regexp_replace(CAST(raw_id AS VARCHAR) || '. ' || title, '^\d+\.\s*', '')) AS title FROM raw_grants")
def clean_title(spark, folder):
    return table(spark, folder, "raw_grants").select("raw_id", text.unnumbered(F.concat(F.col("raw_id").cast("string"), F.lit(". "), "title")).alias("title"))


HASH_SQL = r"sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}', '', 'g'), '\d{{10,13}}', '', 'g'), '(?i)csrf[^\"'']*[\"''][^\"'']*[\"'']', '', 'g'), '\s+', ' ', 'g')))"


@query("SELECT doc_id, " + HASH_SQL.format("text") + " AS hash FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT grant_id, 'mailto:?subject=' || url_encode(title) || '&body=' || url_encode(CASE WHEN length(description) > 1800 THEN left(description, 1800) || chr(10) || chr(10) || '…(truncated — see attached export for full list)' ELSE description END) AS link FROM grants")
def mail_links(spark, folder):
    return table(spark, folder, "grants").select("grant_id", text.mail_link(F.col("title"), F.col("description")).alias("link"))


# ---- addresses


#: Addresses with what is known of them: whether they are safe, why they are refused, whether they are a bare home.
ADDRESSES = (
    ("https://example.com/grants", True, None, True), ("http://example.com", True, None, True), ("https://example.com/", True, None, True), ("https://example.com/about", True, None, True),
    ("https://example.com/contact", True, None, True), ("https://example.com/business", True, None, True), ("https://example.com/MAIN/", True, None, True), ("https://example.com/grants/small-business-2024", True, None, False),
    ("https://example.com/programs/sbir-2025", True, None, False), ("https://example.com/apply", True, None, False), ("https://93.184.216.34/x", True, None, False),
    ("http://10.0.0.1/x", False, "blocked_host", False), ("http://192.168.1.1", False, "blocked_host", True), ("http://127.0.0.1:8080/x", False, "blocked_host", False), ("http://172.16.0.1/x", False, "blocked_host", False),
    ("http://172.32.0.1/x", True, None, False), ("http://169.254.169.254/latest", False, "blocked_host", False), ("http://100.100.100.200/x", False, "blocked_host", False), ("http://metadata.google.internal/x", False, "blocked_host", False),
    ("http://0.0.0.0/x", False, "blocked_host", False), ("http://[::1]/x", False, "blocked_host", False), ("http://[::1]:8080/x", False, "blocked_host", False), ("http://[::ffff:127.0.0.1]/x", False, "blocked_host", False),
    ("http://[::ffff:10.0.0.1]/x", False, "blocked_host", False), ("http://[::ffff:192.168.1.1]/x", False, "blocked_host", False), ("http://[fe80::1]/x", False, "blocked_host", False), ("ftp://example.com/x", False, "invalid_protocol", False),
    ("javascript:alert(1)", False, "invalid_protocol", False), ("file:///etc/passwd", False, "invalid_protocol", False), ("not-a-url", False, "malformed", False), ("", False, "empty", False), ("   ", False, "empty", False),
    ("https://example.com/" + "a" * 2100, True, "too_long", False),
)
_lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
HOME_WORDS = "'about','contact','home','index','main','welcome','business','programs','grants','funding','resources','services','help','support','faq','blog','news','partners','sponsors','donate','join','membership'"
_TRIMMED = "regexp_replace(regexp_extract(source_url, '^(?i)https?://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g')"


def _addresses(spark, folder):
    given = spark.createDataFrame([(u,) for u, *_ in ADDRESSES], "url string")
    return table(spark, folder, "grants").select(F.col("source_url").alias("url")).distinct().unionByName(given)


def _address_sql(column: str, at: int, of_data: str) -> str:
    given = ", ".join(f"({_lit(x[0])}, {_lit(x[at])})" for x in ADDRESSES)
    return f"SELECT url, CAST({column} AS {'VARCHAR' if column == 'refused' else 'BOOLEAN'}) AS {column} FROM (VALUES {given}) AS v(url, {column}) UNION ALL SELECT DISTINCT source_url, {of_data} FROM grants"


@query(_address_sql("safe", 1, "regexp_matches(source_url, '^(?i)https?://[a-z0-9.-]+\\.example([/?#]|$)')"))
def safe_url(spark, folder):
    return _addresses(spark, folder).select("url", urls.is_safe(F.col("url")).alias("safe"))


@query(_address_sql("refused", 2, "CASE WHEN NOT regexp_matches(source_url, '^(?i)https?://[a-z0-9.-]+\\.example([/?#]|$)') THEN 'malformed' END"))
def refused_url(spark, folder):
    return _addresses(spark, folder).select("url", urls.refusal(F.col("url")).alias("refused"))


@query(_address_sql("home", 3, f"({_TRIMMED} = '' OR (NOT contains({_TRIMMED}, '/') AND lower({_TRIMMED}) IN ({HOME_WORDS})))"))
def generic_homepage(spark, folder):
    return _addresses(spark, folder).select("url", urls.is_generic_home(F.col("url")).alias("home"))


@query("SELECT grant_id, lower(regexp_extract(source_url, '^(?i)(https?://[^/?#]+)', 1)) || CASE WHEN regexp_matches(source_url, '^(?i)https?://[^/?#]+/') THEN '' ELSE '/' END || regexp_extract(source_url, '^(?i)https?://[^/?#]+(.*)$', 1) AS url FROM grants")
def sanitized_url(spark, folder):
    return table(spark, folder, "grants").select("grant_id", urls.sanitized(F.col("source_url")).alias("url"))


@query("SELECT host, count(*) AS n FROM (SELECT DISTINCT lower(regexp_extract(source_url, '^(?i)https?://([^/?#]+)', 1)) AS host, source_url FROM grants) GROUP BY 1 HAVING count(*) >= 2")
def hosts_with_several(spark, folder):
    rows = table(spark, folder, "grants").select("source_url").distinct().select(urls.part(F.col("source_url"), "host").alias("host"))
    return rows.groupBy("host").agg(F.count("*").alias("n")).where("n >= 2")


# ---- merging in order


KEYED = r"length(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) > 10"
MERGE_SQL = f"""WITH RECURSIVE snap AS (SELECT * FROM (SELECT apply_url AS source_url, 'r' || raw_id AS id, title, deadline, row_number() OVER (PARTITION BY apply_url ORDER BY raw_id) AS k FROM raw_grants WHERE apply_url IS NOT NULL AND title IS NOT NULL) WHERE k = 1),
b AS (SELECT row_number() OVER (ORDER BY seq) AS i, grant_id, source_url AS u, lower(title) AS t, {KEYED} AS g FROM grants),
s(i, st, grant_id, action) AS (SELECT CAST(0 AS BIGINT), (SELECT list({{'u': source_url, 't': lower(title)}}) FROM snap), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) UNION ALL
SELECT b.i, CASE WHEN known THEN list_transform(st, lambda x: CASE WHEN x.u = b.u THEN {{'u': x.u, 't': b.t}} ELSE x END) WHEN taken THEN st ELSE list_append(st, {{'u': b.u, 't': b.t}}) END, b.grant_id, CASE WHEN known THEN 'updated' WHEN taken THEN 'skipped' ELSE 'created' END
FROM (SELECT s.st, b.*, len(list_filter(s.st, lambda x: x.u = b.u)) > 0 AS known, b.g AND len(list_filter(s.st, lambda x: x.t = b.t)) > 0 AS taken FROM s JOIN b ON b.i = s.i + 1) AS b),
act AS (SELECT grant_id, action FROM s WHERE i > 0)"""


def _merge_sides(spark, folder):
    raw = table(spark, folder, "raw_grants").where("apply_url is not null and title is not null")
    snapshot = raw.groupBy(F.col("apply_url").alias("source_url")).agg(*[F.min_by(c, "raw_id").alias(c) for c in ("title", "deadline")], F.concat(F.lit("r"), F.min("raw_id").cast("string")).alias("id"))
    batch = table(spark, folder, "grants").select("source_url", F.col("grant_id").alias("id"), "title", "deadline", "seq")
    return snapshot, batch


@query(MERGE_SQL + " SELECT grant_id, action FROM act")
def upsert_actions(spark, folder):
    snapshot, batch = _merge_sides(spark, folder)
    return batch.select(F.col("id").alias("grant_id"), "seq").join(upsert.decided(snapshot, batch), "seq").select("grant_id", "action")


@query(
    MERGE_SQL
    + """, f AS (SELECT source_url, max_by(title, seq) AS title, max_by(deadline, seq) FILTER (deadline IS NOT NULL) AS deadline, min_by(grant_id, seq) AS id FROM grants JOIN act USING (grant_id) WHERE action <> 'skipped' GROUP BY 1)
SELECT coalesce(o.source_url, f.source_url) AS source_url, coalesce(o.id, f.id) AS id, CASE WHEN f.source_url IS NULL THEN o.title ELSE f.title END AS title, coalesce(f.deadline, o.deadline) AS deadline, CASE WHEN f.source_url IS NULL THEN 'kept' WHEN o.source_url IS NULL THEN 'created' ELSE 'updated' END AS action FROM snap o FULL JOIN f ON o.source_url = f.source_url"""
)
def upsert_merge(spark, folder):
    merged = upsert.merge_snapshot(*_merge_sides(spark, folder), kept=("deadline",), overwritten=("title",), created=("id",))
    return merged.select("source_url", "id", "title", "deadline", "action")


@query(
    r"""WITH RECURSIVE r AS (SELECT raw_id, coalesce(source_name, '') AS g, apply_url AS u, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t, row_number() OVER (PARTITION BY source_name ORDER BY raw_id) AS i FROM raw_grants),
s(g, i, us, ts, raw_id, kept) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), false FROM r UNION ALL
SELECT g, i, CASE WHEN free AND u IS NOT NULL THEN list_append(us, u) ELSE us END, CASE WHEN free AND t IS NOT NULL THEN list_append(ts, t) ELSE ts END, raw_id, free FROM (SELECT r.*, s.us, s.ts, NOT (coalesce(list_contains(s.us, r.u), false) OR coalesce(list_contains(s.ts, r.t), false)) AS free FROM s JOIN r ON r.g = s.g AND r.i = s.i + 1))
SELECT s.raw_id, source_name, title FROM s JOIN raw_grants USING (raw_id) WHERE kept"""
)
def source_sections(spark, folder):
    rows = table(spark, folder, "raw_grants").withColumn("title_key", text.alnum_key(F.col("title")))
    return upsert.two_key_dedupe(rows, "source_name", "apply_url", "title_key", "raw_id").select("raw_id", "source_name", "title")


@query("SELECT grant_id, CASE WHEN NOT coalesce(length(title) >= 3, false) THEN 'title' WHEN NOT coalesce(amount_max IS NULL OR (amount_max >= 0 AND amount_max <= 2147483647), false) THEN 'amount' WHEN NOT coalesce(status IN ('OPEN', 'CLOSED', 'FORECASTED'), false) THEN 'status' END AS reject_reason FROM grants")
def rejected_rows(spark, folder):
    checks = {"title": F.length("title") >= 3, "amount": F.col("amount_max").isNull() | F.col("amount_max").between(0, 2**31 - 1), "status": F.col("status").isin("OPEN", "CLOSED", "FORECASTED")}
    return records.rejected(table(spark, folder, "grants"), checks).select("grant_id", "reject_reason")


# ---- changes


CHANGE_SQL = f"""c AS (SELECT *, row_number() OVER (PARTITION BY article_page, title ORDER BY captured_at, raw_id) AS a, row_number() OVER (PARTITION BY article_page, title ORDER BY captured_at DESC, raw_id DESC) AS z FROM raw_grants WHERE article_page IS NOT NULL AND title IS NOT NULL),
d AS (SELECT f.article_page, f.title, l.captured_at AS moment, {HASH_SQL.format("f.description")} AS old, {HASH_SQL.format("l.description")} AS new FROM c f JOIN c l ON f.article_page = l.article_page AND f.title = l.title WHERE f.a = 1 AND l.z = 1),
e AS (SELECT article_page, title, coalesce(new, old) AS content_hash, new IS NOT NULL AND new IS DISTINCT FROM old AS needs_reparse, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM old THEN moment END AS last_changed FROM d)"""


def _changes(spark, folder):
    rows = table(spark, folder, "raw_grants").where("article_page is not null and title is not null")
    rows = rows.select(F.struct("article_page", "title").alias("url"), F.col("description").alias("body"), "captured_at", "raw_id")
    first = rows.groupBy("url").agg(F.min_by(F.struct("body"), F.struct("captured_at", "raw_id")).alias("r"))
    none = F.lit(None)
    snapshot = first.select("url", text.content_hash(F.col("r.body")).alias("content_hash"), none.cast("timestamp_ntz").alias("last_checked"), none.cast("timestamp_ntz").alias("last_changed"), F.lit(False).alias("needs_reparse"))
    return change.detect_changes(snapshot, change.latest_capture(rows, "url", "captured_at", "raw_id"))


@query(f"WITH {CHANGE_SQL} SELECT article_page, title, content_hash, needs_reparse, strftime(last_changed, '{DAY}') AS last_changed FROM e")
def change_detect(spark, folder):
    return _changes(spark, folder).select("url.article_page", "url.title", "content_hash", "needs_reparse", _stamp("last_changed", "last_changed"))


@query(f"WITH {CHANGE_SQL} SELECT article_page, title FROM e WHERE needs_reparse")
def reparse_queue(spark, folder):
    return _changes(spark, folder).where("needs_reparse").select("url.article_page", "url.title")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(event_id, user_id, us, i, start, nth) AS (SELECT event_id, user_id, us, i, us, CAST(1 AS BIGINT) FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.us, e.i, CASE WHEN e.us > w.start + 86400000000 THEN e.us ELSE w.start END, CASE WHEN e.us > w.start + 86400000000 THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, us, nth, nth <= 3 AS allowed FROM w"""
)
def rate_limit_fixed_window(spark, folder):
    return limited(table(spark, folder, "events"), 86_400_000_000, 3)


@query("SELECT 'anchor ' || i AS query, CAST(i AS INTEGER) AS place FROM range(6) t(i) UNION ALL SELECT 'topic ' || ((82194 + k) % 60), CAST(6 + k AS INTEGER) FROM range(10) t(k)")
def query_rotation(spark, folder):
    return adapters.rotation(spark, [f"anchor {i}" for i in range(6)], [f"topic {i}" for i in range(60)], 16, 1_775_390_400)


# ---- verdicts of a model


ASKED_SQL = "q AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 10 AS batch, CAST((row_number() OVER (ORDER BY seq) - 1) % 10 AS INTEGER) AS index FROM grants)"
REPLY_SQL = "length(title) % 7 <> 0 AND length(description) % 5 <> 0 AND length(title) % 3 = 0 AND length(title) % 4 <> 1"


def _asked(spark, folder):
    rows = table(spark, folder, "grants").select("seq", "grant_id", "title", "description")
    return verdicts.asked(rows, "seq", 10, 200)


def _replies(asked):
    """Recorded replies: some rows are missing, and each batch has one beyond its end."""
    n = lambda c: F.length(c)
    own = asked.where(n("title") % 11 != 0).select("batch", "index", (n("title") % 7 != 0).alias("is_real"), (n("description") % 5 != 0).alias("eligible"), F.when(n("title") % 3 == 0, "grant_application").otherwise("news").alias("kind"), F.when(n("title") % 4 == 1, "LOW").otherwise("HIGH").alias("confidence"))
    beyond = asked.select("batch").distinct().select("batch", F.lit(10).alias("index"), F.lit(True).alias("is_real"), F.lit(True).alias("eligible"), F.lit("grant_application").alias("kind"), F.lit("HIGH").alias("confidence"))
    return own.unionByName(beyond)


@query(f"WITH {ASKED_SQL} SELECT grant_id, batch, index, {REPLY_SQL} AS accepted FROM q WHERE batch < 200 AND length(title) % 11 <> 0")
def verdicts_by_position(spark, folder):
    asked = _asked(spark, folder)
    got = verdicts.answered(asked, _replies(asked))
    return got.select("grant_id", "batch", "index", verdicts.accepted(F.col("is_real"), F.col("eligible"), F.col("kind"), F.col("confidence")).alias("accepted"))


@query(f"WITH {ASKED_SQL} SELECT count(DISTINCT batch) AS calls, count(*) AS records, CAST(sum(length(description) // 4) AS BIGINT) AS tokens FROM q WHERE batch < 200")
def verdict_budget(spark, folder):
    return verdicts.spent(_asked(spark, folder), F.floor(F.length("description") / 4).cast("bigint"))


@query("SELECT grant_id, CASE WHEN length(title) % 3 = 0 THEN 'About ' || trim(title) ELSE description END AS description, CASE WHEN length(title) % 3 = 0 THEN description END AS original FROM grants")
def described_rows(spark, folder):
    wrote = F.when(F.length("title") % 3 == 0, F.concat(F.lit(" About "), F.trim("title"), F.lit(" "))).otherwise(F.lit(" "))
    return table(spark, folder, "grants").select("grant_id", verdicts.described(F.col("description"), wrote).alias("d")).select("grant_id", "d.description", "d.original")


@query("SELECT method, outcome, count(*) AS n FROM (SELECT CASE WHEN w OR f THEN 'ai' WHEN m THEN 'merged' ELSE 'regex' END AS method, CASE WHEN w THEN 'overwritten' WHEN f THEN 'filled' WHEN m AND deadline <> found THEN 'disagreement' ELSE 'unchanged' END AS outcome FROM (SELECT *, c = 'HIGH' AND found IS NOT NULL AS w, c = 'MEDIUM' AND found IS NOT NULL AND deadline IS NULL AS f, c = 'MEDIUM' AND found IS NOT NULL AND deadline IS NOT NULL AS m FROM (SELECT deadline, CASE WHEN length(title) % 3 <> 0 THEN '2026-05-01' END AS found, CASE length(title) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS c FROM grants))) GROUP BY 1, 2")
def reconcile_counts(spark, folder):
    found = F.when(F.length("title") % 3 != 0, F.lit("2026-05-01"))
    confidence = F.when(F.length("title") % 4 == 0, "HIGH").when(F.length("title") % 4 == 1, "LOW").otherwise("MEDIUM")
    r = table(spark, folder, "grants").select(upsert.reconciled_deadline(F.col("deadline"), found, confidence).alias("r"))
    return r.groupBy("r.method", "r.outcome").agg(F.count("*").alias("n"))


# ---- liveness


MARKERS = ["no longer available", "page not found", "has been removed"]
CODE_SQL = "CAST(json_extract_string(raw_data, '$.closedReason.status') AS BIGINT)"
BODY_SQL = "json_extract_string(raw_data, '$.liveBodyText')"
HEALTH_SQL = f"h AS (SELECT *, CASE WHEN NOT coalesce(code BETWEEN 200 AND 299, false) THEN 'http_error' WHEN body IS NULL THEN 'non_html' WHEN (contains(lower(left(body, 2000)), 'no longer available') OR contains(lower(left(body, 2000)), 'page not found') OR contains(lower(left(body, 2000)), 'has been removed')) AND length(body) < 3000 THEN 'soft_404' END AS dead FROM (SELECT *, coalesce({CODE_SQL}, 200) AS code, {BODY_SQL} AS body FROM grants WHERE raw_data IS NOT NULL AND json_valid(raw_data)))"


def _checked(spark, folder):
    spec = "liveBodyText string, closedReason struct<status: bigint>"
    rows = table(spark, folder, "grants").where("raw_data is not null").withColumn("r", F.from_json("raw_data", spec))
    return rows.withColumn("dead", liveness.health(F.col("source_url"), F.coalesce("r.closedReason.status", F.lit(200)), F.col("r.liveBodyText"), MARKERS))


@query(f"WITH {HEALTH_SQL} SELECT grant_id, dead FROM h")
def page_health(spark, folder):
    return _checked(spark, folder).select("grant_id", "dead")


SWEEP_SQL = f"WITH {HEALTH_SQL}, w AS (SELECT *, CASE WHEN length(title) % 13 = 0 THEN 'error' WHEN dead IS NOT NULL OR length(title) % 5 = 0 THEN 'closed' ELSE 'kept' END AS outcome FROM h) "


def _swept(spark, folder):
    return liveness.swept(_checked(spark, folder), F.col("dead"), F.length("title") % 13 == 0, F.length("title") % 5 != 0, _at())


@query(SWEEP_SQL + f"SELECT grant_id, outcome, CASE WHEN outcome = 'closed' THEN 'CLOSED' ELSE status END AS status, strftime(CASE WHEN outcome = 'kept' THEN {AT_SQL} ELSE last_verified END, '{DAY}') AS last_verified FROM w")
def revalidated(spark, folder):
    return _swept(spark, folder).select("grant_id", "outcome", "status", _stamp("last_verified", "last_verified"))


@query(SWEEP_SQL + "SELECT count(*) AS checked, count(*) FILTER (outcome = 'closed') AS closed, count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'error') AS errors FROM w")
def revalidation_counts(spark, folder):
    return liveness.sweep_counts(_swept(spark, folder))


@query("SELECT grant_id, list_aggregate(list_sort(list_distinct(list_append(list_filter(json_keys(raw_data), lambda k: k NOT IN ('liveBodyText', 'closedReason')), 'closedReason'))), 'string_agg', ',') AS members FROM grants WHERE raw_data IS NOT NULL AND json_valid(raw_data)")
def closed_raw_data(spark, folder):
    raw = F.from_json("raw_data", "map<string,string>")
    after = records.closed(raw, F.lit("url-health"), F.lit(404), F.lit("page not found"), F.lit(AT))
    return table(spark, folder, "grants").where("raw_data is not null").select("grant_id", F.array_join(F.array_sort(F.map_keys(after)), ",").alias("members"))


@query(f"SELECT raw_id, CASE WHEN apply_url IS NOT NULL AND apply_url NOT IN (SELECT apply_url FROM raw_grants WHERE apply_url IS NOT NULL AND title IS NULL) THEN apply_url ELSE article_page END AS url FROM raw_grants")
def first_healthy_url(spark, folder):
    rows = table(spark, folder, "raw_grants").withColumn("candidates", F.array("apply_url"))
    dead = rows.where("apply_url is not null and title is null").select(F.col("apply_url").alias("url"))
    alive = rows.withColumn("candidates", F.array_compact("candidates"))
    return liveness.first_healthy(alive, "candidates", "raw_id", dead, F.col("article_page"))


# ---- ledger and stored tables


def _ledger(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(kind == "click", "running").when(kind == "error", "failed").otherwise("success").alias("status"))


RUNS_AT = "TIMESTAMP '2024-01-15 12:00:00'"


@query(f"SELECT event_id AS run_id, CASE WHEN event_type = 'click' AND ts < {RUNS_AT} - INTERVAL 10 MINUTE THEN 'failed' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, event_type = 'click' AND ts >= {RUNS_AT} - INTERVAL 10 MINUTE AS holds FROM events")
def run_lock(spark, folder):
    return ledger.locked(_ledger(spark, folder), F.expr(RUNS_AT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("run_id", "status", "holds")


@query("SELECT event_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_runs(spark, folder):
    return ledger.last_runs(_ledger(spark, folder)).select("run_id")


@query("SELECT (SELECT count(notice_id) FROM sam_opportunities) + (SELECT count(opp_id) FROM grants_gov_hits) AS found, count(*) AS runs FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)")
def run_finished(spark, folder):
    rows = _ledger(spark, folder).withColumns({"found": F.lit(None).cast("bigint"), "finished_at": F.lit(None).cast("timestamp_ntz")})
    latest = ledger.last_runs(rows, 1).first()
    log = _found(spark, folder)
    done = ledger.finished(rows, F.col("run_id") == (latest.run_id if latest else None), log, _at())
    return done.where("finished_at is not null").agg(F.max("found").alias("found"), F.count("*").alias("runs"))


def _found(spark, folder):
    """What each source found."""
    a = table(spark, folder, "sam_opportunities").agg(F.count("notice_id").alias("found"))
    return a.unionByName(table(spark, folder, "grants_gov_hits").agg(F.count("opp_id").alias("found")))


@query("SELECT grant_id, CASE WHEN length(title) % 2 = 0 THEN nullif(trim(CASE WHEN length(title) % 4 = 0 THEN '  ' ELSE ' Open to all ' END), '') ELSE eligibility END AS eligibility, CASE WHEN length(title) % 2 = 0 THEN ['Somewhere'] ELSE locations END AS locations FROM grants")
def admin_update(spark, folder):
    rows = table(spark, folder, "grants").select("grant_id", "eligibility", "locations", "title")
    patches = rows.where(F.length("title") % 2 == 0).select("grant_id", F.array(F.lit("eligibility"), F.lit("locations")).alias("fields"), F.when(F.length("title") % 4 == 0, "  ").otherwise(" Open to all ").alias("eligibility"), F.array(F.lit(" Somewhere "), F.lit(" ")).alias("locations"))
    return records.patched(rows, patches, "grant_id", texts=("eligibility",), lists=("locations",)).select("grant_id", "eligibility", "locations")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 2, 3, 5, 8)")
def bulk_delete(spark, folder):
    return records.removed(table(spark, folder, "customer"), [1, 2, 3, 5, 8], "c_custkey").select("c_custkey")


@query(
    """WITH o AS (SELECT article_page AS url, min_by(source_name, raw_id) AS source_name, true AS flagged FROM raw_grants WHERE article_page IS NOT NULL GROUP BY 1), n AS (SELECT source_url AS url, max_by(source_name, seq) AS source_name FROM grants GROUP BY 1
UNION ALL SELECT article_page, 'renamed' FROM raw_grants WHERE article_page IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT coalesce(o.url, n.url) AS url, coalesce(n.source_name, o.source_name) AS source_name, o.flagged FROM o FULL JOIN n ON o.url = n.url"""
)
def monitored_urls(spark, folder):
    raw, grants = table(spark, folder, "raw_grants").where("article_page is not null"), table(spark, folder, "grants")
    stored = raw.groupBy(F.col("article_page").alias("url")).agg(F.min_by("source_name", "raw_id").alias("source_name"), F.lit(True).alias("flagged"))
    again = raw.groupBy(F.col("article_page").alias("url")).agg(F.count("*").alias("n")).where("n > 1").select("url", F.lit("renamed").alias("source_name"), F.lit(1).alias("seq"))
    batch = grants.select(F.col("source_url").alias("url"), "source_name", "seq").unionByName(again)
    return records.upserted(stored, batch, "url", ("source_name",), "seq").select("url", "source_name", "flagged")


@query("SELECT p_brand AS name, 'Label of ' || p_brand AS label FROM part GROUP BY 1 UNION ALL SELECT 'NEW', 'New label'")
def seed_labels(spark, folder):
    stored = table(spark, folder, "part").groupBy(F.col("p_brand").alias("name")).agg(F.lit("old").alias("label"))
    seeds = stored.select("name", F.concat(F.lit("Label of "), "name").alias("label")).unionByName(spark.createDataFrame([("NEW", "New label")], "name string, label string"))
    return records.upserted(stored, seeds, "name", ("label",)).select("name", "label")


@query("SELECT c_custkey, c_nationkey + 1 AS version FROM customer")
def bulk_increment(spark, folder):
    return records.incremented(table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("version")), "version")


# ---- sources united


@query(
    """SELECT 'notices' AS source, CAST(sam_row AS VARCHAR) AS record, title FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY sam_row) AS k FROM sam_opportunities) WHERE k = 1 OR notice_id IS NULL
UNION ALL SELECT 'hits', CAST(hit_row AS VARCHAR), title FROM (SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY hit_row) AS k FROM grants_gov_hits) WHERE k = 1 OR opp_id IS NULL UNION ALL SELECT 'pdfs', grant_id, title FROM grants WHERE lower(pdf_url) LIKE '%.pdf'"""
)
def sources_united(spark, folder):
    own = lambda name, rows, key: rows.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("record"), "title")
    parts = [own("notices", adapters.notices(table(spark, folder, "sam_opportunities")), "seq"), own("hits", adapters.search_hits(table(spark, folder, "grants_gov_hits")), "seq")]
    pdfs = own("pdfs", table(spark, folder, "grants").where(F.lower("pdf_url").endswith(".pdf")), "grant_id")
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(pdfs)


@query("SELECT s_suppkey, s_name AS name, CAST(s_acctbal AS VARCHAR) AS amount, CAST(s_nationkey AS VARCHAR) AS place FROM supplier")
def matched_records(spark, folder):
    s = table(spark, folder, "supplier")
    fields = F.create_map(F.lit("Program Name"), F.col("s_name"), F.lit("award amount"), F.col("s_acctbal").cast("string"), F.lit("Where (place)"), F.col("s_nationkey").cast("string"))
    wanted = {"name": ["Title", "Program Name"], "amount": ["Award Amount"], "place": ["place"]}
    return adapters.matched_fields(s.select("s_suppkey", fields.alias("fields")), wanted).select("s_suppkey", "name", "amount", "place")


@query("SELECT source_name AS feed, title FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY raw_id) AS k FROM (SELECT * FROM raw_grants WHERE source_name IS NOT NULL AND regexp_full_match(title, '[A-Za-z0-9 ]*[A-Za-z0-9]') AND NOT contains(title, '  ') AND left(title, 1) <> ' ' AND captured_at >= TIMESTAMP '2025-12-01 00:00:00')) WHERE k <= 10")
def feed_items(spark, folder):
    rows = table(spark, folder, "raw_grants").where(F.col("source_name").isNotNull() & F.col("title").rlike("^[A-Za-z0-9 ]*[A-Za-z0-9]$") & ~F.col("title").contains("  ") & ~F.col("title").startswith(" "))
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><pubDate>"), F.date_format("captured_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    each = F.sort_array(F.collect_list(F.struct("raw_id", item.alias("item"))))
    feeds = rows.groupBy(F.col("source_name").alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(each, lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("xml"))
    return adapters.feed_items(feeds, F.expr("TIMESTAMP_NTZ '2026-03-01 00:00:00'"), 10, 90).select("feed", "title")


def _pages(spark, folder):
    rows = table(spark, folder, "grants").where(F.col("raw_data").contains('"pageHtml"'))
    return rows.select("grant_id", "source_url", F.get_json_object("raw_data", "$.pageHtml").alias("page")).where("page is not null")


@query()
def harvested_links(spark, folder):
    return articles.harvested(_pages(spark, folder), "grant_id", "page", "source_url", ["grant", "fund", "program", "/p"], ["privacy", "sitemap"], 1, 10)


@query()
def article_sections(spark, folder):
    pages = _pages(spark, folder).withColumn("page", F.regexp_replace("page", r"<(p|div)>([^<>]{5,60})</\1>", "<h3>$2</h3>"))
    return articles.sections(pages, "grant_id", "page")


@query("SELECT sam_row, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') AND try_strptime(t, '%Y-%m-%d') < " + AT_SQL + " THEN 'CLOSED' ELSE 'OPEN' END AS status FROM (SELECT sam_row, trim(response_dead_line) AS t FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY sam_row) AS k FROM sam_opportunities) WHERE k = 1 OR notice_id IS NULL)")
def notice_status(spark, folder):
    rows = adapters.notices(table(spark, folder, "sam_opportunities"))
    day = F.try_to_timestamp(F.regexp_extract(F.trim("deadline"), r"^(\d{4}-\d{2}-\d{2})$", 1), F.lit("yyyy-MM-dd"))
    return rows.select(F.col("seq").alias("sam_row"), adapters.notice_status(day, _at().cast("timestamp")).alias("status"))


# ---- small ones


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey > 12 THEN '$' || (c_nationkey * 1000) // 1000 || 'k–$' || (c_nationkey * 5000) // 1000 || 'k' WHEN c_acctbal > 0 THEN '$' || c_nationkey || 'k+' WHEN c_nationkey > 12 THEN 'up to $' || c_nationkey * 5 || 'k' END AS chip FROM customer WHERE c_nationkey > 0")
def amount_chips(spark, folder):
    n = F.col("c_nationkey")
    low, high = F.when(F.col("c_acctbal") > 0, n * 1000), F.when(n > 12, n * 5000)
    return table(spark, folder, "customer").where("c_nationkey > 0").select("c_custkey", text.amount_chip(low, high).alias("chip"))


@query("SELECT grant_id, CASE status WHEN 'OPEN' THEN 'Open now' WHEN 'CLOSED' THEN 'Closed' ELSE status END AS label, upper(left(business_stage, 1)) || lower(substr(business_stage, 2)) AS stage FROM grants")
def labels_of_values(spark, folder):
    return table(spark, folder, "grants").select("grant_id", text.labelled(F.col("status"), {"OPEN": "Open now", "CLOSED": "Closed"}).alias("label"), text.pretty(F.col("business_stage")).alias("stage"))


@query("SELECT grant_id, CAST(json_extract_string(raw_data, '$.award.ceiling') AS DOUBLE) AS ceiling FROM grants WHERE raw_data IS NOT NULL")
def fenced_json(spark, folder):
    fenced = F.concat(F.lit("```json\n"), "raw_data", F.lit("\n```"))
    return table(spark, folder, "grants").where("raw_data is not null").select("grant_id", text.json_object(fenced, "award struct<ceiling: double>")["award"]["ceiling"].alias("ceiling"))


@query("SELECT place_name FROM ref_locations WHERE contains(lower(place_name), 'gro') ORDER BY place_name LIMIT 50")
def option_filter(spark, folder):
    return exports.options(table(spark, folder, "ref_locations"), "place_name", "  GRO ")


@query("SELECT least(count(*), 1000) AS taken, count(*) AS total, count(*) > 1000 AS truncated FROM orders")
def export_truncated(spark, folder):
    return table(spark, folder, "orders").agg(F.least(F.count("*"), F.lit(1000)).alias("taken"), F.count("*").alias("total"), (F.count("*") > 1000).alias("truncated"))


@query(r"SELECT doc_id, loans, grants, loans > 3 * grants AS refused FROM (SELECT doc_id, len(regexp_extract_all(t, '\bloan\b')) AS loans, len(regexp_extract_all(t, '\bgrant\b')) AS grants FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def word_counts(spark, folder):
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_count(low, F.lit(r"\bloan\b")).cast("bigint").alias("loans"), F.regexp_count(low, F.lit(r"\bgrant\b")).cast("bigint").alias("grants"))
    return rows.withColumn("refused", F.col("loans") > 3 * F.col("grants"))


SIGNALS = ("apply", "eligible", "award", "deadline|due by", r"\$[0-9]")


@query("SELECT raw_id, n, n >= 2 AS enough FROM (SELECT raw_id, " + " + ".join(f"CAST(regexp_matches(t, '{p}') AS BIGINT)" for p in SIGNALS) + " - CAST(regexp_matches(t, 'how to|guide') AS BIGINT) AS n FROM (SELECT raw_id, lower(coalesce(description, '')) AS t FROM raw_grants))")
def signal_counts(spark, folder):
    t = F.lower(F.coalesce("description", F.lit("")))
    n = sum((t.rlike(p).cast("bigint") for p in SIGNALS), F.lit(0).cast("bigint")) - t.rlike("how to|guide").cast("bigint")
    return table(spark, folder, "raw_grants").select("raw_id", n.alias("n"), (n >= 2).alias("enough"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of this module's queries."""
    return dict(QUERIES)
