import pytest
from pyspark.sql import functions as F

from grainmill.functions import amounts, dates, html, text, urls


def values(spark, kind, items, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, "string", ["Small Business Grant - 2024!", "  Iowa   Grant  ", "", None], text.normal_title) == ["small business grant 2024", "iowa grant", "", None]
    assert values(spark, "string", ["A-b C!9"], text.alnum_key) == ["abc9"]


def test_redaction(spark):
    items = ["123-45-6789", "a 111-22-3333 b 444-55-6666", "phone 1234-56-7890", "code 123-45-67890", "123456789", ""]
    assert values(spark, "string", items, text.redacted) == ["[REDACTED-SSN]", "a [REDACTED-SSN] b [REDACTED-SSN]", *items[2:]]


def test_hash_ignores_dates_and_space(spark):
    a, b, c = values(spark, "string", ["seen 1/2/2026  now", "seen 3/4/2026 now", "seen now else"], text.content_hash)
    assert a == b != c


def test_long_and_short_texts(spark):
    long = "x" * 5001
    got = values(spark, "string", [long, "short", None], text.shortened)
    assert got[0] == "x" * 4985 + "… [truncated]" and got[1:] == ["short", None]
    assert values(spark, "string", ["a" * 130], text.elided) == ["a" * 117 + "..."]
    assert values(spark, "string", ["a", 'a"b', "a,b", None], text.csv_field) == ["a", '"a""b"', '"a,b"', ""]


def test_chips(spark):
    rows = spark.createDataFrame([(10000, None), (1000000, None), (2500000, None), (10000, 50000), (None, 25000), (None, None)], "a long, b long")
    assert [r.y for r in rows.select(text.amount_chip(F.col("a"), F.col("b")).alias("y")).collect()] == ["$10k+", "$1M+", "$2.5M+", "$10k–$50k", "up to $25k", None]


def test_labeled_field(spark):
    got = values(spark, "string", ["Award: $5,000 each\nDeadline: June 1", "nothing", None], lambda c: text.labeled_field(c, ["deadline", "award"]))
    assert got == ["June 1", None, None]


SAFE = ["https://example.com/grants", "http://example.com"]
UNSAFE = ["http://10.0.0.1/", "http://192.168.1.1", "http://127.0.0.1", "http://172.16.0.1", "http://169.254.169.254/x", "http://metadata.google.internal", "http://[::1]", "http://[::1]:8080", "http://[::ffff:127.0.0.1]", "http://[::ffff:7f00:1]", "http://[fe80::1]", "ftp://example.com", "javascript:alert(1)", "file:///etc", "not-a-url", "", None]


def test_safe_addresses(spark):
    assert values(spark, "string", SAFE + UNSAFE, urls.is_safe) == [True] * len(SAFE) + [False] * len(UNSAFE)
    assert values(spark, "string", ["javascript:x", "http://169.254.169.254", "   ", "http://e.org/" + "a" * 2100, "nope", "https://example.com/a"], urls.refusal) == ["invalid_protocol", "blocked_host", "empty", "too_long", "malformed", None]


def test_home_pages(spark):
    items = ["https://example.com/", "https://example.com", "https://example.com/about", "https://example.com/grants", "https://example.com/grants/small-business-2024", "not a url", None]
    assert values(spark, "string", items, urls.is_generic_home) == [True, True, True, True, False, False, False]


@pytest.mark.parametrize(("text_", "low", "high"), [("$12.68M", 12_680_000, 12_680_000), ("$50", None, None), ("$50K", 50_000, 50_000), ("$5,000 to $50,000, total $100,000", 5000, 100_000), ("$10,000 monthly", 10_000, 10_000), ("", None, None)])
def test_amount_bounds(spark, text_, low, high):
    (got,) = values(spark, "string", [text_], amounts.amount_bounds)
    assert (got.low, got.high) == (low, high)


def test_deadline_words(spark):
    now = F.expr("TIMESTAMP_NTZ '2026-04-05 12:00:00'")
    at = lambda c: F.to_timestamp_ntz(c)
    items = ["2026-04-09 12:00:00", "2026-04-06 12:00:00", "2026-05-01 12:00:00", "2026-04-01 12:00:00", None]
    assert values(spark, "string", items, lambda c: dates.urgency_label(at(c), now)) == ["Closing in 4d", "Closing tomorrow", None, None, None]
    assert values(spark, "string", items, lambda c: dates.is_urgent(at(c), now)) == [True, True, False, False, False]
    assert values(spark, "string", ["2026-04-04 10:00:00", "2026-04-12 12:00:00", "2026-04-19 12:00:00", "2026-05-05 12:00:00", "2026-06-04 12:00:00", "2026-06-05 13:00:00"], lambda c: dates.urgency_bucket(at(c), now)) == ["EXPIRED", "THIS WEEK", "NEXT WEEK", "THIS MONTH", "UPCOMING", None]
    assert values(spark, "string", [None, "2026-12-15 17:00:00", "2026-04-15 12:00:00", "2026-01-01 12:00:00"], lambda c: dates.short_deadline(at(c), now)) == ["No deadline", "Dec 15, 2026", "10d left - Apr 15, 2026", "Closed Jan 1, 2026"]


def test_dates_in_prose(spark):
    items = ["Application deadline: January 15, 2026", "This opportunity closes 03/31/2026", "Applications are due by March 15, 2026", "Deadline: 15 March, 2026", "No date here", "Deadline: January 1, 2020", None]
    assert [str(x) for x in values(spark, "string", items, dates.labelled_deadline(2026))] == ["2026-01-15", "2026-03-31", "2026-03-15", "2026-03-15", "None", "None", "None"]


def test_html():
    assert html.text_of('<p>Content</p><script>alert("xss")</script><style>.x{}</style>') == "Content"
    assert html.text_of("  plain   text  ") == "plain text" and html.text_of("") == "" and html.text_of(None) is None
    assert html.text_of("<nav>menu</nav><h2>A</h2><p>b<br>c</p>") == "A\n\nb\nc"
    assert html.links_of('<a href="/x">X  y</a><a href="/x">again</a><a href="mailto:a@b">m</a>', "https://e.org/p/") == [{"url": "https://e.org/x", "text": "X y"}]
    assert html.sections_of("<h2>One</h2><p>a</p><h3>Two</h3><p>b</p>") == [{"heading": "One", "body": "a"}, {"heading": "Two", "body": "b"}]
    assert html.links_of(None, None) == [] and html.sections_of(None) == []
