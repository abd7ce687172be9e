from pyspark.sql import functions as F

from grainmill.functions.html import page_links
from grainmill.sources import articles

PAGE = """<h2>1. Harbor Fund</h2><p>Amount: $5,000 to $9,000</p><p>Deadline: May 1, 2026</p><p>Text</p>
<h2>How to write a plan</h2><p>Amount: none</p><p>Deadline: never ends</p><h2>Tide Fund</h2><p>Apply for a grant of $500</p>
<a href="https://tide.org/x?utm=1">Read</a><a href="https://harbor.org/apply">Apply now</a><a href="/lists/2">Grants, more</a><a href="/grants/a/guide.pdf">Grant guide</a><a href="/grants/a">Grant A</a><a href="/grants/a?x=1">Grant A again</a><a href="/privacy">Grant privacy</a>"""
LOOSE = "<h3>Tide Fund</h3><p>Apply for a grant of $500 by the deadline.</p><h3>Who we are</h3><p>Apply for a grant of $500</p>"


def pages(spark):
    return spark.createDataFrame([("a", PAGE, "https://list.org/lists/1"), ("b", LOOSE, "https://list.org/b"), ("c", None, "https://list.org/c"), ("d", "", None)], "k string, page string, base string")


def test_sections_with_fields_come_before_signals(spark):
    got = {(r.k, r.title, r.by_fields, r.amount) for r in articles.sections(pages(spark), "k", "page").collect()}
    assert got == {("a", "Harbor Fund", True, "$5,000 to $9,000"), ("b", "Tide Fund", False, None)}


def test_links_are_harvested_and_candidates_ordered(spark):
    got = [(r.k, r.source_url, r.pdf_url) for r in articles.harvested(pages(spark), "k", "page", "base", ["grant"], ["privacy"], 2).orderBy("pos").collect()]
    assert got == [("a", "https://list.org/lists/2", None), ("a", "https://list.org/lists/1", "https://list.org/grants/a/guide.pdf"), ("a", "https://list.org/grants/a", None)]
    assert articles.harvested(pages(spark), "k", "page", "base", ["grant"], most=1).count() == 1
    one = pages(spark).where("k = 'a'").select(articles.candidate_urls(page_links("page", "base"), F.lit("list.org")).alias("u")).first().u
    assert one == ["https://harbor.org/apply", "https://tide.org/x?utm=1"]
    first = spark.createDataFrame([("u1", 1)], "source_url string, pos int")
    second = spark.createDataFrame([("u1", 2), ("u2", 3), ("u2", 3)], "source_url string, pos int")
    assert sorted(tuple(r) for r in articles.expanded(first, second).collect()) == [("u1", 1), ("u2", 3)]
