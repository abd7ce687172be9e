"""Sections of article pages and links of list pages -> records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import text, urls
from grainmill.functions.html import page_links, page_sections
from grainmill.operators.windows import cap_per_group, first_wins

#: Labels of the fields of a section (fixed values), by the column they fill.
FIELDS = {"amount": ["amount", "award amount", "award", "funding"], "deadline": ["application deadline", "deadline", "due date"], "eligibility": ["eligibility", "who can apply", "who is eligible"], "apply": ["how to apply", "apply"]}
#: Lengths of a heading that may name a program, fields that make it one, and signals that do where no section has fields (fixed values).
SHORTEST, LONGEST, FIELDS_WANTED, SIGNALS_WANTED = 5, 200, 2, 2
#: Signs of a program in free text (fixed patterns), and words of headings that only explain.
SIGNALS = (r"\$\s*\d", r"\bdeadline\b|\bdue (?:by|date)\b", r"\beligib", r"\bapply\b|\bapplication", r"\bgrants?\b|\bfunding\b")
EXPLAINS = r"(?i)^(?:how|what|why|when|where|who|tips|guide|faq|frequently|about|conclusion|related)\b"
#: What links to a program's own page say (fixed values).
ACTIONS = ("apply", "learn more", "visit")


def sections(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pos, title, body, fields..., by_fields): the sections of each page that describe a program.

    A section counts if it states FIELDS_WANTED of its fields; on a page where none does, those
    with SIGNALS_WANTED signals count instead. Headings lose the number of a list before them.
    """
    rows = pages.select(key, F.posexplode(page_sections(page)).alias("pos", "x")).select(key, "pos", text.unnumbered(F.col("x.heading")).alias("title"), F.col("x.body").alias("body"))
    rows = rows.where(F.length("title").between(SHORTEST, LONGEST) & ~F.col("title").rlike(EXPLAINS))
    rows = rows.withColumns({name: text.labeled_field(F.col("body"), labels) for name, labels in FIELDS.items()})
    stated = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    signals = sum((F.lower("body").rlike(p).cast("int") for p in SIGNALS), F.lit(0))
    rows = rows.withColumns({"by_fields": stated >= FIELDS_WANTED, "gm_signals": signals})
    whole = rows.groupBy(F.col(key).alias("gm_page")).agg(F.max("by_fields").alias("gm_any"))
    rows = rows.join(whole, F.col(key) == F.col("gm_page"))
    return rows.where(F.col("by_fields") | (~F.col("gm_any") & (F.col("gm_signals") >= SIGNALS_WANTED))).drop("gm_page", "gm_any", "gm_signals")


def candidate_urls(links: Column, site: Column) -> Column:
    """Addresses outside the site: those whose link asks to act first, then the others, each once."""
    outside = F.filter(links, lambda x: ~F.contains(x["url"], site))
    acts = lambda x: F.exists(F.array(*[F.lit(a) for a in ACTIONS]), lambda a: F.contains(F.lower(x["text"]), a))
    first, rest = F.filter(outside, acts), F.filter(outside, lambda x: ~acts(x))
    return F.array_distinct(F.transform(F.concat(first, rest), lambda x: x["url"]))


def harvested(pages: DataFrame, key: str, page: str, base: str, wanted: list[str], unwanted: list[str] = (), segments: int = 1, most: int = 10) -> DataFrame:
    """(key, pos, source_url, title, pdf_url): links of list pages that may lead to a program.

    Text or address must hold a wanted term and no unwanted one, the address at least so many
    path segments, and the first of each address counts, up to `most` a page. A link to a PDF
    gives the page as its address and the PDF beside it.
    """
    rows = pages.select(key, F.col(base).alias("gm_base"), F.posexplode(page_links(page, base)).alias("pos", "x")).select(key, "gm_base", "pos", F.col("x.url").alias("url"), F.col("x.text").alias("title"))
    said = F.concat_ws(" ", F.lower("title"), F.lower("url"))
    rows = rows.where(text.any_phrase(said, list(wanted)) & (F.size(urls.path_segments(F.col("url"))) >= segments))
    if unwanted:
        rows = rows.where(~text.any_phrase(said, list(unwanted)))
    rows = rows.withColumn("gm_same", urls.canonical(F.col("url")))
    rows = cap_per_group(first_wins(rows, [key, "gm_same"], "pos"), [key], [F.asc("pos")], most)
    pdf = F.lower(urls.canonical(F.col("url"))).endswith(".pdf")
    return rows.select(key, "pos", F.when(pdf, F.col("gm_base")).otherwise(F.col("url")).alias("source_url"), "title", F.when(pdf, F.col("url")).alias("pdf_url"))


def expanded(first: DataFrame, second: DataFrame, key: str = "source_url") -> DataFrame:
    """The links of a first pass with those that a second pass, one level down, adds; addresses of the first stay the first's."""
    more = second.join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(more.dropDuplicates([key]), allowMissingColumns=True)
