"""Captured payloads -> rows of the listing, and the rotation of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.amounts import award_text
from grainmill.operators.windows import cap_per_group, first_wins

HIT = "id string, number string, title string, agency string, openDate string, closeDate string, oppStatus string"
FEED = "title string, link string, description string, pubDate string"


def notices(rows: DataFrame) -> DataFrame:
    """Federal notices: the first fetch of each notice, with its places and address."""
    first = first_wins(rows, ["notice_id"], "sam_row")
    state, city = F.col("place_of_performance.state.name"), F.col("place_of_performance.city.name")
    places = F.array_compact(F.array(F.when(state != "", state), F.when(city != "", city)))
    return first.select(
        F.col("sam_row").alias("seq"), F.col("notice_id").alias("id"), "title", "description", F.col("response_dead_line").alias("deadline"),
        F.when(F.size(places) > 0, places).otherwise(F.array(F.lit("Nationwide"))).alias("locations"),
        F.coalesce(F.when(F.col("ui_link") != "", F.col("ui_link")), F.concat(F.lit("notice:"), F.col("notice_id"))).alias("source_url"),
        F.floor("award.amount").cast("bigint").alias("amount_max"),
    )


def notice_status(deadline: Column, as_of: Column) -> Column:
    """CLOSED once the deadline has passed; without one a notice is open."""
    return F.when(F.coalesce(deadline < as_of, F.lit(False)), "CLOSED").otherwise("OPEN")


def search_hits(rows: DataFrame) -> DataFrame:
    """Search hits: the first of each opportunity, with the award in words and who may apply."""
    first = first_wins(rows, ["opp_id"], "hit_row")
    who = F.substring(F.array_join(F.array_compact(F.array("eligible_applicants", "additional_eligibility_info")), ". "), 1, 1000)
    return first.select(
        F.col("hit_row").alias("seq"), F.col("opp_id").alias("id"), "title", F.substring("synopsis", 1, 2000).alias("description"), F.col("close_date").alias("deadline"),
        award_text(F.col("award_floor"), F.col("award_ceiling"), F.col("estimated_funding")).alias("amount"),
        F.when(who != "", who).alias("eligibility"), F.when(F.lower("opp_status") == "forecasted", "FORECASTED").otherwise("OPEN").alias("status"),
    )


def hits_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The hits of captured search replies, one row each with its place; replies keep them at the top or under data."""
    spec = f"oppHits array<struct<{_struct(HIT)}>>, data struct<oppHits: array<struct<{_struct(HIT)}>>>"
    reply = F.from_json(column, spec)
    return payloads.select("seq", F.posexplode(F.coalesce(reply["oppHits"], reply["data"]["oppHits"])).alias("pos", "h")).select("seq", "pos", "h.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ") for x in ddl.split(",")))


def feed_items(feeds: DataFrame, as_of: Column, most: int = 10, oldest_days: int = 90) -> DataFrame:
    """Items of captured RSS feeds or Atom entries (feed, xml): not older than so many days, so many of each feed.

    Items without a date stay. Only well-formed feeds give items.
    """
    rss = F.from_xml("xml", f"channel struct<item: array<struct<{_struct(FEED)}>>>")
    atom = F.from_xml("xml", "entry array<struct<title: string, link: struct<_href: string>, summary: string, updated: string>>")
    from_atom = F.transform(atom["entry"], lambda e: F.struct(e["title"].alias("title"), e["link"]["_href"].alias("link"), e["summary"].alias("description"), e["updated"].alias("pubDate")))
    items = feeds.select("feed", F.posexplode(F.coalesce(rss["channel"]["item"], from_atom)).alias("pos", "i")).select("feed", "pos", "i.*")
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    fresh = items.where(at.isNull() | (at >= as_of.cast("timestamp") - F.expr(f"INTERVAL {oldest_days} DAY")))
    return cap_per_group(fresh, ["feed"], [F.asc("pos")], most)


def matched_fields(records: DataFrame, wanted: dict[str, list[str]], fields: str = "fields") -> DataFrame:
    """Columns of free-form records (map of name to text), each wanted one by its first known name.

    A name counts if it is equal, then equal but for case, then if one contains the other.
    """

    def where(test, name: str) -> Column:
        return F.try_element_at(F.map_values(F.map_filter(fields, lambda k, v: test(F.lower(k), F.lit(name.lower())))), F.lit(1))

    def pick(names: list[str]) -> Column:
        exact = [F.try_element_at(F.col(fields), F.lit(n)) for n in names]
        alike = [where(lambda k, n: k == n, n) for n in names]
        within = [where(lambda k, n: F.contains(k, n) | F.contains(n, k), n) for n in names]
        return F.coalesce(*exact, *alike, *within)

    return records.select("*", *[pick(names).alias(out) for out, names in wanted.items()])


def rotation(spark: SparkSession, anchors: list[str], rotating: list[str], budget: int, at_s: int, every_s: int = 21_600) -> DataFrame:
    """(query, place): the anchors and as many rotating queries as the budget leaves, from a place that moves on every period."""
    left = max(0, budget - len(anchors))
    fixed = spark.createDataFrame([(q, i) for i, q in enumerate(anchors[:budget])], "query string, place int")
    pool = spark.createDataFrame([(q, i) for i, q in enumerate(rotating)], "query string, pos int")
    n = max(1, len(rotating))
    turn = F.pmod(F.col("pos") - F.lit((at_s // every_s) % n), F.lit(n))
    return fixed.unionByName(pool.where(turn < left).select("query", (turn + len(anchors)).cast("int").alias("place")))
