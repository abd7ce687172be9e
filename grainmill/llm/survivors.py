"""The best values of each group of rows that describe one thing.

Rows are linked by equal titles or equal pages; the groups are the connected components. Per
field the row of the most trusted source survives, and within a source the most current one.
Currency comes from time stamps; where a row has none, it is reasoned: from the groups with
stamps the engine learns which value of a carrier column gives way to which (OPEN before
CLOSED), as a partial order. In each group the rows without a stamp are placed by it: one is
taken as the latest only if its value comes after that of the latest stamped row; values that
the order doesn't compare are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.components import components
from grainmill.operators.instants import InstantDictionary, located, normalise_instants
from grainmill.operators.skew import join_dictionary
from grainmill.runtime import broadcast_if_few, stage

#: Query parameters that only track a visit (fixed values).
TRACKING = "utm_[a-z]+|fbclid|gclid|ref|mc_cid|mc_eid"
#: What names a round or a year in a title: another one is another program.
ROUND = r"(?i)\b(fy ?\d{2,4}|(?:19|20)\d{2}(?:[-/]\d{2,4})?|(?:round|cycle|phase|edition) ?(?:\d+|[ivx]+)|[ivx]{2,4})\b"
#: Texts that say nothing about who may apply (fixed values; compared without case and punctuation).
SAYS_NOTHING = ("", "na", "n a", "none", "none listed", "none stated", "none given", "not specified", "not stated", "not listed", "not available", "not applicable", "unspecified", "unknown", "tbd", "tba", "to be determined", "see website", "see web site", "see notice", "see details", "see link", "varies", "various", "null", "pending", "contact us", "no information")
#: Times that a value must be followed by another, and the share of the times that the two follow each other at all.
VOTES, MAJORITY = 3, 0.8
#: Steps of doubling after which the order of values must be closed: enough for chains of 2 ** 20 values.
DOUBLINGS = 20


def title_key(title: Column) -> Column:
    """A title without case, punctuation and spacing; null if nothing is left."""
    key = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key)


def page_key(url: Column) -> Column:
    """The page that an address leads to: host and path without scheme, www, tracking and fragment; null for a bare home page."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/(index\.(html?|php))?)+$", "")
    asked = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(asked, lambda a: (a != "") & ~a.rlike(rf"(?i)^({TRACKING})(=|$)"))), "&")
    return F.when((host != "") & ((path != "") | (kept != "")), F.concat_ws("", host, path, F.when(kept != "", F.concat(F.lit("?"), kept))))


def rounds_of(title: Column) -> Column:
    """The rounds and years that a title names, in one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(ROUND), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), " ", "")))), "|")


def grouped(rows: DataFrame, key: str = "grant_id", title: str = "title", url: str = "source_url") -> DataFrame:
    """The rows of groups of two or more, with group_id, the smallest key of the group.

    Equal pairs of title and page count as one node, so a program captured a million times is
    one node; only nodes that share a title or a page with another one enter the iteration.
    """
    rows = rows.withColumns({"gm_t": title_key(F.col(title)), "gm_page": page_key(F.col(url))})
    rows = rows.withColumn("gm_p", F.when(F.col("gm_page").isNotNull(), F.concat_ws("\u0001", "gm_page", rounds_of(F.col(title))))).drop("gm_page")
    rows = rows.where("gm_t is not null or gm_p is not null").withColumns({"gm_t": F.coalesce("gm_t", F.concat(F.lit("\u0000"), F.col(key))), "gm_p": F.coalesce("gm_p", F.lit("\u0000"))})
    nodes = stage(rows.groupBy("gm_t", "gm_p").agg(F.min(key).alias("node"), F.count("*").alias("gm_n")), "nodes")
    shared_t = nodes.groupBy("gm_t").agg(F.count("*").alias("c")).where("c > 1")
    shared_p = nodes.where(F.col("gm_p") != "\u0000").groupBy("gm_p").agg(F.count("*").alias("c")).where("c > 1")
    by_t = join_dictionary(nodes.select("node", "gm_t", "gm_p"), stage(shared_t, "shared-titles"), ["gm_t"], "c")
    by_p = join_dictionary(nodes.select("node", "gm_t", "gm_p"), stage(shared_p, "shared-pages"), ["gm_p"], "c")
    linked = by_t.unionByName(by_p).distinct().withColumn("gm_p", F.when(F.col("gm_p") != "\u0000", F.col("gm_p")))
    labels = components(linked, "node", "gm_t", "gm_p")
    nodes = nodes.join(labels, "node", "left").withColumn("group_id", F.coalesce("label", "node")).drop("label")
    nodes = stage(nodes, "labelled-nodes")
    sizes = nodes.groupBy("group_id").agg(F.sum("gm_n").alias("gm_size"), F.count("*").alias("gm_nodes")).where("gm_size > 1").drop("gm_size")
    members = stage(join_dictionary(nodes, stage(sizes, "groups"), ["group_id"], "gm_nodes").select("gm_t", "gm_p", "gm_n", "group_id"), "members")
    return join_dictionary(rows, members, ["gm_t", "gm_p"], "gm_n").drop("gm_t", "gm_p")


def precedence(rows: DataFrame, carrier: str, stamp: str) -> DataFrame:
    """(v, w): value v of the carrier gives way to w; a partial order, closed under its steps.

    In each group the spans of the values, from first to last stamp, are put in order; a value
    that ends before the next one begins votes for that step. A step holds if it got VOTES, and
    MAJORITY of the votes of its two values in either order. Steps are closed by doubling, and
    pairs that come out in both directions are dropped. Votes stay in a table, so the number of
    values doesn't matter.
    """
    spans = rows.where(F.col(stamp).isNotNull() & F.col(carrier).isNotNull()).groupBy("group_id", F.col(carrier).alias("w")).agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    order = Window.partitionBy("group_id").orderBy("first", "last", "w")
    steps = spans.withColumns({"v": F.lag("w").over(order), "ended": F.lag("last").over(order)}).where("ended < first")
    votes = stage(steps.groupBy("v", "w").agg(F.count("*").alias("n")), "votes")
    back = votes.select(F.col("v").alias("w"), F.col("w").alias("v"), F.col("n").alias("back"))
    held = votes.join(back, ["v", "w"], "left").where((F.col("n") >= VOTES) & (F.col("n") >= MAJORITY * (F.col("n") + F.coalesce("back", F.lit(0)))))
    closed = stage(held.select("v", "w"), "steps")
    size = closed.count()
    for _ in range(DOUBLINGS):
        further = closed.select("v", F.col("w").alias("x")).join(closed.select(F.col("v").alias("x"), "w"), "x").select("v", "w")
        closed = stage(closed.unionByName(further).distinct(), "steps")
        before, size = size, closed.count()
        if size == before:
            break
    both = closed.select(F.col("v").alias("w"), F.col("w").alias("v"))
    return closed.where("v <> w").join(both, ["v", "w"], "left_anti")


def _currency(rows: DataFrame, by: list[str], fields: dict[str, Column], order: DataFrame | None, key: str, carrier: str) -> DataFrame:
    """(*by, <field>...): the key of the most current row of each group for each field.

    The latest stamped row counts, unless rows without a stamp have values that come after
    its value; of several such the one with most values before it, which none of the others
    follows, then the smallest key. Without a stamped row the same holds for all of them.
    """
    value = F.struct(F.col(key), F.col(carrier).alias("value"))
    stamped = lambda c: F.min_by(value, F.when(c & F.col("gm_when").isNotNull(), F.struct(-F.col("gm_when"), F.col(key))))
    latest = rows.groupBy(*by).agg(*[stamped(c).alias(f) for f, c in fields.items()])
    if order is None:
        return latest.select(*by, *[F.col(f)[key].alias(f) for f in fields])
    place = order.groupBy(F.col("w").alias("value")).agg(F.count("*").alias("place"))
    loose = rows.where("gm_when is null").groupBy(*by, F.col(carrier).alias("value")).agg(*[F.min(F.when(c, F.col(key))).alias(f) for f, c in fields.items()])
    loose = loose.join(broadcast_if_few(place), "value", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    out = latest
    for f in fields:
        own = loose.where(F.col(f).isNotNull()).select(*by, "value", "place", F.col(f).alias("loose"))
        own = own.join(latest.select(*by, F.col(f)["value"].alias("v"), F.col(f).isNull().alias("alone")), by)
        own = own.join(broadcast_if_few(order.select("v", F.col("w").alias("value"), F.lit(True).alias("after"))), ["v", "value"], "left").where("alone or after")
        best = own.groupBy(*by).agg(F.min_by("loose", F.struct((-F.col("place")).alias("p"), "loose")).alias(f"{f}_loose"))
        out = out.join(best, by, "left")
    return out.select(*by, *[F.coalesce(F.col(f"{f}_loose"), F.col(f)[key]).alias(f) for f in fields])


def survivors(rows: DataFrame, usable: dict[str, DataFrame | Column], registry: DataFrame, key: str = "grant_id", source: str = "source_name", stamp: str = "last_verified", carrier: str = "status", latest_field: str = "last_verified") -> DataFrame:
    """(group_id, field, key): the row whose value survives, for each group and field.

    `rows` come from grouped; `usable` gives for each field the condition under which a row's
    value counts. Of equally trusted and equally current rows the one with the smallest key
    survives; a source that the registry lacks is trusted least. A field without a usable value
    has no row. Groups are only aggregated, never gathered. The order of values is learned
    where a row lacks its stamp; else no row needs it.
    """
    trust = registry.groupBy(F.col("source_name").alias(source)).agg(F.min("trust_rank").alias("gm_trust"))
    rows = rows.join(broadcast_if_few(trust), source, "left")
    rows = rows.withColumns({"gm_trust": F.coalesce("gm_trust", F.lit(2**31 - 1)), "gm_when": F.unix_micros(F.col(stamp).cast("timestamp"))})
    order = stage(precedence(rows, carrier, stamp), "precedence") if rows.where("gm_when is null").limit(1).count() else None
    best = _currency(rows, ["group_id", "gm_trust"], usable, order, key, carrier)
    trusted = best.groupBy("group_id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("gm_trust"))).alias(f) for f in usable])
    overall = _currency(rows, ["group_id"], {latest_field: F.lit(True)}, order, key, carrier)
    wide = trusted.join(overall, "group_id")
    names = [*usable, latest_field]
    long = wide.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(key)) for f in names])).alias("x"))
    return long.select("group_id", "x.field", f"x.{key}").where(F.col(key).isNotNull())


def says_who(eligibility: Column) -> Column:
    """Whether an eligibility text says who may apply."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(eligibility, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return ~plain.isin(*SAYS_NOTHING) & plain.rlike(r"\p{L}{3}")


def best_records(grants: DataFrame, registry: DataFrame) -> DataFrame:
    """(group_id, field, grant_id) of deadline, eligibility, last_verified and source_name.

    A deadline counts if it denotes a day or an instant. Rows of no group of two or more give
    nothing; null titles and addresses link nothing; repeated rows of one key count as captures
    of one program.
    """
    columns = ["grant_id", "title", "source_url", "source_name", "deadline", "eligibility", "last_verified", "status"]
    rows = stage(grouped(grants.select(*columns)), "grouped")
    dated = normalise_instants(located(rows.select("grant_id", "deadline", "source_name"), "deadline", "source_name", registry), InstantDictionary.shared(rows.sparkSession)).select("grant_id").distinct()
    rows = stage(rows.join(dated.withColumn("gm_dated", F.lit(True)), "grant_id", "left"), "dated")
    usable = {"deadline": F.coalesce("gm_dated", F.lit(False)), "eligibility": says_who(F.col("eligibility")), "source_name": F.col("source_name").isNotNull()}
    return survivors(rows, usable, registry)


def merged_records(rows: DataFrame, chosen: DataFrame, key: str = "grant_id") -> DataFrame:
    """One row per group with the surviving value of each field, as text."""
    fields = ["deadline", "eligibility", "last_verified", "source_name"]
    values = rows.select(key, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("gm_values"))
    picked = chosen.join(values, key).select("group_id", "field", F.element_at("gm_values", F.col("field")).alias("value"))
    return picked.groupBy("group_id").pivot("field", fields).agg(F.first("value"))
