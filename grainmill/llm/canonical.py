"""Free-entered values -> entries of a reference list.

Values are reduced to distinct ones and normalised; what then equals a name or an alias is
settled. For the rest an inverted index of character n-grams gives candidates, scored by
weighted cosine; a candidate above the threshold, and by a margin over the next entry, is
taken. Between a lower threshold and that one an edit distance has to confirm it. Everything
else is reported as unmatched.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from grainmill.operators.skew import join_dictionary
from grainmill.runtime import broadcast_if_few, stage

#: Id of values that the list does not hold.
NONE = "NONE"
#: Weighted cosine from which an entry is taken, and its least lead over the next one.
THRESHOLD, MARGIN = 0.5, 0.05
#: Weighted cosine from which an entry is taken if an edit distance confirms it; the index finds every pair above it.
DOUBT = 0.3
#: Cosine that the lightest grams of a value may add at most; the index is not asked for them.
LIGHT = 0.1
#: The code of the state that addresses may end in.
STATE = "TG"

#: Short forms in names of places and trades (fixed values).
SHORT = {
    "grv": "grove", "fls": "falls", "jct": "junction", "jctn": "junction", "co": "county", "cnty": "county", "cty": "county", "crk": "creek", "mt": "mount", "mtn": "mountain", "ft": "fort", "st": "saint", "pr": "prairie",
    "w": "west", "n": "north", "s": "south", "e": "east", "hts": "heights", "spgs": "springs", "mfg": "making", "svcs": "services", "svc": "service", "natl": "national",
}
#: Words that join parts of a name and may be left out, mistyped or written as a sign.
JOINING = {"and", "n", "&", "+"}

_AROUND = (
    re.compile(r"\([^()]*\)\s*$"),
    re.compile(rf"[,\s]\s*{STATE}\b\.?(?:\s+\d{{5}}(?:-\d{{4}})?)?\s*$", re.I),
    re.compile(r"^\s*(?:city|town|village|township) of\s+", re.I),
    re.compile(r"^\s*greater\s+(?=.*\barea\s*$)", re.I),
    re.compile(r"(?<=\w)\s+area\s*$", re.I),
    re.compile(r"^\s*(?:industry|industries|sector|location|place)\s*[:=-]\s*", re.I),
    re.compile(r"(?<=\w)\s+(?:sector|industry|industries|businesses|companies|firms)\s*$", re.I),
)


def normal_form(value: str | None, around: bool = True, short: bool = True) -> str:
    """A value without case, accents, punctuation and joining words; if asked without what stands around the name and with short forms written out."""
    if not value:
        return ""
    text = html.unescape(value)
    if around:
        for pattern in _AROUND:
            text = pattern.sub("", text)
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    text = re.sub(r"(?<=\w)[-'’](?=\w)", "", text)
    words = re.findall(r"[^\W_]+|[&+]", text)
    out, joined = [], any(w in JOINING for w in words[1:-1])
    for i, w in enumerate(words):
        if 0 < i < len(words) - 1 and (w in JOINING or (not joined and len(w) <= 4 and edit_distance(w, "and", 1) <= 1)):
            continue
        if w in ("&", "+"):
            continue
        out.append(w)
    # letters alone ("N/A") are no short form of anything
    if short and any(len(w) > 2 for w in out):
        out = [SHORT.get(w, w) for w in out]
    if around and out[:2] == ["county", "of"]:
        out = [*out[2:], "county"]
    return " ".join(out)


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, changes and swaps of neighbors that turn a into b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, earlier[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


@F.pandas_udf(StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(normal_form)


@F.pandas_udf(StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: normal_form(v, around=False))


@F.pandas_udf(StringType())
def _bare(values: pd.Series) -> pd.Series:
    return values.map(lambda v: normal_form(v, short=False))


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def grams_of(text: str) -> list[str]:
    """The distinct character n-grams of a value with marked ends: pairs, pairs with a gap, and triples in any order, which swaps leave alone."""
    marked, out = f"^{text}$", set()
    for i in range(len(marked) - 1):
        out.add(marked[i : i + 2])
        if i + 2 < len(marked):
            out.add(f"{marked[i]}_{marked[i + 2]}")
            out.add("=" + "".join(sorted(marked[i : i + 3])))
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def grams(values: pd.Series) -> pd.Series:
    return values.map(grams_of)


def reference_names(ref: DataFrame, key: str, name: str, aliases: str, field: str) -> DataFrame:
    """(field, ref_id, exact, norm, rank): every name and alias of a list; rank 0 is the name."""
    names = ref.select(F.col(key).alias("ref_id"), F.col(name).alias("exact"), F.lit(0).alias("rank"))
    others = ref.select(F.col(key).alias("ref_id"), F.explode(aliases).alias("exact"), F.lit(1).alias("rank"))
    both = names.unionByName(others).where(F.col("exact").isNotNull())
    return both.select(F.lit(field).alias("field"), "ref_id", "exact", _plain("exact").alias("norm"), "rank").where("norm <> ''")


def match_values(values: DataFrame, names: DataFrame) -> DataFrame:
    """(field, entry, gm_n, ref_id, score): the entry of the list that each distinct value means.

    `values` has field, entry and gm_n, one row per distinct value; `names` comes from
    reference_names. A normal form that two entries share goes to the one that has it as its
    name, then to the smaller id. Blank values are unmatched.
    """
    known = names.groupBy("field", "norm").agg(F.min_by("ref_id", F.struct("rank", "ref_id")).alias("ref_id"))
    forms = stage(values.select("field", "entry", "gm_n", _plain("entry").alias("plain"), _normal("entry").alias("norm"), _bare("entry").alias("bare")), "value-forms")
    whole = known.select("field", F.col("norm").alias("plain"), F.col("ref_id").alias("by_plain"))
    part = known.select("field", "norm", F.col("ref_id").alias("by_norm"))
    settled = forms.join(broadcast_if_few(whole), ["field", "plain"], "left").join(broadcast_if_few(part), ["field", "norm"], "left")
    settled = settled.select("field", "entry", "gm_n", "norm", "bare", F.coalesce("by_plain", "by_norm").alias("known_id"))
    queries = settled.where("known_id is null").select("field", F.explode(F.array_distinct(F.array("norm", "bare"))).alias("norm")).where("norm <> ''").distinct()

    named = names.groupBy("field", F.col("norm").alias("name")).agg(F.min_by("ref_id", F.struct("rank", "ref_id")).alias("ref_id"))
    named = stage(named.withColumn("gram", grams("name")), "list-grams")
    total = named.groupBy("field").agg(F.count("*").alias("gm_all"))
    weight = named.select("field", F.explode("gram").alias("gram")).groupBy("field", "gram").agg(F.count("*").alias("df"))
    weight = weight.join(broadcast_if_few(total), "field").select("field", "gram", F.ln((F.col("gm_all") + 1) / (F.col("df") + 0.5)).alias("w"))
    weight = broadcast_if_few(stage(weight, "gram-weights"))

    def vectors(rows: DataFrame, *keys: str) -> DataFrame:
        """One row per value with its grams and weights, lightest first, and its length; grams that no name has weigh as the rarest."""
        rows = rows.select(*keys, F.explode("gram").alias("gram")).join(weight, ["field", "gram"], "left").join(broadcast_if_few(total), "field")
        rows = rows.withColumn("w", F.coalesce("w", F.ln((F.col("gm_all") + 1) / 0.5)))
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w", "gram"))).alias("vector"), F.sum(F.col("w") * F.col("w")).alias("square"))
        return rows

    index = vectors(named, "field", "name", "ref_id").select("field", "name", "ref_id", F.col("vector").alias("name_vector"), F.sqrt("square").alias("name_size"))
    index = stage(index.withColumn("held", F.map_from_entries(F.transform("name_vector", lambda x: F.struct(x["gram"], x["w"])))), "index")
    asked = stage(vectors(queries.withColumn("gram", grams("norm")), "field", "norm"), "asked")
    # by Cauchy and Schwarz the lightest grams add at most LIGHT to a cosine: a pair whose others don't reach DOUBT - LIGHT is out, the rest is counted exactly
    skip = F.aggregate("vector", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.when(s["sum"] + x["w"] * x["w"] < LIGHT * LIGHT * F.col("square"), F.struct((s["sum"] + x["w"] * x["w"]).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    probes = asked.select("field", "norm", F.explode(F.slice("vector", skip + 1, F.size("vector"))).alias("x")).select("field", "norm", "x.gram", "x.w")
    postings = index.select("field", "name", F.explode("name_vector").alias("x")).select("field", "name", F.col("x.gram").alias("gram"))
    pairs = probes.join(broadcast_if_few(postings), ["field", "gram"]).groupBy("field", "norm", "name").agg(F.sum(F.col("w") * F.col("w")).alias("partial"))
    scored = pairs.join(asked, ["field", "norm"]).join(broadcast_if_few(index), ["field", "name"])
    sizes = F.sqrt("square") * F.col("name_size")
    scored = scored.where(F.col("partial") >= (DOUBT - LIGHT - 1e-9) * sizes)
    dot = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at("held", x["gram"]), F.lit(0.0)))
    scored = scored.withColumn("score", dot / sizes)
    scored = scored.where(F.col("score") >= DOUBT)
    # the best name of each entry, then the two leading entries of each value
    best = scored.groupBy("field", "norm", "ref_id").agg(F.max("score").alias("score"), F.max_by("name", F.struct("score", "name")).alias("name"))
    far = F.lit(99)
    allowed = F.when(F.length("norm") >= 10, 2).when(F.length("norm") >= 4, 1).otherwise(0)
    best = best.withColumn("distance", _distance("norm", "name")).withColumn("distance", F.when(F.col("distance") <= allowed, F.col("distance")).otherwise(far))
    best = best.where((F.col("score") >= THRESHOLD) | (F.col("distance") < far))
    order = Window.partitionBy("field", "norm").orderBy("distance", F.desc("score"), "ref_id")
    lead = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    lead = lead.groupBy("field", "norm").agg(at(1, "ref_id").alias("near_id"), at(1, "score").alias("score"), at(1, "distance").alias("d1"), at(2, "score").alias("s2"), at(2, "distance").alias("d2"))
    # an entry within the edit distance leads one that isn't; else the margin of the cosine counts
    leads = F.col("s2").isNull() | (F.col("d2") > F.col("d1")) | (F.col("score") - F.col("s2") >= MARGIN)
    taken = stage(lead.where(leads).select("field", "norm", "near_id", "score"), "taken")
    other = taken.select("field", F.col("norm").alias("bare"), F.col("near_id").alias("bare_id"), F.col("score").alias("bare_score"))
    out = settled.join(taken, ["field", "norm"], "left").join(other, ["field", "bare"], "left")
    score = F.when(F.col("known_id").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("score", "bare_score", F.lit(0.0)))
    return out.select("field", "entry", "gm_n", F.coalesce("known_id", "near_id", "bare_id", F.lit(NONE)).alias("ref_id"), score.alias("score"))


#: array column of grants, reference table, its key, name and aliases.
LISTS = (("locations", "ref_locations", "location_id", "place_name", "aliases"), ("industries", "ref_industries", "industry_id", "industry_name", "aliases"))


def canonical_entries(rows: DataFrame, lists: dict[str, DataFrame], key: str = "grant_id") -> DataFrame:
    """(key, field, pos, ref_id) of every entry that is not exactly a name of its list.

    Positions count from 0. Null arrays, empty arrays and null entries give no row; blank and
    unknown entries give NONE. Repeated rows each give their rows. A value that fills a third
    of all entries is matched once and joined back by broadcast.
    """
    parts = [rows.select(F.col(key).alias("gm_key"), F.lit(field).alias("field"), F.posexplode(field).alias("pos", "entry")) for field, *_ in LISTS if field in lists]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    names = None
    for field, _, ref_key, name, aliases in LISTS:
        if field in lists:
            one = reference_names(lists[field], ref_key, name, aliases, field)
            names = one if names is None else names.unionByName(one)
    names = stage(names, "list-names")
    exact = names.where("rank = 0").select("field", F.col("exact").alias("entry")).distinct()
    entries = entries.where(F.col("entry").isNotNull()).join(broadcast_if_few(exact), ["field", "entry"], "left_anti")
    distinct = entries.groupBy("field", "entry").agg(F.count("*").alias("gm_n"))
    matched = stage(match_values(distinct, names), "matched-values")
    out = join_dictionary(entries, matched, ["field", "entry"], "gm_n")
    return out.select(F.col("gm_key").alias(key), "field", F.col("pos").cast("bigint").alias("pos"), "ref_id")


def unmatched_report(matched: DataFrame) -> DataFrame:
    """Unmatched values with how often each occurs."""
    return matched.where(F.col("ref_id") == NONE).select("field", "entry", F.col("gm_n").alias("n"))
