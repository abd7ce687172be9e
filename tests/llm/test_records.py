import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grainmill.llm import canonical
from grainmill.llm.canonical import canonical_entries, edit_distance, grams_of, normal_form
from grainmill.llm.survivors import best_records, components, grouped, page_key, precedence, rounds_of, says_who, survivors
from tests.llm.conftest import GRANT


@pytest.mark.parametrize(
    ("value", "form"),
    [("W. Larkes Grv", "west larkes grove"), ("Ft. Wendrell", "fort wendrell"), ("Food n Drink Mfg", "food drink making"), ("Crop &amp; Livestock Farming", "crop livestock farming"), ("Music / Craft n Theater", "music craft theater"), ("Larkesbury, TG 56705", "larkesbury"), ("Greater Åsbrokke area", "asbrokke"), ("County of Yarrowmere", "yarrowmere county"), ("Nation-wide (all)", "nationwide"), ("Industry: CPAs", "cpas"), (None, ""), ("--", "")],
)
def test_normal_forms(value, form):
    assert normal_form(value) == form


def test_edit_distance():
    assert [edit_distance(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]


def test_entries_meet_their_names(spark):
    places = spark.createDataFrame([("L1", "Nationwide", ["National"]), ("L2", "Fennim Grove", []), ("L3", "Fennim Falls", None), ("L4", "Veldenmere County", []), ("L5", "Veldenmere", [])], "location_id string, place_name string, aliases array<string>")
    trades = spark.createDataFrame([("I1", "Child Care", ["Daycare"]), ("I2", "Software and Data Services", ["IT"])], "industry_id string, industry_name string, aliases array<string>")
    rows = spark.createDataFrame(
        [("a", ["Nationwide", "NATIONWIDE", "Fennim Grv", "Fenim Falls", "Veldenmere Co", None, "Zubrov Heights", ""], ["it", "Sofware and Data Services", "Alchemy"], "x"), ("b", None, [], "x"), ("c", ["national"] * 3, None, "x")],
        "grant_id string, locations array<string>, industries array<string>, field string",
    )
    got = {(r.grant_id, r.field, r.pos): r.ref_id for r in canonical_entries(rows, {"locations": places, "industries": trades}).collect()}
    assert got == {("a", "locations", 1): "L1", ("a", "locations", 2): "L2", ("a", "locations", 3): "L3", ("a", "locations", 4): "L4", ("a", "locations", 6): "NONE", ("a", "locations", 7): "NONE", ("a", "industries", 0): "I2", ("a", "industries", 1): "I2", ("a", "industries", 2): "NONE"} | {("c", "locations", i): "L1" for i in range(3)}
    assert canonical_entries(rows.limit(0), {"locations": places, "industries": trades}).count() == 0


NAMES = "location_id string, place_name string, aliases array<string>"


def matched(spark, names, entries):
    places = spark.createDataFrame([(f"L{i}", n, None) for i, n in enumerate(names)], NAMES)
    rows = spark.createDataFrame([("a", entries)], "grant_id string, locations array<string>")
    got = {r.pos: r.ref_id for r in canonical_entries(rows, {"locations": places}).collect()}
    return [got.get(i) for i in range(len(entries))]


def test_threshold_and_margin_decide(spark, monkeypatch):
    names = ["Harlan Grove Heights", "Wexcombe Junction", "Pellbury", "Ashgrodale North Fields", "Ashgrodale South Fields"]
    # more edits than the distance allows: the cosine alone takes it, and leaves the one between two names
    entries = ["Harlan Heights", "Zubrov", "Ashgrodale Fields"]
    assert matched(spark, names, entries) == ["L0", "NONE", "NONE"]
    monkeypatch.setattr(canonical, "THRESHOLD", 2.0)
    assert matched(spark, names, entries)[0] == "NONE"
    monkeypatch.setattr(canonical, "THRESHOLD", 0.5)
    monkeypatch.setattr(canonical, "MARGIN", 0.0)
    assert matched(spark, names, entries)[2] != "NONE"


def test_short_names_and_many_alike(spark):
    names = ["Ux", "Ely", "Oak", *[f"Tamsin Ward {a}{b}" for a in "bcdfg" for b in "kmnprst"]]
    entries = ["ELY", "Elys", "ux", "Tamsin Ward dn", "Tamsin Wrad dn", "N/A", "x" * 50_000]
    got = matched(spark, names, entries)
    assert got == ["L1", "L1", "L0", None, f"L{names.index('Tamsin Ward dn')}", "NONE", "NONE"]


def test_index_finds_every_pair_above_the_threshold(spark):
    """The scores of the index against those of all pairs, counted plainly."""
    from collections import Counter
    from math import log, sqrt

    names = [f"{a} {b}" for a in ("larkes", "kestr", "pell", "ashgro") for b in ("grove", "falls", "county", "heights", "mere")]
    count = Counter(g for n in names for g in grams_of(n))
    weigh = lambda g: log((len(names) + 1) / (count.get(g, 0) + 0.5))
    length = lambda x: sqrt(sum(weigh(g) ** 2 for g in grams_of(x)))
    cosine = lambda a, b: sum(weigh(g) ** 2 for g in {*grams_of(a)} & {*grams_of(b)}) / length(a) / length(b)
    values = ["larks grove", "kestr fals", "pel heigths", "ashgor mere", "larkes", "grove falls county", "kestrel heights", "nowhere"]
    ref = canonical.reference_names(spark.createDataFrame([(f"L{i}", n, None) for i, n in enumerate(names)], NAMES), "location_id", "place_name", "aliases", "locations")
    got = {r.entry: r for r in canonical.match_values(spark.createDataFrame([("locations", v, 1) for v in values], "field string, entry string, gm_n long"), ref).collect()}
    for v in values:
        best = sorted(((cosine(v, n), n) for n in names), reverse=True)
        if best[0][0] >= canonical.THRESHOLD and best[0][0] - best[1][0] >= canonical.MARGIN and edit_distance(v, best[1][1]) > 1:
            assert got[v].ref_id == f"L{names.index(best[0][1])}" and abs(got[v].score - best[0][0]) < 1e-9
    assert got["nowhere"].ref_id == "NONE"


def test_page_keys(spark):
    urls = ["https://www.E.org/a/b/?utm_source=x#top", "http://e.org/a/b", "https://e.org/", "https://e.org", "https://e.org/a?id=2&ref=z", None, ""]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(page_key(F.col("u")).alias("k")).collect()]
    assert got == ["e.org/a/b", "e.org/a/b", None, None, "e.org/a?id=2", None, None]
    titles = spark.createDataFrame([("Fund Round 2 2026",), ("Fund II",), ("Fund",)], "t string").select(rounds_of(F.col("t")).alias("r"))
    assert [r.r for r in titles.collect()] == ["2026|round2", "ii", ""]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(f"n{i:03d}", rng.choice([None, f"a{rng.randint(0, 60)}"]), rng.choice([None, f"b{rng.randint(0, 60)}"])) for i in range(150)]
    links += [(f"z{i:03d}", f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(40)]  # one long chain
    parent = {k: k for k, _, _ in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for k, a, b in links:
        for v in (("a", a), ("b", b)):
            if v[1] is not None:
                x, y = find(seen.setdefault(v, k)), find(k)
                parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "k string, a string, b string"), "k", "a", "b").collect()
    assert {r.k: r.label for r in got} == {k: find(k) for k in parent}


def grant(i, title, url, source, deadline=None, eligibility=None, when=None, status="OPEN"):
    return (i, f"g{i}", title, "text", url, source, deadline, eligibility, status, when, None, None, None)


def test_best_values_of_a_program(spark):
    day = lambda n: datetime(2026, 1, 1) + timedelta(days=n)
    rows = spark.createDataFrame(
        [
            grant(1, "Harbor Fund", "https://a.org/x", "low", "2026-05-01", "Open to growers", day(1)),
            grant(2, "harbor  fund!", "https://b.org/", "high", "Rolling", "n/a", day(5)),
            grant(3, "Other name", "http://www.a.org/x/?utm_source=q", "high", "2026-06-01", "See website", day(3)),
            grant(4, "Harbor Fund Round 2", "https://a.org/x", "low", "2026-07-01", "Open to bakers", day(9)),
            grant(5, "Lonely", "https://b.org/", "high", "2026-07-01", None, day(9)),
            grant(6, None, None, None, None, None, None),
            grant(7, "Harbor Fund", None, "low", None, None, None),
        ],
        GRANT,
    )
    registry = spark.createDataFrame([("low", 9, "UTC", "MDY"), ("high", 1, "UTC", "MDY")], "source_name string, trust_rank int, time_zone string, date_order string")
    got = {(r.group_id, r.field): r.grant_id for r in best_records(rows, registry).collect()}
    assert got == {("g1", "deadline"): "g3", ("g1", "eligibility"): "g1", ("g1", "last_verified"): "g2", ("g1", "source_name"): "g2"}
    assert best_records(rows.limit(0), registry).count() == 0
    assert {r.grant_id for r in grouped(rows).collect()} == {"g1", "g2", "g3", "g7"}


HISTORY = "group_id string, grant_id string, source_name string, d int, status string"


def history(spark, rows):
    return spark.createDataFrame(rows, HISTORY).withColumn("last_verified", F.expr("CASE WHEN d IS NOT NULL THEN timestamp_ntz '2026-01-01 00:00:00' + make_interval(0, 0, 0, d) END"))


LEARNED = [(f"l{i}", f"l{i}{d}", "s", d, v) for i in range(5) for d, v in enumerate(("FORECASTED", "OPEN", "CLOSED"))]


def test_precedence_needs_a_margin(spark):
    noise = [(f"n{i}", f"n{i}{d}", "s", d, v) for i in range(20) for d, v in enumerate(("A", "B") if i % 2 else ("B", "A"))]
    got = {(r.v, r.w) for r in precedence(history(spark, LEARNED + noise), "status", "last_verified").collect()}
    # OPEN before CLOSED, and what follows from two steps; values that come in either order are not compared
    assert got == {("FORECASTED", "OPEN"), ("OPEN", "CLOSED"), ("FORECASTED", "CLOSED")}
    many = [(f"m{i}", f"m{i}{d}", "s", d, f"v{i % 80}{'x' * d}") for i in range(400) for d in range(2)]
    assert precedence(history(spark, many), "status", "last_verified").count() == 80
    assert precedence(history(spark, []), "status", "last_verified").count() == 0


def test_missing_stamps_are_reasoned(spark, monkeypatch):
    planted = [("q", "c", "s", 1, "OPEN"), ("q", "d", "s", None, "CLOSED"), ("r", "e", "s", 1, "CLOSED"), ("r", "f", "s", None, "OPEN"), ("t", "g", "s", None, "OPEN"), ("t", "h", "s", None, "CLOSED"), ("t", "i", "s", None, "CLOSED"), ("u", "j", "s", 3, "OPEN"), ("u", "k", "s", None, "ODD"), ("w", "m", "s", None, None), ("w", "n", "s", 1, "OPEN")]
    rows = history(spark, LEARNED + planted)
    registry = spark.createDataFrame([("s", 1)], "source_name string, trust_rank int")
    pick = lambda: {(r.group_id, r.field): r.grant_id for r in survivors(rows, {"x": F.lit(True)}, registry).collect() if len(r.group_id) == 1}
    want = {"q": "d", "r": "e", "t": "h", "u": "j", "w": "n"}
    assert pick() == {(g, f): k for g, k in want.items() for f in ("x", "last_verified")}
    # without what was learned the planted cases come out wrong
    monkeypatch.setattr("grainmill.llm.survivors.precedence", lambda *a: spark.createDataFrame([], "v string, w string"))
    assert pick()["q", "x"] == "c" and pick()["t", "x"] == "g"


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(f"z{i:03d}", f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(40)], "k string, a string, b string")
    with pytest.raises(RuntimeError):
        components(chain, "k", "a", "b", most_rounds=1)


def test_empty_words_say_nobody(spark):
    items = ["Open to growers", "n/a", "N/A", "-", "TBD", "   ", None, "None listed.", "See website"]
    got = spark.createDataFrame([(x,) for x in items], "e string").select(says_who(F.col("e")).alias("y")).collect()
    assert [r.y for r in got] == [True] + [False] * 8
