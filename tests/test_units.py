import pytest

from grainmill.functions.money import parse_sum, unit_named
from grainmill.operators.units import Weights, unit_solutions, wrong_bounds


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("$5,000", 5000, 5000),
        ("Up to $2.5k", None, 2500),
        ("At least $50 thousand", 50_000, None),
        ("$10-50K", 10_000, 50_000),
        ("$500 - $1 thousand", 500, 1000),
        ("$25k-150k USD", 25_000, 150_000),
        ("USD 750 000", 750_000, 750_000),
        ("4 awards of $75,000", 75_000, 75_000),
        ("$7,500, 12 awards expected", 7500, 7500),
        ("Up to $500 (50% match required)", None, 500),
        ("750 ($000)", 750_000, 750_000),
        ("15 K$", 15_000, 15_000),
        ("10 x $1,000", 10_000, 10_000),
        ("$ thousands: 10 - 75", 10_000, 75_000),
        ("half a million dollars", 500_000, 500_000),
        ("twenty-five thousand dollars", 25_000, 25_000),
        ("a quarter million dollars", 250_000, 250_000),
        ("$10,000 over 24 months", 10_000, 10_000),
    ],
)
def test_sums(text, low, high):
    s = parse_sum(text)
    assert (s.low and s.low * s.low_unit, s.high and s.high * s.high_unit) == (low, high)


@pytest.mark.parametrize("text", [None, "", "Varies", "Multiple tiers", "$1 and $2 and $3", "x" * 10_000])
def test_no_single_sum(text):
    assert parse_sum(text).low is None and parse_sum(text).high is None


def test_units_by_name():
    assert [unit_named(u) for u in ("US cents", "$000s", "USD_K", "thousand USD", "dollars", "USD", None, "boxes")] == [0.01, 1e3, 1e3, 1e3, 1.0, 1.0, None, None]


def test_identity_between_columns(spark):
    rows = spark.createDataFrame(
        [
            ("a", "500", 500, 500, '{"award": {"floor": 500, "ceiling": 500, "unit": "thousand USD"}}'),
            ("b", "$5,000", 500000, 5000, None),
            ("c", None, None, 20, '{"award": {"floor": null, "ceiling": 2000, "unit": "US cents"}}'),
            ("d", "700", 700, 700, "not json"),
            ("e", None, 1, 1, '{"award": null}'),
            ("f", None, None, None, None),
        ],
        "grant_id string, amount string, amount_min long, amount_max long, raw_data string",
    )
    got = {(r.grant_id, r.bound): r.usd for r in wrong_bounds(rows).collect()}
    assert got == {("a", "min"): 500_000, ("a", "max"): 500_000, ("b", "min"): 5000}
    solved = {r.grant_id: r for r in unit_solutions(rows).collect()}
    assert solved["b"].gm_min.stored_scale == 0.01 and solved["b"].gm_min.unique
    assert solved["d"].gm_min.usd == 700 and not solved["d"].gm_min.unique
    assert wrong_bounds(rows.limit(0)).count() == 0


def test_long_texts_are_parsed_whole():
    s = parse_sum("Awards of up to $5,000 " + "for growers and their shops " * 100)
    assert (s.low, s.high, s.high_unit) == (None, 5000.0, 1.0)


AMOUNTS = "grant_id string, amount string, amount_min long, amount_max long, raw_data string"


def test_residuals_pick_the_units(spark):
    award = lambda n, unit: f'{{"award": {{"floor": {n}, "ceiling": {n}, "unit": {unit}}}}}'
    rows = spark.createDataFrame(
        [
            ("text in thousands", "5", None, None, award(5000, '"USD"')),
            ("award in cents", "250", None, None, award(25000, "null")),
            ("shared unit", "40", None, None, award("null", '"thousand USD"')),
            ("both unnamed", "70", 70000, 70000, award(70000, "null")),
            ("nothing but dollars", "900", 9, 9, None),
            ("named wins", "$3 million", 3, 3, award(3, '"USD"')),
        ],
        AMOUNTS,
    )
    got = {r.grant_id: r.gm_max for r in unit_solutions(rows).collect()}
    assert {k: v.usd for k, v in got.items()} == {"text in thousands": 5000, "award in cents": 250, "shared unit": 40_000, "both unnamed": 70_000, "nothing but dollars": 900, "named wins": 3_000_000}
    assert got["text in thousands"].unique and got["award in cents"].unique and not got["shared unit"].unique
    # without the rule that unnamed numbers are dollars the stored number alone tells the unit
    free = spark.createDataFrame([("a", "5", 5000, 5000, None), ("b", "5", 5, 5, None), ("c", "5", None, None, None)], AMOUNTS)
    alone = {r.grant_id: r.gm_min for r in unit_solutions(free, weights=Weights(dollars=0.0)).collect()}
    assert alone["a"].usd == 5000 and alone["b"].usd == 5 and not any(alone[g].unique for g in "abc")


def test_without_residuals_the_stated_units_are_missed(spark):
    rows = spark.createDataFrame([("a", "$5 thousand", 5, 5, None), ("b", None, 20, 20, '{"award": {"floor": 2000, "ceiling": 2000, "unit": "US cents"}}'), ("c", "$3 million", 3, 3, None)], AMOUNTS)
    want = {("a", "min"): 5000, ("a", "max"): 5000, ("c", "min"): 3_000_000, ("c", "max"): 3_000_000}
    assert {(r.grant_id, r.bound): r.usd for r in wrong_bounds(rows).collect()} == want
    none = {r.grant_id: r.gm_min.usd for r in unit_solutions(rows, weights=Weights(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)).collect()}
    assert all(none[g] != want[g, "min"] for g in "ac")
