from datetime import datetime, timezone

import pytest

from grainmill.functions.instants import parse_instant
from grainmill.operators.instants import InstantDictionary, located, normalise_instants


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2026-12-15", "America/Chicago", "MDY", us(2026, 12, 15, 6)),
        ("06/07/2026", "UTC", "MDY", us(2026, 6, 7)),
        ("06/07/2026", "UTC", "DMY", us(2026, 7, 6)),
        ("20261213", "UTC", "DMY", us(2026, 12, 13)),
        ("13122026", "UTC", "DMY", us(2026, 12, 13)),
        ("22/06/25 4:30 pm", "Europe/London", "DMY", us(2025, 6, 22, 15, 30)),
        ("1738994340000", "America/Chicago", "MDY", 1738994340000000),
        ("/Date(1761949800000)/", "America/Chicago", "MDY", 1761949800000000),
        ("2026-07-03T14:00:00Z", "America/Chicago", "MDY", us(2026, 7, 3, 14)),
        ("2025-03-21T23:59:00.5470000-0600", "UTC", "MDY", us(2025, 3, 22, 5, 59) + 547000),
        ("Sun Mar 08 01:15:00 UTC 2026", "America/Denver", "MDY", us(2026, 3, 8, 1, 15)),
        ("Thu, 27 Mar 2025 17:00:00 -0500", "UTC", "MDY", us(2025, 3, 27, 22)),
        ("noon CT on November 8, 2025", "UTC", "MDY", us(2025, 11, 8, 18)),
        ("Apply by May\xa021, 2027 (firm)", "UTC", "MDY", us(2027, 5, 21)),
        # an hour that occurs twice means the earlier instant, a skipped one moves ahead by the gap
        ("2025-11-02 01:30", "America/Chicago", "MDY", us(2025, 11, 2, 6, 30)),
        ("2025-03-09 02:30", "America/Chicago", "MDY", us(2025, 3, 9, 8, 30)),
        ("12:00 am on March 29, 2025", "UTC", "MDY", us(2025, 3, 29)),
    ],
)
def test_notations(text, zone, order, want):
    assert parse_instant(text, zone, order) == want


@pytest.mark.parametrize("text", [None, "", "  ", "Rolling", "June 2026", "Q3 2026", "Spring 2026", "13/45/2026", "2026-02-30", "0000-00-00", "TBD", "2026-05-05T25:00", "x" * 50_000])
def test_texts_that_are_no_day(text):
    assert parse_instant(text, "UTC", "MDY") is None


def test_dictionary_grows_and_rows_keep_their_place(spark):
    registry = spark.createDataFrame([("a", "America/Chicago", "MDY", 1), ("a", "UTC", "DMY", 2), ("b", "Europe/London", "DMY", 3)], "source_name string, time_zone string, date_order string, trust_rank int")
    rows = spark.createDataFrame([(1, "01/02/2026", "a"), (2, "01/02/2026", "b"), (3, None, "a"), (4, "01/02/2026", "a"), (5, "Fall", "b"), (6, "01/02/2026", None), (7, "2026-01-02", "unknown")], "k int, utc_us_text string, src string")
    book = InstantDictionary(spark)
    out = {r.k: r.utc_us for r in normalise_instants(located(rows, "utc_us_text", "src", registry), book).collect()}
    assert out == {1: us(2026, 1, 2, 6), 2: us(2026, 2, 1), 4: us(2026, 1, 2, 6), 6: us(2026, 1, 2), 7: us(2026, 1, 2)}
    before = book.entries().count()
    normalise_instants(located(rows.limit(3), "utc_us_text", "src", registry), book).collect()
    assert book.entries().count() == before
    assert normalise_instants(located(rows.limit(0), "utc_us_text", "src", registry)).count() == 0


def test_a_second_run_parses_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-02", "UTC", "MDY"), ("Fall", "UTC", "MDY"), ("2026-01-02", "UTC", "DMY")], "gm_raw string, gm_zone string, gm_order string")
    path = str(tmp_path / "book")
    assert InstantDictionary(spark, path).extend(rows) == 3
    assert InstantDictionary(spark, path).extend(rows) == 0
    more = rows.unionByName(spark.createDataFrame([("5 May 2026", "UTC", "MDY")], rows.schema))
    book = InstantDictionary(spark, path)
    assert book.extend(more) == 1 and book.entries().count() == 4
    assert InstantDictionary.shared(spark).path == InstantDictionary.shared(spark).path
