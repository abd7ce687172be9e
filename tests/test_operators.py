import random

import pytest

from pyspark.sql import functions as F

from grainmill.operators import aggregates, records, rules, upsert, windows
from grainmill.operators.change import detect_changes
from grainmill.operators.ordering import order_of, page_bounds
from grainmill.operators.predicates import ListingQuery, multi, predicate, status_is, whole_number
from grainmill.operators.skew import join_dictionary
from grainmill.runtime import clear_staged, stage, staged_dir
from grainmill.sources import adapters
from grainmill.streaming.limiter import limited, step


def test_parameters():
    assert multi("OPEN, BOGUS ,CLOSED", ("OPEN", "CLOSED")) == ["OPEN", "CLOSED"] and multi("BOGUS", ("OPEN",)) == [] and multi(None, ()) == []
    assert [whole_number(x) for x in (None, "5000", "abc", "12abc", "-3", "")] == [None, 5000, None, 12, -3, None]
    assert [page_bounds(p, n) for p, n in ((None, None), (3, 50), (-5, None), (1, 500), (1, 0))] == [(20, 0), (50, 100), (20, 0), (100, 0), (1, 0)]


def test_statuses_cover_all_rows(spark):
    rows = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate((s, d) for s in ("OPEN", "CLOSED", "FORECASTED") for d in (None, "2020-01-01", "2030-01-01"))], "id int, status string, d string").withColumn("deadline", F.to_timestamp_ntz("d", F.lit("yyyy-MM-dd")))
    now = F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")
    ids = lambda *s: {r.id for r in rows.where(status_is(s, now)).collect()}
    assert ids("OPEN") == {0, 2} and ids("CLOSED") == {1, 3, 4, 5} and ids("FORECASTED") == {6, 7, 8}
    assert not ids("OPEN") & ids("CLOSED") and ids("OPEN", "CLOSED", "FORECASTED") == set(range(9))
    assert rows.where(predicate(ListingQuery(), now)).count() == 9


def test_nulls_last_in_both_directions(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, amount_max int").withColumns({"deadline": F.lit(None).cast("timestamp_ntz"), "created_at": F.lit(None).cast("timestamp_ntz"), "title": F.lit("t")})
    assert [r.id for r in rows.orderBy(*order_of("amount")).collect()] == [3, 2, 1]
    assert [r.id for r in rows.orderBy(*order_of("amount", "asc")).collect()] == [2, 3, 1]


def test_first_wins_is_stable(spark):
    data = [(random.Random(i).randint(0, 20), i, f"v{i}") for i in range(300)] + [(None, 900, "n"), (None, 901, "m")]
    want = {}
    for k, o, v in data:
        if k is not None:
            want.setdefault(k, v)
    for parts in (1, 7):
        got = windows.first_wins(spark.createDataFrame(data, "k int, o int, v string").repartition(parts), ["k"], "o").collect()
        assert {r.k: r.v for r in got if r.k is not None} == want and sum(r.k is None for r in got) == 2
    assert windows.first_wins(spark.createDataFrame([], "k int, o int"), ["k"], "o").count() == 0


def test_hot_key_meets_its_entry(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("k"), "id")
    entries = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    for share in (4, 100_000):
        got = join_dictionary(rows, entries, ["k"], "n", share)
        assert got.count() == 5000 and got.where("low > id").count() == 0


def sequential(snapshot, batch):
    """The rule of merge_snapshot, a row at a time."""
    stored = {r["source_url"]: dict(r, action="kept") for r in snapshot}
    for r in sorted(batch, key=lambda r: r["seq"]):
        s = stored.get(r["source_url"])
        if s is not None:
            s.update(title=r["title"], status=r["status"], action="created" if s["action"] == "created" else "updated")
            s["amount_max"] = r["amount_max"] if r["amount_max"] is not None else s["amount_max"]
        elif len(r["title"]) <= 10 or r["title"].lower() not in {x["title"].lower() for x in stored.values()}:
            stored[r["source_url"]] = dict(r, action="created")
    return {(r["source_url"], r["title"], r["status"], r["amount_max"], r["action"]) for r in stored.values()}


def test_merge_as_if_row_by_row(spark):
    rng = random.Random(4)
    make = lambda i: {"source_url": f"u{rng.randint(0, 30)}", "title": f"{rng.choice(['Long enough', 'LONG ENOUGH', 'Brief one'])} {rng.choice('abcdefgh')}", "status": rng.choice(["OPEN", "CLOSED"]), "amount_max": rng.choice([None, i]), "seq": i, "id": i, "source_name": "s"}
    snapshot = list({r["source_url"]: r for r in (make(i) for i in range(15))}.values())
    batch = [make(100 + i) for i in range(60)]
    schema = "source_url string, title string, status string, amount_max int, seq int, id int, source_name string"
    rows = lambda d: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in d], schema)
    got = upsert.merge_snapshot(rows(snapshot), rows(batch), kept=("amount_max",), overwritten=("title", "status"))
    assert {(r.source_url, r.title, r.status, r.amount_max, r.action) for r in got.collect()} == sequential(snapshot, batch)
    # "Small grant" has 11 letters and counts, "Smal grants" too, "Tiny grant" with 10 doesn't
    names = [("u1", "Small grant"), ("u2", "SMALL GRANT"), ("u3", "Tiny grant"), ("u4", "TINY grant"), ("u1", "Other title here"), ("u5", "small grant"), (None, "Small grant")]
    tiny = spark.createDataFrame([(u, t, i) for i, (u, t) in enumerate(names)], "source_url string, title string, seq int")
    done = {r.seq: r.action for r in upsert.decided(tiny.limit(0), tiny).collect()}
    assert done == {0: "created", 1: "skipped", 2: "created", 3: "created", 4: "updated", 5: "created", 6: "created"}
    again = upsert.merge_snapshot(rows(snapshot), rows([]), kept=("amount_max",), overwritten=("title", "status"))
    assert {r.action for r in again.collect()} == {"kept"}


def test_two_keys_are_recorded_on_keeping_only(spark):
    rows = spark.createDataFrame([("s", "u1", "t1", 1), ("s", "u1", "t2", 2), ("s", "u2", "t2", 3), ("s", None, "t1", 4), ("s", None, None, 5), ("r", "u1", "t1", 6)], "g string, u string, t string, o int")
    assert {r.o for r in upsert.two_key_dedupe(rows, "g", "u", "t", "o").collect()} == {1, 3, 5, 6}


def test_two_keys_as_if_row_by_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.choice([None, *(f"u{i}" for i in range(40))]), rng.choice([None, *(f"t{i}" for i in range(40))]), i) for i in range(200)]
    seen, want = set(), set()
    for g, u, t, o in rows:
        keys = {(g, "u", u)} if u else set()
        keys |= {(g, "t", t)} if t else set()
        if not keys & seen:
            seen |= keys
            want.add(o)
    assert {r.o for r in upsert.two_key_dedupe(spark.createDataFrame(rows, "g string, u string, t string, o int"), "g", "u", "t", "o").collect()} == want


def test_records_change(spark):
    rows = spark.createDataFrame([(1, "a", [" x "]), (2, "b", None)], "id int, who string, places array<string>")
    patches = spark.createDataFrame([(1, ["who"], " ", ["z"]), (2, ["places"], "q", [" y ", "", None])], "id int, fields array<string>, who string, places array<string>")
    assert [tuple(r) for r in records.patched(rows, patches, "id", ("who",), ("places",)).orderBy("id").collect()] == [(1, None, [" x "]), (2, "b", ["y"])]
    assert records.removed(rows, [1], "id").count() == 1
    for ids, sure in (([], True), (list(range(101)), True), (list(range(11)), False)):
        with pytest.raises(ValueError):
            records.removed(rows, ids, "id", sure)
    raw = F.create_map(F.lit("liveBodyText"), F.lit("t"), F.lit("award"), F.lit("{}"))
    got = spark.range(1).select(records.closed(raw, F.lit("m"), F.lit(404), F.lit("r"), F.lit("now")).alias("m")).first().m
    assert set(got) == {"award", "closedReason"} and '"status":404' in got["closedReason"]


def test_staged_tables_can_be_cleared(spark):
    import os

    assert stage(spark.range(3), "three").count() == 3 and os.listdir(staged_dir(spark).removeprefix("file:"))
    clear_staged(spark)
    assert not os.path.exists(staged_dir(spark).removeprefix("file:"))


def test_positions_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(windows, "RANGE_ROWS", 7)
    rows = spark.range(50).select((F.col("id") * 3 % 50).alias("k"), F.when(F.col("id") % 5 != 0, "hot").alias("g"))
    assert {r.k: r.position for r in windows.numbered(rows, [F.asc("k")], []).collect()} == {i: i for i in range(50)}
    got = windows.batches(rows, [F.asc("k")], 4, ["g"]).collect()
    for g in ("hot", None):
        mine = sorted(((r.k, r.batch) for r in got if r.g == g))
        assert [b for _, b in mine] == [i // 4 for i in range(len(mine))] and mine


def test_maps_and_reconciliation(spark):
    row = spark.range(1).select(upsert.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()
    assert row.m == {"a": "1", "b": "3"}
    cases = spark.createDataFrame([("HIGH", 1, 2), ("MEDIUM", None, 2), ("MEDIUM", 1, 2), ("LOW", 1, 2), ("HIGH", 1, None)], "c string, s int, f int")
    got = [tuple(r.r) for r in cases.select(upsert.reconciled_deadline(F.col("s"), F.col("f"), F.col("c")).alias("r")).collect()]
    assert got == [(2, "ai", "overwritten"), (2, "ai", "filled"), (1, "merged", "disagreement"), (1, "regex", "unchanged"), (1, "regex", "unchanged")]


def test_rules_stop_at_the_first(spark):
    order = [rules.Rule("closed", ("are closed",), ("apply now",)), rules.Rule("loan", ("loan",))]
    rows = spark.createDataFrame([("Applications ARE CLOSED. Loan",), ("are closed, apply now",), ("A loan",), (None,), ("",)], "t string")
    assert [r.r for r in rows.select(rules.reason_of(F.col("t"), order).alias("r")).collect()] == ["closed", None, "loan", None, None]
    tags = rows.select(rules.tags_of(F.col("t"), {"A": ("loan",), "B": ("apply",)}).alias("r")).collect()
    assert [r.r for r in tags] == [["A"], ["B"], ["A"], [], []]


def test_changes(spark):
    old = spark.createDataFrame([("a", None, None), ("b", "x", False), ("c", "x", True)], "url string, content_hash string, needs_reparse boolean").withColumns({"last_checked": F.lit(None).cast("int"), "last_changed": F.lit(None).cast("int")})
    new = spark.createDataFrame([("a", "text", 7), ("b", None, 7)], "url string, body string, captured_at int")
    got = {r.url: (r.last_changed, r.needs_reparse) for r in detect_changes(old, new).collect()}
    assert got == {"a": (7, True), "b": (None, False), "c": (None, True)}


def test_window_opens_with_the_first_hit(spark):
    hits = [0, 1, 2, 3, 4, 5, 60_000_000, 60_000_001]
    start, count, seen = None, 0, []
    for h in hits:
        start, count = step(start, count, h, 60_000_000)
        seen.append(count <= 5)
    assert seen == [True] * 5 + [False, False, True]
    rng = random.Random(2)
    events = [(i, rng.choice([1, 2, None]), rng.randint(0, 5000)) for i in range(400)]
    table = spark.createDataFrame(events, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    want = {}
    for user in (1, 2, None):
        start, count = None, 0
        for i, _, s in sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0])):
            start, count = step(start, count, s * 1_000_000, 600_000_000)
            want[i] = (count, count <= 3)
    assert {r.event_id: (r.nth, r.allowed) for r in limited(table, 600_000_000, 3).collect()} == want


def test_feeds_fields_and_rotation(spark):
    rss = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>https://e.org/{i}</link><pubDate>{d}</pubDate></item>" for i, d in enumerate(["Thu, 1 Jan 2026 00:00:00 +0000", "Sat, 1 Jan 2022 00:00:00 +0000", ""])) + "</channel></rss>"
    feeds = spark.createDataFrame([("f", rss), ("bad", "<rss>")], "feed string, xml string")
    got = adapters.feed_items(feeds, F.expr("TIMESTAMP_NTZ '2026-02-01 00:00:00'"))
    assert {r.title for r in got.collect()} == {"t0", "t2"}
    rows = spark.createDataFrame([({"Grant Name": "x", "DUE": "y"},), ({"title": "z"},)], "fields map<string,string>")
    assert [tuple(r)[1:] for r in adapters.matched_fields(rows, {"title": ["title", "grant name"], "due": ["due"]}).collect()] == [("x", "y"), ("z", None)]
    turn = adapters.rotation(spark, ["a", "b"], [f"r{i}" for i in range(5)], 4, 21_600 * 4).orderBy("place")
    assert [r.query for r in turn.collect()] == ["a", "b", "r4", "r0"]
    hits = spark.createDataFrame([(1, '{"oppHits": [{"id": "7"}]}'), (2, '{"data": {"oppHits": [{"id": "8"}, {"id": "9"}]}}'), (3, "{}")], "seq int, payload string")
    assert sorted(r.id for r in adapters.hits_of(hits).collect()) == ["7", "8", "9"]


def test_calendar_and_facets(spark):
    rows = spark.createDataFrame([(1, "OPEN", "1998-07-31 23:59:59"), (2, "OPEN", "1998-08-01 00:00:00"), (3, "CLOSED", "1998-07-02 00:00:00"), (4, "OPEN", "1998-12-31 10:00:00")], "id int, status string, d string").withColumn("deadline", F.to_timestamp_ntz("d"))
    assert [r.id for r in aggregates.calendar_month(rows, 1998, 7).collect()] == [1]
    assert [r.id for r in aggregates.calendar_month(rows, 1998, 12).collect()] == [4]
    lists = spark.createDataFrame([(["b", "", "a", None],), (None,), ([],)], "x array<string>")
    assert [r.value for r in aggregates.facet(lists, "x").collect()] == ["a", "b"]


def test_stream_counts_like_the_batch(spark, tmp_path):
    from grainmill.streaming.limiter import limit_stream

    events = spark.createDataFrame([(i, i % 3, i * 7) for i in range(60)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limit_stream(stream, 100_000_000, 3).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.nth for r in spark.table("limits").collect()}
    assert got == {r.event_id: r.nth for r in limited(events, 100_000_000, 3).collect()}


