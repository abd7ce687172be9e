import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm.chunking import split_documents, split_text
from grainmill.llm.encode import encode_documents
from grainmill.llm.mixture import mix, plan_sources, share_report


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    from tests.llm.conftest import TOKENIZER

    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


TEXT = st.text(alphabet=st.sampled_from("abcdeéñ中🙂'’ \n\t.,!?0123ABC_-<|>"), max_size=120)


def test_ids_equal_the_public_tokenizer(encoder, reference):
    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        assert encoder.ids(text) == reference.encode(text, add_special_tokens=False).ids

    check()
    for text in ("a" * 20_000, "ab" * 9000, "中" * 3000, "<|endoftext|> x", " \n" * 500, "don't we'll"):
        assert encoder.ids(text) == reference.encode(text, add_special_tokens=False).ids
        assert encoder.decode(encoder.ids(text)) == text


def test_documents_without_text_have_no_ids(spark, encoder):
    rows = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9), (1, "Hello world", 9)], "doc_id long, text string, ids long")
    got = sorted((r.doc_id, r.ids) for r in encode_documents(rows).collect())
    assert got == [(1, encoder.ids("Hello world"))] * 2 + [(2, []), (3, [])]
    assert encode_documents(rows.limit(0)).count() == 0


def pieces_hold(encoder, text, limit, overlap):
    parts = split_text(encoder, text, limit, overlap)
    ids = encoder.ids(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(ids)
    for a, b in zip(parts, parts[1:]):
        assert b[0] == a[1] - b[3] and b[1] > a[1] and abs(b[3] - min(overlap, limit // 2)) <= 4
    assert all(n == encoder.count(t) <= limit for _, _, n, _, t in parts)
    return parts


def test_pieces_stay_under_the_limit(encoder):
    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, min_size=1, max_size=12), st.integers(4, 40), st.integers(0, 24))
    def check(texts, limit, overlap):
        text = "\n\n".join(texts)
        if text:
            pieces_hold(encoder, text, limit, overlap)

    check()
    for text in ("x" * 20_000, "🙂" * 500, "One sentence. " * 400, "\n" * 400):
        pieces_hold(encoder, text, 64, 8)
        pieces_hold(encoder, text, 8, 3)


def test_cuts_fall_where_the_text_pauses(encoder):
    text = "\n\n".join(f"Paragraph {i} says something of its own. It goes on for a while, then it ends." for i in range(80))
    parts = pieces_hold(encoder, text, 100, 0)
    assert all(t.rstrip().endswith(".") for *_, t in parts)
    # an edit moves the cuts near it only
    edited = text.replace("Paragraph 40 says", "Paragraph 40 now says quite")
    before, after = {t for *_, t in parts}, {t for *_, t in split_text(encoder, edited, 100, 0)}
    assert len(before - after) <= 4


def test_small_and_unplanned_texts_stay_whole(spark, encoder):
    long = "A sentence here. " * 100
    rows = spark.createDataFrame([(1, long, "a"), (2, long, "other"), (3, None, "a"), (4, "", "a"), (5, "short", "a"), (6, long, None)], "doc_id long, text string, source string")
    plan = spark.createDataFrame([("a", 0.5, 1, 50, 5)], "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int")
    got = split_documents(rows, plan).collect()
    n = {k: sum(r.doc_id == k for r in got) for k in range(1, 7)}
    assert n[1] > 5 and [n[k] for k in (2, 3, 4, 5, 6)] == [1] * 5
    assert {r.doc_id: r.text for r in got if r.doc_id in (3, 4)} == {3: None, 4: ""}
    assert split_documents(rows.limit(0), plan).count() == 0


def test_mixture_meets_targets_within_caps(spark):
    sizes = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS source", "CAST(20 + id % 30 AS BIGINT) AS tokens")
    plan = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.2, 5), ("none", 0.05, 5)], "source string, target_share double, max_repeats int")
    for tilt in (0.0, 0.6):
        uses = mix(sizes, plan, tilt=tilt)
        report = {r.source: r for r in share_report(uses, sizes, plan).collect()}
        assert report["none"].actual_share == 0 and report["none"].uses == 0
        for name, share in (("big", 0.4), ("mid", 0.35), ("small", 0.2)):
            assert abs(report[name].actual_share - share / 0.95) < 0.01
            assert report[name].most_repeats <= report[name].max_repeats
        rows = uses.collect()
        assert len({(r.doc_id, r["copy"]) for r in rows}) == len(rows)
        assert all(0 <= r.position <= 1 for r in rows) and [r.position for r in rows] == sorted(r.position for r in rows)
    slopes = plan_sources(sizes, plan, 0.6).selectExpr("sum(weight * slope)").first()[0]
    assert abs(slopes) < 1e-9
    assert mix(sizes.limit(0), plan).count() == 0
