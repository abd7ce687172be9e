import json

import pytest
from pyspark.sql import functions as F

from grainmill.llm.boilerplate import find_furniture, main_body, LineModel, PathModel, fit_lines, path_slot, path_sums, smooth
from grainmill.llm.linear import fit, text_features
from grainmill.llm.pages import lines_of, page_texts
from grainmill.llm.residue import HARD, find_residue, fit_residue, has_placeholder, is_void_phrase, repeated_words, validation, weak_label
from grainmill.llm.truncation import descriptions, find_cut, length_spikes, segments, skeleton
from grainmill.runtime import table
from tests.llm.conftest import GRANT

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("text", ["Apply to {{ org.name }} now", "[INSERT CITY]", "by mm/dd/yyyy", "${phone}", "<%= title %>", "&lt;PROGRAM&gt;", "[Your name here]", "the undefined offers", "____[body]", "*|NAME|*", "$org.name$", "<?= $x ?>", "{0}", "[        ]"])
def test_placeholders(text):
    assert has_placeholder(text)


@pytest.mark.parametrize("text", ["formerly known as the initiative [see section 4].", "insert the tax number on line 24", "JavaScript bootcamps included", "5% match", "a <b>bold</b> word", "[Updated] Harbor Fund", "$5,000 or $7,500", ""])
def test_no_placeholders(text):
    assert not has_placeholder(text)


def test_weak_labels():
    assert repeated_words("foo bar foo bar 8") and repeated_words("test, test, 64") and not repeated_words("A floor plan")
    assert is_void_phrase("You need to enable JavaScript") and is_void_phrase("The page was moved to another place")
    title = "Harbor Fund"
    assert weak_label("Harbor Fund", title, "text") == 0 and weak_label("", title, "text") == 0
    assert weak_label("Service Unavailable", title, "text") == 2 and weak_label("Welcome to {name}", title, "text") == 1
    assert weak_label("Anyone who gets an error 404 on the old portal should start again. " + "Growers may apply for new looms. " * 12, title, "text") == HARD


def test_classifier_learns_and_repeats():
    items = [text_features(t) for t in ("good text here", "fine words stand", "error page gone", "server error now")] * 10
    a, b = (fit(items, [0, 0, 1, 1] * 10, 2) for _ in range(2))
    assert a.probabilities(text_features("server error page"))[1] > 0.5 > a.probabilities(text_features("fine text here"))[1]
    assert (a.weights == b.weights).all()
    assert abs(fit([], [], 2).probabilities(["x"])[0] - 0.5) < 1e-6


@pytest.mark.parametrize("text", ["Service Unavailable", "Welcome to {{name}}, a program for growers.", "lorem ipsum " * 30, "You need to enable JavaScript to run this page."])
def test_phrases_decide_nothing_without_the_classifier(text):
    from grainmill.llm.residue import ResidueModel

    assert weak_label(text, "Harbor Fund", "text") in (1, 2)
    assert not ResidueModel(fit([], [], 3)).is_case(text, "Harbor Fund", "text")


def test_unseen_hosts(spark):
    rows = {r.kind_of_case: r for r in validation(page_texts(table(spark, DATA, "grants"))).collect()}
    assert set(rows) == {"residue", "void", "any"} and rows["any"].texts > 50
    assert all(r.recall >= 0.9 and r.precision >= 0.95 for r in rows.values())
    assert validation(page_texts(table(spark, DATA, "grants").limit(0))).where("recall is not null").count() == 0


def rows_of(spark, texts):
    rows = [(i, f"g{i}", "Harbor Fund", d, "https://a.org/x", "s", None, None, "OPEN", None, None, None, raw) for i, (d, raw) in enumerate(texts)]
    return spark.createDataFrame(rows, GRANT)


def with_context(spark, texts):
    """Given texts among those of the data, which the classifiers learn from."""
    known = table(spark, DATA, "grants")
    extra = rows_of(spark, texts)
    return known.unionByName(extra.withColumns({c: F.lit(None).cast(known.schema[c].dataType) for c in known.columns if c not in extra.columns}).select(*known.columns))


def test_residue_cases_and_edges(spark):
    page = json.dumps({"liveBodyText": "Loading ... please wait"})
    texts = [("Welcome to {{name}}, a program for growers.", None), ("Service Unavailable", page), ("Harbor Fund", None), (None, "{broken"), ("", "[]"), ("This program supports growers in Larkes County that plan to add evening shifts.", None), ("lorem ipsum " * 20_000, None), ("Funding is available for growers and street vendors around Larkes Grove. Anyone who gets an error 404 on the old portal should start again.", json.dumps({"closedReason": {"status": 404}}))]
    rows = with_context(spark, texts)
    got = {(r.grant_id, r.field) for r in find_residue(rows).collect() if len(r.grant_id) < 4}
    assert got == {("g0", "description"), ("g1", "description"), ("g1", "raw_data"), ("g6", "description")}
    assert find_residue(rows.limit(0)).count() == 0


HTML = """<html><body>
<div class="c1">
<p>Home | News | Contact | Funding</p>
<span>We use cookies to keep this site running. Accept Decline</span>
</div>
<div class="c2">
<p>Harbor Fund</p>
<p>This program supports growers in Larkes County that plan to add evening shifts. Awards range from $1,000 to $9,000, depending on the size of the project. Requests are reviewed in the order received.</p>
<p>- A floor plan <a href="/f">Form</a></p>
</div>
<div class="c3">
<li><a href="/p">Privacy notice | Terms of use | Accessibility</a></li>
</div>
</body></html>"""


def test_lines_and_paths():
    lines = lines_of(HTML, "html")
    assert [x.number for x in lines] == [3, 4, 7, 8, 9, 12]
    assert lines[0].path.endswith("div.c1/p") and lines[-1].linked > 20
    assert [x.number for x in lines_of("a\n\n  b\n \nc", "text")] == [1, 3, 5]
    assert [x.node for x in lines] == [3, 3, 6, 6, 6, 11]
    assert path_slot("html/body/div.c1/p") == path_slot("html/body/div.x9/p") != path_slot("html/body/nav/p")
    assert smooth([-3, -3, 0.5, -3, 4, 4, -0.5, 4]) == [False] * 4 + [True] * 4


def test_furniture_of_pages(spark):
    text = "Home | News | Contact | Funding\nHarbor Fund\n\nThis program supports growers in Larkes County that plan to add evening shifts. Requests are reviewed in the order received.\n* A floor plan\nPrivacy notice | Terms of use | Accessibility"
    texts = [(text, json.dumps({"pageHtml": HTML})), ("One line only.", None), (None, None), ("Service Unavailable\n\nError 503", None)]
    got = {(r.grant_id, r.field, r.line_no) for r in find_furniture(with_context(spark, texts)).collect() if len(r.grant_id) < 4}
    assert got == {("g0", "description", 1), ("g0", "description", 6), ("g0", "raw_data", 3), ("g0", "raw_data", 4), ("g0", "raw_data", 12)}
    assert main_body(text, [1, 6]).startswith("Harbor Fund") and find_furniture(rows_of(spark, texts).limit(0)).count() == 0


def test_paths_decide_which_lines_are_furniture(spark, monkeypatch):
    """Without the ratios of the tag paths the planted furniture of HTML pages is not told from the body."""
    from grainmill.llm.linear import fit

    sums = path_sums(page_texts(table(spark, DATA, "grants"))).toPandas()
    paths, none = PathModel.of(sums), fit([], [], 2)
    nav = HTML.replace('<div class="c1">', "<nav>").replace("</span>\n</div>", "</span>\n</nav>", 1)
    assert LineModel(paths, none).furniture(nav, "Harbor Fund", "html") == [3, 4, 12]
    monkeypatch.setattr(PathModel, "elements", lambda self, lines, own: [([i], 1.0) for i in range(len(lines))])
    assert LineModel(paths, none).furniture(nav, "Harbor Fund", "html") == []


def test_path_sums_are_whole_and_small(spark):
    rows = spark.createDataFrame([("html", HTML)] * 3 + [("text", "a\nb")], "kind string, text string")
    sums = path_sums(rows)
    assert sums.agg(F.sum("nodes")).first()[0] == 18 and sums.count() == 3
    model = fit_lines(page_texts(table(spark, DATA, "grants").limit(0)))
    assert model.furniture("Home | News\nHarbor Fund\nGrowers may apply.", "Harbor Fund", "text") == []


def test_segments_and_skeletons():
    assert segments("One. Two\nThree!") == [("One.", False), ("Two", True), ("Three!", True)]
    assert skeleton("Apply to Larkes Grove by June 16, 2026.") == skeleton("Apply to Harl Falls by May 27, 2025")
    assert skeleton("by June 16, 20") != skeleton("by June 16, 2026")


def test_spikes_and_cut_texts(spark):
    grants = table(spark, DATA, "grants")
    cuts = [("This program supports growers in Larkes Falls County that plan to add eve", None), ("Through the Innovation Bureau, growers can apply for help to lower power bills. Late requests are held [...]", None), ("Harbor Fund", None), ("Requests are reviewed in the order received. Match required: yes", None), ("", None), (None, None), ("Late requests are held for the following round", None)]
    raw = table(spark, DATA, "raw_grants")
    found = {r.record_id: r.cut for r in find_cut(with_context(spark, cuts), raw).where("length(record_id) < 3 AND record_table = 'grants'").collect()}
    assert found == {"g0": True, "g1": True, "g2": False, "g3": False, "g6": False}
    spikes = length_spikes(descriptions(grants, raw)).where("unit = 'chars'").collect()
    assert {(r.source_name, r.length) for r in spikes} >= {("opp-search-api", 2000), ("state-econ-office", 500)}
    assert find_cut(grants.limit(0), raw.limit(0)).count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    closed = [f"Growers in county {n} may apply. Preference goes to shops open for at least {n} months in a row" for n in range(2, 9)]
    cut = "Growers may apply. Preference goes to shops open for at least 3 mon"
    closing = [f"Program {n} opens soon for growers. Watch this zxspace ..." for n in range(4)]
    grants = with_context(spark, [(x, None) for x in closed + [cut] * 4 + closing])
    found = {r.record_id: r.cut for r in find_cut(grants, table(spark, DATA, "raw_grants")).where("length(record_id) < 4 AND record_table = 'grants'").collect()}
    assert all(found[f"g{i}"] for i in range(7, 11)) and not any(found[f"g{i}"] for i in range(11, 15))


def test_continuations_count_what_begins_with_an_end(spark):
    from grainmill.llm.truncation import continuations

    rows = [("growers may apply", 4, 2), ("growers may apply for looms", 3, 0), ("growers may app", 0, 1), ("growers may", 0, 5), ("growers maybe later", 2, 0), ("", 0, 9), ("zz", 0, 1), ("a " * 500_000 + "b", 1, 1)]
    got = {r.skeleton: r.goes_on for r in continuations(spark.createDataFrame(rows, "skeleton string, whole bigint, open bigint")).collect()}
    want = {s: sum(w + o for t, w, o in rows if t.startswith(s) and t != s) for s, _, o in rows if o and s}
    assert got == want and continuations(spark.createDataFrame([], "skeleton string, whole bigint, open bigint")).count() == 0


def test_reasons_are_told_apart(spark):
    body = lambda i, n: (f"{i:05d} " + "growers may apply for looms " * 40)[:n]
    rows = [("x", body(i, 400)) for i in range(40)] + [("x", body(100 + i, 130 + 3 * i) + ".") for i in range(80)] + [("x", "Growers may apply for help with [...]"), ("x", "Growers may apply for lo")]
    raw = spark.createDataFrame([(i, s, None, t) for i, (s, t) in enumerate(rows)], "raw_id long, source_name string, title string, description string")
    found = {int(r.record_id): r.reason for r in find_cut(rows_of(spark, []), raw).collect()}
    assert all(found[i] == "spike" for i in range(40)) and found[120] == "mark" and found[121] == "ending"
    assert not any(found[i] for i in range(40, 120))


def test_every_limit_is_a_spike_whatever_is_copied(spark):
    body = lambda i, n: (f"{i:05d} " + "growers may apply for looms " * 40)[:n]
    rest = [body(i, 130 + 3 * i) for i in range(150)]
    texts = ["whole " * 40] * 200 + [body(1000 + i, 400) for i in range(40)] + [body(2000 + i, 410) for i in range(25)] + rest
    rows = spark.createDataFrame([("grants", "s", x) for x in texts], "record_table string, source_name string, text string")
    assert {(r.unit, r.length) for r in length_spikes(rows).collect()} == {(u, n) for u in ("chars", "bytes") for n in (400, 410)}


def test_cut_texts_are_asked_of_the_model_of_problem_1(spark, monkeypatch):
    grants, seen = table(spark, DATA, "grants"), []

    def spy(texts):
        seen.extend(r.field for r in texts.select("field").distinct().collect())
        return fit_residue(texts, most=50)

    monkeypatch.setattr("grainmill.llm.truncation.fit_residue", spy)
    find_cut(grants, table(spark, DATA, "raw_grants").limit(0))
    assert set(seen) == {"description", "raw_data"}
