"""Template residue, filler, error pages and demands for scripts in place of content.

Lines with a response status and phrases give weak labels to a bounded sample of texts; a softmax
classifier over hashed n-grams, length and title features is fitted to their sentences. It then
scores every sentence of every text, and its scores alone decide: a text is a case if a sentence
is residue of a template, which a pattern then confirms, or if what fills the text's place is
void (filler, an error message, a demand for scripts). The phrases are not asked again.
`validation` fits without a fifth of the hosts and reports recall and precision on those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.linear import Scorer, Softmax, fit, form_features, form_of, slots_of
from grainmill.llm.pages import is_title, page_texts, title_key, without_tags
from grainmill.runtime import stage

#: Labelled texts per class that the classifier is fitted to (a bound on the sample); of fine ones so many times more.
SAMPLE, FINE_TIMES = 3000, 3
#: Texts looked at for each that is wanted.
SIEVE = 40
#: Longest text that the classifier is fitted to (a bound on the sample; every text is scored whole).
LONGEST = 20_000
#: Fine texts learned from for each case.
FINE_PER_CASE = 5
FINE, RESIDUE, VOID = 0, 1, 2
#: Score from which a sentence is residue or void, and the share of void text that makes a case.
ENOUGH, MOSTLY = 0.5, 0.55
#: Score of void up to which a sentence is surely fine; its length if it says something; the share of void text that outweighs it.
SURELY_FINE, SAYS, NEARLY_ALL = 0.12, 45, 0.85

#: Placeholders that no reader should see (fixed patterns).
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\{%[^%\n]{0,60}%\}",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"(?<![\w$])\$[A-Za-z_][\w.]{1,40}\$(?![\w$])",
    r"\{!?[A-Za-z_][\w.]{0,60}\}",
    r"\{\d{1,2}\}",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<%=?[^%\n]{1,60}%>",
    r"<<[^<>\n]{1,60}>>",
    r"(?:<|&lt;)(?:enter|insert|your|add) [^<>\n]{1,60}(?:>|&gt;)",
    r"&lt;[A-Z][A-Z _]{1,40}&gt;",
    r"%%[A-Za-z_ ]{1,40}%%",
    r"\*\|[A-Z_ ]{1,40}\|\*",
    r"@@[\w.]{1,40}@@",
    r"(?<!\w)~[A-Za-z][\w.]{1,40}~",
    r"<\?=?[^?<>\n]{1,60}\?>",
    r"(?<![?!\w])\?\?(?![?!])",
    r"(?<!\w)__[A-Z][A-Z _]{1,40}__",
    r"_{3,}\[[^\[\]\n]{1,60}\]",
    r"\[\s{3,}\]",
    r"\[(?:INSERT|insert|Insert|ADD|add|Add|YOUR|your|Your|ENTER|enter|Enter)\b[^\[\]\n]{0,60}\]",
    r"\((?:INSERT|insert|Insert|ADD|add|Add|ENTER|enter|Enter) [^()\n]{1,60}\)",
    r"\[[^\[\]\n]{1,60} (?:TBD|TBA|TBC|TK)\]",
    r"\[[A-Z][A-Z _]{2,40}\]",
    r"\[object Object\]",
    r"#(?:REF|N/A|VALUE|NAME\?|DIV/0)!?(?!\w)",
    r"\bundefined\b",
    r"\bNaN\b",
    r"(?<![\w%])%[sd](?!\w)",
    r"\$X{1,3}(?:,X{3})*\b",
    r"\bXX/XX/(?:XX|20XX|XXXX)",
    r"\bmm/dd/yyyy\b|\bdd/mm/yyyy\b",
    r"\b000-000-0000\b",
    r"\$0,000(?:\.00)?",
)
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
#: Where a placeholder can begin: looked for first, since it is much cheaper.
_BEGINS = re.compile(r"[{\[(<%*@~_#?$&]")
_WORDS = ("undefined", "NaN", "XX/", "mm/dd", "dd/mm", "000-000")


def has_placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands anywhere in a text."""
    if any(_PLACEHOLDER.match(text, m.start()) for m in _BEGINS.finditer(text)):
        return True
    return any(w in text for w in _WORDS) and _PLACEHOLDER.search(text) is not None


#: Lines that carry a response status (weak labels).
_WRONG = "error|forbidden|found|gone|gateway|unavailable|unauthorized|requests|denied|timeout"
STATUS = rf"\b[45]\d\d\b.{{0,20}}(?:{_WRONG})|(?:{_WRONG})\W{{0,3}}\(?\b[45]\d\d\b"
#: Phrases that stand where a text is missing, failed or waits for scripts (weak labels).
STUBS = r"(?:goes here|coming soon|will follow|to be (?:added|supplied|written|completed)|(?:- )?replace before publishing|draft, do not publish|max \d+ sentences|needed from program staff)\b|^\W*(?:todo|tbd)\b|placeholder|add your content|edit this text block|text block|lorem|ipsum|dummy|do not remove|(?:text|copy|description|summary|overview|paragraph) pending"
ERRORS = (
    r"service unavailable|unknown error|internal server error|bad gateway|too many requests|^\W*(?:forbidden|unauthorized|gone|not found)\b|<h1>"
    r"|(?:page|address|file|link|listing|record|document|item|detail|site|program detail)\b.{0,30}\b(?:not (?:be )?(?:found|displayed|available)|does(?:n't| not) exist|no longer exists?|cannot be|(?:was|been) (?:moved|removed|deleted|taken down)|has expired|out of reach)"
    r"|did not load|could not be (?:found|loaded|shown)|went wrong|fatal error|uncaught|timed? ?out|disconnect|traceback|exception\b.{0,3}(?:at|:)|sql ?state|stack trace|rate limit|session has expired|access denied|acceso denegado|has been blocked|(?:is|are) not here|not allowed to (?:open|view)|planned maintenance|being built|temporarily|no encontrada|error del servidor|intente de nuevo"
)
SCRIPTS = (
    r"(?:enable|activate|turn on|switch on|allow|requires?|without|does not run|run)\b.{0,25}\b(?:java ?script|js|scripts?|scripting|active content)\b|(?:java ?script|scripts?|scripting|active content)\b.{0,25}\b(?:is|are|be) (?:off|active|disabled|blocked|enabled|required)|active scripting|^noscript"
    r"|browser (?:version )?(?:is not|does not)|^\W*loading\b|please wait|checking your browser|prove that you are"
)
_VOID_WORDS = re.compile(f"(?i:{STATUS}|{STUBS}|{ERRORS}|{SCRIPTS})", re.M)
#: One of these stands in every void phrase; a cheap test before the patterns.
HINTS = (
    "goes here|coming soon|will follow|to be added|to be supplied|to be written|to be completed|replace before|do not publish|sentences|program staff|todo|tbd|placeholder|your content|text block|lorem|ipsum|dummy|do not remove| pending|"
    "unknown error|server error|forbidden|not found|be found|gone|bad gateway|service unavailable|unauthorized|too many requests|access denied|denegado|timeout|time out|timed out|timedout|<h1>|displayed|not available|not be available|not exist|n't exist|longer exist|cannot be|was moved|was removed|was deleted|was taken down|"
    "been moved|been removed|been deleted|been taken down|has expired|out of reach|did not load|could not be|wrong|fatal|uncaught|disconnect|traceback|exception|sql|stack trace|rate limit|been blocked|not here|not allowed to|maintenance|being built|temporarily|encontrada|error del|intente|"
    "script|js|active content|browser|loading|please wait|prove that"
)
_CODE, _STATUS = re.compile(r"\b[45]\d\d\b"), re.compile(STATUS)


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    got = ahocorasick.Automaton()
    for h in HINTS.split("|"):
        got.add_word(h, h)
    got.make_automaton()
    return got


def _hinted(low: str) -> bool:
    """Whether a void phrase can stand in a text in lower case."""
    return next(_hints().iter(low), None) is not None or (_CODE.search(low) is not None and _STATUS.search(low) is not None)


def is_void_phrase(text: str) -> bool:
    """Whether a response status or a phrase stands in a text that takes the place of content (a weak label)."""
    return _hinted(text.lower()) and _VOID_WORDS.search(text) is not None


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Longest text that a void phrase labels as void by itself.
SHORT = 400


def sentences_of(text: str, kind: str) -> list[str]:
    """The sentences and lines of a text, without tags and blanks."""
    return [s for x in _SENTENCE.split(without_tags(text, kind)) if (s := x.strip())]


def repeated_words(text: str) -> bool:
    """Whether a text is one or two words over and over, perhaps with a number."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return len(words) > 1 and len(set(words)) <= max(1, min(2, len(words) // 2))


@lru_cache(maxsize=100_000)
def _is_void(sentence: str) -> bool:
    return is_void_phrase(sentence) or repeated_words(sentence) or sentence.lower().count("ipsum") > 1


#: Length beyond the title from which a text without any phrase is fine without a closer look.
ROOMY = 150


#: Label of a fine text in which a phrase stands all the same.
HARD = 3


def weak_label(text: str, title: str, kind: str) -> int | None:
    """The class that phrases and status lines suggest for a text (HARD: fine in spite of one); None if nothing does."""
    if has_placeholder(text):
        return RESIDUE
    if kind == "text" and len(text) - len(title) > ROOMY and not repeated_words(text[:ROOMY]) and not _hinted(text.lower()):
        return FINE  # no sentence can be void, and there is more than the title
    own = title_key(title)
    parts = [x for x in sentences_of(text, kind) if not is_title(x, own)]
    if not parts:
        return FINE
    total = sum(map(len, parts))
    void = sum(len(x) for x in parts if _is_void(x))
    if void >= 0.4 * total and total <= SHORT or void >= 0.8 * total:
        return VOID
    return (HARD if void else FINE) if void <= 0.2 * total and total > 60 else None


def _shape(named: bool, text_size: int, count: int) -> tuple[str, ...]:
    """Features of the text around a sentence."""
    out = (f"#text{min(6, text_size // 100)}", f"#of{min(4, count)}")
    return (*out, "#title") if named else out


class ResidueModel:
    """Scores sentences and decides about texts."""

    def __init__(self, classifier: Softmax):
        self.classifier = classifier
        self.scorer = Scorer(classifier)

    def shares(self, text: str, title: str, kind: str) -> tuple[float, float, float]:
        """The highest residue score of a sentence, the share of void text and the length of the longest sentence that is surely fine, the title left out."""
        parts = sentences_of(text, kind)
        own = title_key(title)
        size, residue, void, total, plain = sum(map(len, parts)), 0.0, 0, 0, 0
        shapes = [_shape(named, size, len(parts)) for named in (False, True)]
        for s in parts:
            named = is_title(s, own)
            _, r, v = self.scorer.probabilities(s, shapes[named])
            residue = max(residue, r)
            if not named:
                n = len(s)
                total += n
                if v < SURELY_FINE:
                    plain = max(plain, n)
                void += n * (v >= ENOUGH)
        return residue, void / total if total else 0.0, plain

    def found(self, text: str, title: str, kind: str) -> int:
        """The class of a text by the classifier alone. Blank texts and bare titles are fine."""
        residue, void, plain = self.shares(text, title, kind)
        # one sentence that surely says something keeps a text, unless hardly anything else is there
        if void >= (MOSTLY if plain < SAYS else NEARLY_ALL):
            return VOID
        return RESIDUE if residue >= ENOUGH else FINE

    def is_case(self, text: str, title: str, kind: str) -> bool:
        """Whether a text is void, or holds residue that a pattern confirms."""
        got = self.found(text, title, kind)
        return got == VOID or (got == RESIDUE and has_placeholder(text))


def labelled_sample(texts: DataFrame, most: int = SAMPLE) -> pd.DataFrame:
    """At most `most` weakly labelled texts per class.

    A sieve by hash lets through about SIEVE * most texts, whatever the size of the table, so
    labelling costs the same on a terabyte; of each class those with the smallest hashes stay.
    Fine texts in which a phrase stands are a class of their own here, as they teach most.
    """

    known = texts.count()
    rate = min(1.0, SIEVE * most / max(1, known))
    # of fine texts there are plenty: a second sieve lets through twice what is wanted
    fine = round(min(1.0, 2 * FINE_TIMES * most / max(1.0, rate * known)) * 65_536)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [weak_label(t, title, k) for t, title, k in zip(b.text, b.title, b.kind)]
            at = [i for i, (x, h) in enumerate(zip(got, b.h)) if x is not None and (x != FINE or (int(h) >> 24) % 65_536 < fine)]
            yield b.iloc[at].astype({c: object for c in ("host", "title", "kind", "text")}).assign(label=[got[i] for i in at])[["host", "title", "kind", "text", "label", "h"]]

    rows = texts.where(F.length("text") < LONGEST).withColumn("h", F.xxhash64("host", "title", "text"))
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < F.lit(round(rate * 1_000_000)))
    rows = stage(rows.select("host", "title", "kind", "text", "h").mapInPandas(label, "host string, title string, kind string, text string, label int, h bigint"), "labelled")
    got = pd.concat([rows.where(F.col("label") == c).orderBy("h").limit(most * (FINE_TIMES if c == FINE else 1)).toPandas() for c in (FINE, HARD, RESIDUE, VOID)], ignore_index=True)
    # where cases are rare, so many fine texts would drown them
    usual = max(200, FINE_PER_CASE * int(got["label"].isin((RESIDUE, VOID)).sum()))
    got = pd.concat([got[got["label"] == FINE].nsmallest(usual, "h"), got[got["label"] != FINE]])
    return got.assign(label=got["label"].replace(HARD, FINE))


def training_items(sample: pd.DataFrame) -> tuple[list[np.ndarray], list[int], list[float]]:
    """Slots, classes and weights of the sentences of labelled texts.

    Sentences of one form, surroundings and class are one item, which weighs as their number.
    """
    seen: dict[tuple, int] = {}

    def add(sentence: str, named: bool, size: int, count: int, y: int) -> None:
        k = (form_of(sentence), _shape(named, size, count), y)
        seen[k] = seen.get(k, 0) + 1

    for title, kind, text, label in sample[["title", "kind", "text", "label"]].itertuples(index=False, name=None):
        parts, own = sentences_of(text, kind), title_key(title)
        size = sum(map(len, parts))
        for s in parts:
            named = is_title(s, own)
            if label == RESIDUE:
                y = RESIDUE if has_placeholder(s) else FINE
            else:
                y = FINE if named else int(label)
            add(s, named, size, len(parts), y)
        if label == FINE and parts:
            # a fine text that was cut short, or is short, is fine as well
            h = hash_of(text)
            body = [x for x in parts if not is_title(x, own)] or parts
            cut = body[h % len(body)]
            cut = cut[: max(8, h // 7 % (len(cut) + 1))]
            at = h // 11 % len(body)
            for short in ([cut], body[:1], body[:2], [body[0], cut], body[at : at + 3]):
                n = sum(map(len, short))
                for x in short:
                    add(x, False, n, len(short), FINE)
    items = [slots_of([*form_features(form), *shape]) for form, shape, _ in seen]
    return items, [y for _, _, y in seen], [float(n) for n in seen.values()]


def _unseen(host: pd.Series) -> np.ndarray:
    """Which hosts are kept out of the fit in validation."""
    return np.array([hash_of(h) % 5 == 0 for h in host], dtype=bool)


def hash_of(text: str | None) -> int:
    """A number that a host always has."""
    from zlib import crc32

    return crc32((text or "").encode("utf-8", "surrogatepass"))


def _fitted(sample: pd.DataFrame) -> ResidueModel:
    items, labels, times = training_items(sample)
    return ResidueModel(fit(items, labels, classes=3, times=times, batch=128, rate=1.0))


def _sorted_sample(texts: DataFrame, most: int) -> pd.DataFrame:
    return labelled_sample(texts, most).sort_values(["label", "h", "text"]).reset_index(drop=True)


def fit_residue(texts: DataFrame, most: int = SAMPLE) -> ResidueModel:
    """Fit the classifier to at most `most` labelled texts a class, of all hosts."""
    return _fitted(_sorted_sample(texts, most))


def validation(texts: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(kind_of_case, hosts, texts, found, both, recall, precision) of the classifier on hosts it wasn't fitted to.

    A fifth of the hosts, by hash, is kept out of the fit. Their labelled texts are judged by the
    classifier alone, without the pattern that confirms residue, and held against the labels,
    which the decision doesn't use. One row for "residue", "void" and "any"; shares without a
    text are null.
    """
    sample = _sorted_sample(texts, most)
    unseen = _unseen(sample["host"]) if len(sample) else np.zeros(0, dtype=bool)
    model, rest = _fitted(sample[~unseen]), sample[unseen]
    got = np.array([model.found(t, title, k) for t, title, k in zip(rest.text, rest.title, rest.kind)], dtype=int)
    want = rest["label"].to_numpy(dtype=int)
    rows = []
    for name, g, w in (("residue", got == RESIDUE, want == RESIDUE), ("void", got == VOID, want == VOID), ("any", got > 0, want > 0)):
        n, found, both = int(w.sum()), int(g.sum()), int((g & w).sum())
        rows.append((name, int(rest["host"].nunique()), n, found, both, both / n if n else None, both / found if found else None))
    return texts.sparkSession.createDataFrame(rows, "kind_of_case string, hosts bigint, texts bigint, found bigint, both bigint, recall double, precision double")


def residue_cases(texts: DataFrame, model: ResidueModel, key: str = "grant_id") -> DataFrame:
    """(key, field) of the texts that are cases, each field once; texts come from page_texts."""
    weights = texts.sparkSession.sparkContext.broadcast(model.classifier.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = ResidueModel(Softmax(weights.value))
        for b in batches:
            hit = [local.is_case(t, title, k) for t, title, k in zip(b.text, b.title, b.kind)]
            yield b.loc[hit, ["gm_key", "field"]].astype(object)

    rows = texts.select(F.col(key).alias("gm_key"), "title", "field", "kind", "text")
    kind = rows.schema["gm_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"gm_key {kind}, field string").distinct().withColumnRenamed("gm_key", key)


def find_residue(grants: DataFrame, key: str = "grant_id") -> DataFrame:
    """(key, field) of every description or page text that should be left out.

    Null and empty texts are no cases; of repeated rows the pair comes out once.
    """
    texts = page_texts(grants, key)
    return residue_cases(texts, fit_residue(texts), key)
