"""The main body of pages: furniture of the site is told from the program's own lines.

In HTML, text length and punctuation are summed per root-to-leaf tag path, over all pages in
Spark and per element within the page. The two ratios are smoothed over the leaves of each
element and fused, and elements whose ratio passes a threshold hold the content. Only where an
element lies close to the threshold are its lines asked as well: by a classifier of single
lines, fitted to what the paths decide clearly on a bounded sample of pages. Pages kept as plain
text have no tags left; there that classifier stands in for the paths, smoothed along the lines.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.linear import Scorer, Softmax, fit, slots_of, text_features
from grainmill.llm.pages import Line, lines_of, page_texts, title_key
from grainmill.llm.residue import ResidueModel, fit_residue

#: HTML pages that the classifier of lines is fitted to, and the longest of them (bounds on the sample).
SAMPLE, LONGEST = 4000, 20_000
#: Slots that tag paths are hashed into; the table of ratios has as many rows, whatever the number of pages.
SLOTS = 1 << 14
#: Weights of the ratios over all pages and within the page, and what the headline adds to its element.
OVERALL, WITHIN, HEADLINE = 2.0, 0.25, 2.0
#: Fused ratio from which an element holds content, and how near to it lies doubt.
CONTENT, DOUBT = 0.6, 0.8
#: Weight of the lines' mean log odds against the ratio, in doubt.
LINES = 1.0
#: Fits after the first, which learn from the elements in doubt as well, as the fit before decides them.
ROUNDS, CLEAR = 2, 0.25
#: Cost, in log odds, of changing between body and furniture from one line to the next.
CHANGE = 0.75
#: Lines of so few words say less by themselves: their odds count less.
FEW_WORDS, FEW_COUNT = 2, 0.7
_STOP = re.compile(r"[.!?](?:\s|$)")


def path_slot(path: str) -> int:
    """The slot of a tag path; classes and ids are left out, as sites make them up."""
    return crc32("/".join(x.split(".", 1)[0] for x in path.split("/")).encode("utf-8", "surrogatepass")) % SLOTS


def ratio(nodes: float, chars: float, stops: float, linked: float) -> float:
    """Mean text length of nodes, weighed by their sentence ends and by how much is no link."""
    return (chars / nodes) * (0.1 + stops / nodes) * (1 - 0.6 * linked / max(1.0, chars))


def _sizes(x: Line) -> tuple[int, int, int]:
    return len(x.text), len(_STOP.findall(x.text)), x.linked


def path_sums(texts: DataFrame) -> DataFrame:
    """(slot, nodes, chars, stops, linked): sums per tag path over all HTML pages, added up per batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text in b.text:
                for x in lines_of(text, "html"):
                    s = sums[path_slot(x.path)]
                    chars, stops, linked = _sizes(x)
                    s[0] += 1
                    s[1] += chars
                    s[2] += stops
                    s[3] += linked
            yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["slot", "nodes", "chars", "stops", "linked"])

    parts = texts.where("kind = 'html'").select("text").mapInPandas(run, "slot int, nodes bigint, chars bigint, stops bigint, linked bigint")
    return parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("nodes", "chars", "stops", "linked")])


class PathModel:
    """The log ratio of each tag path against that of all nodes."""

    def __init__(self, levels: np.ndarray, mean: float):
        self.levels, self.mean = levels, mean

    @classmethod
    def of(cls, sums: pd.DataFrame) -> PathModel:
        """From path_sums, at most SLOTS rows; without pages all paths are alike."""
        levels = np.zeros(SLOTS, np.float32)
        if not len(sums):
            return cls(levels, 1.0)
        mean = ratio(*map(float, sums[["nodes", "chars", "stops", "linked"]].sum()))
        for slot, *rest in sums[["slot", "nodes", "chars", "stops", "linked"]].itertuples(index=False, name=None):
            levels[slot] = math.log(max(1e-6, ratio(*rest)) / max(1e-6, mean))
        return cls(levels, max(1e-6, mean))

    def elements(self, lines: list[Line], own: str) -> list[tuple[list[int], float]]:
        """The lines of each element of a page with its fused ratio, less the threshold: content from 0 on.

        The ratio over all pages is smoothed over the element's leaves; the one within the page
        is that of the element itself. The element of the headline gains HEADLINE.
        """
        by_node: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(lines):
            by_node[x.node].append(i)
        out = []
        for at in by_node.values():
            sizes = [_sizes(lines[i]) for i in at]
            overall = sum(float(self.levels[path_slot(lines[i].path)]) for i in at) / len(at)
            within = math.log(ratio(len(at), *map(sum, zip(*sizes))) / self.mean)
            head = bool(own) and any(k.startswith(own) for k in _keys([lines[i] for i in at], own))
            out.append((at, OVERALL * overall + WITHIN * within + HEADLINE * head - CONTENT))
        return out


def _keys(lines: list[Line], own: str) -> list[str]:
    """The title_key of each line; nothing for lines too short to hold the headline's."""
    return [title_key(x.text) if len(x.text) >= len(own) else "" for x in lines]


def line_shapes(lines: list[Line], own: str) -> list[tuple[str, ...]]:
    """Features of each line beside its words: its size and how it stands to the headline."""
    keys = _keys(lines, own) if own else []
    heads = [i for i, k in enumerate(keys) if k == own]
    out = []
    for i, x in enumerate(lines):
        f = [f"#len{min(8, len(x.text) // 25)}", f"#stops{min(4, len(_STOP.findall(x.text)))}"]
        if own and keys[i] == own:
            f += ["#headline", "#headline again" if i != heads[0] else "#headline first"]
        elif own and own in keys[i]:
            f.append("#names headline")
        if heads:
            f.append("#before" if i < heads[0] else "#after")
        if x.text[0] in "-*•+·»›|©":
            f.append("#sign" + x.text[0])
        out.append(tuple(f))
    return out


class LineModel:
    """Decides which lines of a page are furniture."""

    def __init__(self, paths: PathModel, classifier: Softmax):
        self.paths, self.classifier = paths, classifier
        self.scorer = Scorer(classifier)

    def odds(self, text: str, shape: tuple[str, ...]) -> float:
        """Log odds that a line is furniture."""
        p = self.scorer.probabilities(text, shape)[1]
        return max(-6.0, min(6.0, math.log(max(p, 1e-9) / max(1 - p, 1e-9))))

    def furniture(self, text: str, title: str, kind: str) -> list[int]:
        """Numbers of the furniture lines; none if the text has no body but its headline."""
        lines = lines_of(text, kind)
        if len(lines) < 2:
            return []
        own = title_key(title)
        own_line = [bool(own) and k == own for k in _keys(lines, own)]
        hit = self.by_paths(lines, own) if kind == "html" else self.by_lines(lines, own, own_line)
        body = [i for i, x in enumerate(hit) if not x and not own_line[i]]
        return [lines[i].number for i, x in enumerate(hit) if x and not own_line[i]] if body else []

    def elements(self, lines: list[Line], shapes: list[tuple[str, ...]], own: str) -> list[tuple[list[int], float]]:
        """The lines of each element with its ratio less the threshold; in doubt the lines are asked as well."""
        out = []
        for at, over in self.paths.elements(lines, own):
            if abs(over) < DOUBT:
                over -= LINES * sum(self.odds(lines[i].text, shapes[i]) for i in at) / len(at)
            out.append((at, over))
        return out

    def by_paths(self, lines: list[Line], own: str) -> list[bool]:
        """Whether each line of an HTML page hangs in an element below the threshold."""
        hit = [False] * len(lines)
        for at, over in self.elements(lines, line_shapes(lines, own), own):
            for i in at:
                hit[i] = over < 0
        return hit

    def by_lines(self, lines: list[Line], own: str, own_line: list[bool]) -> list[bool]:
        """The same for plain text, which has no paths: by its lines alone."""
        odds = [self.odds(x.text, f) for x, f in zip(lines, line_shapes(lines, own))]
        for i, is_own in enumerate(own_line):
            if is_own:
                odds[i] = -6.0
            elif lines[i].text.count(" ") < FEW_WORDS:
                odds[i] *= FEW_COUNT
        return smooth(odds)


def smooth(odds: list[float]) -> list[bool]:
    """The likeliest run of body and furniture, when each change costs CHANGE."""
    back, a, b = [], -odds[0] / 2, odds[0] / 2
    for o in odds[1:]:
        stay_a, stay_b = a >= b - CHANGE, b >= a - CHANGE
        back.append((stay_a, stay_b))
        a, b = max(a, b - CHANGE) - o / 2, max(b, a - CHANGE) + o / 2
    state, out = b > a, []
    for stay_a, stay_b in reversed(back):
        out.append(state)
        state = (stay_b if state else not stay_a)
    out.append(state)
    return out[::-1]


def fit_lines(texts: DataFrame, most: int = SAMPLE) -> LineModel:
    """Sum the tag paths of all pages, and fit the classifier of lines to what they decide clearly on a sample.

    A sieve by hash lets through about `most` pages of up to LONGEST characters, whatever their
    number. Without HTML pages the classifier knows nothing and every line has even odds, which
    keeps plain texts whole.
    """
    paths = PathModel.of(path_sums(texts).toPandas())
    pages = texts.where("kind = 'html'").where(F.length("text") <= LONGEST).select("title", "text", F.xxhash64("title", "text").alias("h"))
    rate = min(1.0, most / max(1, pages.count()))
    sample = pages.where(F.pmod("h", F.lit(1_000_000)) < F.lit(round(rate * 1_000_000))).toPandas()
    known = []
    for title, text, _ in sample.sort_values(["h", "title", "text"]).itertuples(index=False, name=None):
        lines, own = lines_of(text, "html"), title_key(title)
        shapes = line_shapes(lines, own)
        known.append((lines, shapes, [slots_of([*text_features(x.text), *f]) for x, f in zip(lines, shapes)], own))

    def fitted(elements: list[list[tuple[list[int], float]]], clear: float) -> LineModel:
        items, labels = [], []
        for (_, shapes, features, _), parts in zip(known, elements):
            for at, over in parts:
                if abs(over) >= clear:
                    items += [features[i] for i in at]
                    labels += [int(over < 0 and "#headline" not in shapes[i]) for i in at]
        return LineModel(paths, fit(items if len(set(labels)) > 1 else [], labels, classes=2, passes=5, decay=1e-5))

    model = fitted([paths.elements(lines, own) for lines, _, _, own in known], DOUBT)
    for _ in range(ROUNDS):
        model = fitted([model.elements(lines, shapes, own) for lines, shapes, _, own in known], CLEAR)
    return model


def furniture_lines(texts: DataFrame, lines: LineModel, residue: ResidueModel, key: str = "grant_id") -> DataFrame:
    """(key, field, line_no): the furniture of every text that holds a main body too."""
    context = texts.sparkSession.sparkContext
    line_weights, residue_weights = context.broadcast((lines.paths.levels, lines.paths.mean, lines.classifier.weights)), context.broadcast(residue.classifier.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, mean, weights = line_weights.value
        model, other = LineModel(PathModel(levels, mean), Softmax(weights)), ResidueModel(Softmax(residue_weights.value))
        for b in batches:
            keys, fields, numbers = [], [], []
            for k, title, field, kind, text in b[["gm_key", "title", "field", "kind", "text"]].itertuples(index=False, name=None):
                hit = model.furniture(text, title, kind) if "\n" in text else []
                if hit and other.is_case(text, title, kind):
                    continue
                keys += [k] * len(hit)
                fields += [field] * len(hit)
                numbers += hit
            yield pd.DataFrame({"gm_key": pd.Series(keys, dtype=object), "field": pd.Series(fields, dtype=object), "line_no": np.array(numbers, dtype=np.int64)})

    rows = texts.select(F.col(key).alias("gm_key"), "title", "field", "kind", "text")
    kind = rows.schema["gm_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"gm_key {kind}, field string, line_no bigint").withColumnRenamed("gm_key", key)


def find_furniture(grants: DataFrame, key: str = "grant_id") -> DataFrame:
    """(key, field, line_no) of every line of furniture in descriptions and page texts.

    Lines are split at line feeds and counted from 1; blank lines and lines of tags alone give
    no row, nor do texts of one line, texts that residue.find_residue finds, and null texts.
    """
    texts = page_texts(grants, key)
    residue = fit_residue(texts)
    return furniture_lines(texts, fit_lines(texts), residue, key)


def main_body(text: str, numbers: list[int]) -> str:
    """A text without the lines of the given numbers."""
    drop = set(numbers)
    return "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in drop)
