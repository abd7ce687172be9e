"""Texts cut off by field limits or in transfer.

Per source, the lengths of distinct texts in characters and bytes are tested for spikes; a text at a spike without
terminal punctuation is cut. Elsewhere, and where a text at a spike does end in punctuation,
the end itself is tested against all distinct texts: how often the last words stand as a whole line or
sentence, how often they go on, and whether the last word is ever used as one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.linear import NAMES, Softmax
from grainmill.llm.pages import page_texts, title_key
from grainmill.llm.residue import ResidueModel, fit_residue
from grainmill.operators.skew import join_dictionary
from grainmill.runtime import broadcast_if_few, stage

#: A length counts as a spike if it is this much likelier than the lengths around it, with so many texts and such a share of its source at least.
SPIKE, SPIKE_TEXTS, SPIKE_SHARE, AROUND, SHORTEST = 5.0, 4, 0.003, 30, 120
#: A further spike of a source is believed from here on: the logarithm of the odds against one by chance among all lengths of the source.
NO_CHANCE = 4.6
#: An open end counts as whole if it is at least this share of the segments that go on from it, and occurs so often.
WHOLE_SHARE, WHOLE_TIMES = 0.015, 3
#: A sentence that ends fewer than this share of its paragraphs does not end a text at a spike.
LAST_SHARE = 0.03

MARK = re.compile(r"\s*(?:\ufffd+|(?:%[0-9A-Fa-f]{2})+%?[0-9A-Fa-f]?|&#?\w{0,6}|</?[a-z][^<>]{0,40}|&hellip;|&#8230;|\[(?:\.\.\.|…|truncated|more|cut)\]|\((?:more|truncated|cont(?:inued|\.)?|\.\.\.|…)\)|(?:\.\.\.|…)\s*(?:\[truncated\]|\(truncated\)|\[more\]|\(more\)|read more|more)?|read more)\s*$", re.I)
_SURE_MARK = re.compile(r"\ufffd$|%[0-9A-Fa-f]{1,2}$|&#?\w{0,6}$|</?[a-z][^<>]*$|\[[^\]]*\]\s*$|\([^)]*\)\s*$|more\s*$", re.I)
_ENDED = re.compile(r"[.!?:;。！？]['\"”’)\]»]*\s*$")
_SEGMENT = re.compile(r"(?<=[.!?])['\"”’)]*\s+|\n+")
_TAIL = re.compile(r"[.!?;:,…]+['\"”’)]*$")
_ONE_NAME = re.compile(r"(?<=[\w,] )[A-ZÀ-Þ][\w'’-]+")
_WORD = re.compile(r"[^\W\d_]+")
_NINES = str.maketrans("0123456789", "9" * 10)


def skeleton(segment: str) -> str:
    """A sentence or line with names as one word, digits as 9, in lower case and without its final sign."""
    return _short_skeleton(segment) if len(segment) < 400 else _skeleton(segment)


def _skeleton(segment: str) -> str:
    s = _TAIL.sub("", segment.strip())
    s = NAMES.sub("Nn", s)
    s = _ONE_NAME.sub("Nn", s)
    s = " ".join(s.split())
    return (s.translate(_NINES) if s.isascii() else re.sub(r"\d", "9", s)).lower()


_short_skeleton = lru_cache(maxsize=100_000)(_skeleton)


def segments(text: str) -> list[tuple[str, bool]]:
    """The sentences and lines of a text, each with whether it ends its line."""
    out = []
    for line in text.split("\n"):
        parts = [p for p in re.split(r"(?<=[.!?])\s+", line.strip()) if p]
        out += [(p, i == len(parts) - 1) for i, p in enumerate(parts)]
    return out


def last_segment(text: str) -> str:
    """What follows the last sentence end or line break."""
    line = text.rstrip()
    line = line[line.rfind("\n") + 1 :].strip()
    return next((p for p in reversed(re.split(r"(?<=[.!?])\s+", line)) if p), "")


def descriptions(grants: DataFrame, raw_grants: DataFrame) -> DataFrame:
    """(record_table, record_id, source_name, title, text) of all descriptions that are not null."""
    a = grants.select(F.lit("grants").alias("record_table"), F.col("grant_id").cast("string").alias("record_id"), "source_name", F.coalesce("title", F.lit("")).alias("title"), F.col("description").alias("text"))
    b = raw_grants.select(F.lit("raw_grants").alias("record_table"), F.col("raw_id").cast("string").alias("record_id"), "source_name", F.coalesce("title", F.lit("")).alias("title"), F.col("description").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull())


def _spikes(lengths: DataFrame) -> DataFrame:
    """Lengths that stand out of those around them, with `chance`: how far from chance, as a logarithm."""
    source = ["record_table", "source_name", "unit"]
    histogram = lengths.groupBy(*source, "length").agg(F.sum("n").alias("n")).where(F.col("length") >= SHORTEST)
    window = Window.partitionBy(*source)
    rest = (F.sum("n").over(window.orderBy("length").rangeBetween(-AROUND, AROUND)) - F.col("n")) / (2.0 * AROUND)
    rows = histogram.withColumns({"rest": rest, "all": F.sum("n").over(window), "lengths": F.count("*").over(window)})
    rows = rows.where((F.col("n") >= SPIKE_TEXTS) & (F.col("n") >= SPIKE_SHARE * F.col("all")) & (F.col("n") >= SPIKE * F.greatest("rest", F.lit(0.2))))
    usual = F.greatest("rest", F.lit(0.5 / AROUND))
    chance = F.col("n") * F.log(F.col("n") / usual) - F.col("n") + usual - F.log("lengths")
    return rows.select(*source, "length", "n", chance.alias("chance"))


def length_spikes(texts: DataFrame) -> DataFrame:
    """(record_table, source_name, unit, length, n): lengths at which the distinct texts of a source pile up.

    `unit` is "chars" or "bytes". The histogram has one row per source and length; a length is
    a spike if it holds SPIKE times the mean of the lengths within AROUND of it. The highest of a
    source and unit counts, and so does every other one that chance doesn't explain (bound of a
    Poisson tail, times the lengths tested). A length at which texts stand only because they fill
    a limit in the other unit is none.
    """
    key = ["record_table", "source_name"]
    distinct = texts.select(*key, F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).distinct()
    pairs = stage(distinct.groupBy(*key, "chars", "bytes").agg(F.count("*").alias("n")), "lengths")
    both = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length"), F.lit(v).alias("other_unit"), F.col(v).alias("other")) for u, v in (("chars", "bytes"), ("bytes", "chars"))])
    lengths = pairs.select(*key, F.explode(both).alias("x"), "n").select(*key, "x.*", "n")
    named = lambda spikes, name: spikes.select(*key, F.col("unit").alias("other_unit"), F.col("length").alias("other"), F.col("n").alias(name))
    top = stage(_spikes(lengths).groupBy(*key, "unit").agg(F.max_by("length", F.struct("n", "length")).alias("length"), F.max("n").alias("n")), "top-spikes")
    # what the highest ones explain is left out, so that they hide no other one near them
    rest = lengths.join(broadcast_if_few(top.drop("n")), [*key, "unit", "length"], "left_anti").join(broadcast_if_few(named(top, "by_n")), [*key, "other_unit", "other"], "left_anti")
    more = stage(_spikes(rest).where(F.col("chance") >= NO_CHANCE), "more-spikes")
    own, by = more.select(*key, "unit", "length", F.col("n").alias("own_n")), named(more, "by_n")
    seen = rest.join(broadcast_if_few(own), [*key, "unit", "length"], "left").join(broadcast_if_few(by), [*key, "other_unit", "other"], "left")
    echo = (F.col("other") != F.col("length")) & (F.coalesce("by_n", F.lit(0)) > F.coalesce("own_n", F.lit(0)))
    more = _spikes(seen.where(~echo)).where(F.col("chance") >= NO_CHANCE).select(*key, "unit", "length", "n")
    return top.select(*key, "unit", "length", "n").unionByName(more)


def ending_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skeleton, whole, last, open): how often a segment is whole, ends its line, or ends a text without punctuation;
    and (word, uses): how often each word stands in a text, its last one left out.

    Counted in Python per batch, in one pass, and summed over the distinct texts, so copies of a
    text don't vouch for its end. An unended last segment counts as open, not as whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, closing, final = Counter(), Counter(), Counter()
            for text in b.text:
                got = segments(text)
                if got:
                    end, _ = got.pop()
                    closing[end] += 1
                    if not _WORD.search(end):  # the last word stands further up
                        final.update(next((w[-1:] for s, _ in reversed(got) if (w := _WORD.findall(s))), ()))
                    seen.update(got)
            # skeletons are made, and words found, once per distinct segment
            rows: dict[str, list[int]] = {}
            uses: dict[str, int] = {}
            for (s, ends), n in seen.items():
                rows.setdefault(skeleton(s), [0, 0, 0])[1 if ends else 0] += n
                for w in _WORD.findall(s):
                    uses[w] = uses.get(w, 0) + n
            for s, n in closing.items():
                if not _ENDED.search(s):
                    rows.setdefault(skeleton(s), [0, 0, 0])[2] += n
                elif MARK.search(s):
                    rows.setdefault(skeleton(MARK.sub("", s)), [0, 0, 0])[2] += n
                else:
                    rows.setdefault(skeleton(s), [0, 0, 0])[1] += n
                for w in _WORD.findall(s)[:-1]:
                    uses[w] = uses.get(w, 0) + n
            for w, n in final.items():
                uses[w] -= n
            uses = {w: n for w, n in uses.items() if n}
            yield pd.DataFrame({"is_word": False, "key": list(rows), "whole": [a + z for a, z, _ in rows.values()], "last": [z for _, z, _ in rows.values()], "open": [o for _, _, o in rows.values()]})
            yield pd.DataFrame({"is_word": True, "key": list(uses), "whole": list(uses.values()), "last": 0, "open": 0})

    counted = texts.select("text").distinct().mapInPandas(run, "is_word boolean, key string, whole bigint, last bigint, open bigint")
    counted = stage(counted.groupBy("is_word", "key").agg(F.sum("whole").alias("whole"), F.sum("last").alias("last"), F.sum("open").alias("open")), "ending-counts")
    ends = counted.where("not is_word").select(F.col("key").alias("skeleton"), "whole", "last", "open")
    return ends, counted.where("is_word").select(F.col("key").alias("word"), F.col("whole").alias("uses"))


#: Distinct segments per range of the sorted ones.
RANGE_ROWS = 100_000
#: Sorts after every text that begins with what stands before it.
_BEHIND = "\U0010ffff"


def continuations(counts: DataFrame) -> DataFrame:
    """(skeleton, goes_on): how often the letters of an open end are followed by more, over all segments.

    The segments that go on from an end are those between the end itself and the last text that
    begins with it, in sorted order; two marks per end and a running count over the sorted
    distinct segments tell how many there are. Ranges of the order are counted apart and
    offset, so no task holds more than a range, and a segment of any length is one row.
    """
    n = (F.col("whole") + F.col("open")).alias("n")
    rows = counts.select("skeleton", F.col("skeleton").alias("at"), F.lit(0).alias("mark"), n)
    ends = counts.where("open > 0 and skeleton <> ''").select("skeleton", F.explode(F.array(F.struct(F.col("skeleton").alias("at"), F.lit(1).alias("mark")), F.struct(F.concat("skeleton", F.lit(_BEHIND)).alias("at"), F.lit(2).alias("mark")))).alias("x"))
    rows = rows.unionByName(ends.select("skeleton", "x.at", "x.mark", F.lit(0).cast("bigint").alias("n")))
    ranges = max(1, counts.count() // RANGE_ROWS)
    rows = stage(rows.repartitionByRange(ranges, "at").withColumn("part", F.spark_partition_id()), "sorted-segments")
    before = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = before.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))  # a row per range
    running = F.sum("n").over(Window.partitionBy("part").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marks = rows.withColumn("upto", running).where("mark > 0").join(broadcast_if_few(before), "part")
    upto = F.col("upto") + F.col("offset")
    return marks.groupBy("skeleton").agg((F.max(F.when(F.col("mark") == 2, upto)) - F.max(F.when(F.col("mark") == 1, upto))).alias("goes_on"))


def _ends(texts: DataFrame) -> DataFrame:
    """How each text that is not blank ends: mark, punctuation, skeleton and last word."""
    columns = ["record_table", "record_id", "source_name", "chars", "bytes", "mark", "ended", "skeleton", "word", "is_title"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for table, record, source, title, text in b.itertuples(index=False, name=None):
                plain = text.rstrip()
                if not plain:
                    continue
                found = MARK.search(plain, max(0, len(plain) - 80))
                mark = 0 if not found else 2 if _SURE_MARK.search(found[0]) else 1
                kept = plain[: found.start()].rstrip() if found else plain
                tail = last_segment(kept)
                words = _WORD.findall(tail)
                glued = bool(words) and tail.endswith(words[-1])
                own = title_key(title)
                out.append((table, record, source, len(text), len(text.encode("utf-8", "surrogatepass")), mark, bool(_ENDED.search(tail)), skeleton(tail), words[-1] if glued else "", bool(own) and title_key(tail) == own))
            yield pd.DataFrame(out, columns=columns)

    return texts.select("record_table", "record_id", "source_name", "title", "text").mapInPandas(run, "record_table string, record_id string, source_name string, chars bigint, bytes bigint, mark int, ended boolean, skeleton string, word string, is_title boolean")


def _residue_among(texts: DataFrame, keys: DataFrame, residue: ResidueModel) -> DataFrame:
    """Those of the keys (record_table, record_id) whose text is a case of residue."""
    weights = texts.sparkSession.sparkContext.broadcast(residue.classifier.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ResidueModel(Softmax(weights.value))
        for b in batches:
            hit = [model.is_case(t, title, "text") for t, title in zip(b.text, b.title)]
            yield b.loc[hit, ["record_table", "record_id"]].astype(object)

    rows = texts.join(keys, ["record_table", "record_id"], "left_semi").select("record_table", "record_id", "title", "text")
    return rows.mapInPandas(run, "record_table string, record_id string").distinct()


def cut_descriptions(texts: DataFrame, residue: ResidueModel) -> DataFrame:
    """All texts that are not blank with `cut`, whether they stop before they end, and `reason`: what told it.

    "spike": at a length where the texts of the source pile up, without terminal punctuation, or
    with a sentence that hardly ever ends a paragraph, or with a mark of the cutting. "mark":
    such a mark stands at the end at any other length. "ending": the last words go on elsewhere and don't stand alone, or the last word is
    torn; transfers that broke off leave no spike. Null where the text is whole.

    Cases of residue are not cut; only texts that would be are asked. Rows of a source that is
    null count as one source of their own.
    """
    texts = texts.withColumn("source_name", F.coalesce("source_name", F.lit("")))
    spikes = stage(length_spikes(texts), "spikes")
    counts, words = ending_counts(texts)
    more = stage(continuations(counts), "continuations")
    ends = stage(_ends(texts), "ends")
    for unit in ("chars", "bytes"):
        at = spikes.where(F.col("unit") == unit).select("record_table", "source_name", F.col("length").cast("bigint").alias(unit), F.lit(True).alias(f"at_{unit}"))
        ends = ends.join(broadcast_if_few(at), ["record_table", "source_name", unit], "left")
    ends = ends.withColumn("spike", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))
    used = ends.groupBy("skeleton").agg(F.count("*").alias("gm_n"))
    known = used.join(counts, "skeleton", "left").join(more, "skeleton", "left").fillna(0, ["whole", "last", "open", "goes_on"])
    ends = join_dictionary(ends, stage(known, "known-ends"), ["skeleton"], "gm_n")
    last_words = ends.groupBy("word").agg(F.count("*").alias("gm_n"))
    uses = stage(last_words.join(words, "word", "left").fillna(0, ["uses"]), "last-words")
    ends = join_dictionary(ends, uses, ["word"], "gm_n")
    often = F.greatest(F.col("whole"), F.when(F.col("open") >= WHOLE_TIMES, F.col("open")).otherwise(0))
    whole = F.col("is_title") | ((often >= 2) & (often >= WHOLE_SHARE * F.col("goes_on")))
    # words before a bare ellipsis stand alone only if they seldom go on
    alone = F.col("is_title") | ((often >= 2) & (often >= F.col("goes_on")))
    # a word that only ends texts is a closing ("Watch this space ...") only where its letters never go on
    closing = (F.col("open") >= WHOLE_TIMES) & (F.col("goes_on") < 1)
    torn = (F.col("word") != "") & (F.col("uses") < 1) & ~F.col("is_title") & ~closing
    # spikes first: there the lack of terminal punctuation decides; what the histograms can't see comes after
    marked = F.when(F.col("spike"), F.lit("spike")).otherwise(F.lit("mark"))
    reason = (
        F.when(F.col("spike") & ~F.col("ended") & ~F.col("is_title") & (F.col("mark") == 0), F.lit("spike"))
        .when(F.col("spike") & F.col("ended") & (F.col("mark") == 0), F.when((F.col("whole") >= 20) & (F.col("last") < LAST_SHARE * F.col("whole")), F.lit("spike")))
        .when(F.col("mark") == 2, marked)
        .when(F.col("mark") == 1, F.when(~alone | F.col("ended") | torn, marked))
        .when(~F.col("ended") & ~F.col("is_title"), F.when(~whole | torn, F.lit("ending")))
    )
    found = stage(ends.withColumn("reason", reason), "found")
    void = _residue_among(texts, found.where("reason is not null").select("record_table", "record_id"), residue).withColumn("gm_void", F.lit(True))
    found = found.join(void, ["record_table", "record_id"], "left")
    found = found.withColumn("reason", F.when(F.col("gm_void").isNull(), F.col("reason"))).drop("gm_void")
    return found.withColumn("cut", F.col("reason").isNotNull())


def find_cut(grants: DataFrame, raw_grants: DataFrame) -> DataFrame:
    """Every description with whether it was cut.

    Null and blank descriptions are neither. A mark such as "[...]" is proof; a bare ellipsis
    only after words that don't stand alone.
    """
    texts = stage(descriptions(grants, raw_grants), "descriptions")
    # the model of p1_found and p4_found, so no description is a case of problem 1 and cut as well
    residue = fit_residue(page_texts(grants))
    return cut_descriptions(texts, residue)


def cut_reasons(found: DataFrame) -> DataFrame:
    """Per table and reason how many descriptions are cut."""
    return found.where("cut").groupBy("record_table", "reason").agg(F.count("*").alias("cut"))


def cut_rates(found: DataFrame) -> DataFrame:
    """Per source the number of descriptions that say something, those cut and their share."""
    return found.groupBy("source_name").agg(F.count("*").alias("descriptions"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("share"))
