"""Ordered exclusion rules with a recorded reason, and tags by phrases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import any_phrase


@dataclass(frozen=True)
class Rule:
    """A reason, the phrases that bring it about, and phrases that veto it."""

    reason: str
    phrases: tuple[str, ...]
    unless: tuple[str, ...] = ()


def reason_of(text: Column, rules: list[Rule]) -> Column:
    """The reason of the first rule that fits, null if none does; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = any_phrase(text, list(rule.phrases))
        if rule.unless:
            hit = hit & ~any_phrase(text, list(rule.unless))
        out = F.when(hit, F.lit(rule.reason)).otherwise(out)
    return out


def reason_counts(rows: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """(reason, n) of the rows that a rule drops."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def tags_of(text: Column, tags: dict[str, tuple[str, ...]], word_boundary: bool = False) -> Column:
    """The tags, in the order given, of which a phrase occurs in the text."""
    text = F.coalesce(text, F.lit(""))
    edge = (lambda p: rf"(?i)\b(?:{p})\b") if word_boundary else (lambda p: f"(?i)(?:{p})")
    from grainmill.functions.text import quoted

    found = [F.when(text.rlike(edge("|".join(quoted(p.lower()) for p in phrases))), F.lit(tag)) for tag, phrases in tags.items()]
    return F.array_compact(F.array(*found))


def first_tag(text: Column, tags: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first tag of which a phrase occurs, else the default."""
    out = F.lit(default)
    for tag, phrases in reversed(tags.items()):
        out = F.when(any_phrase(F.coalesce(text, F.lit("")), list(phrases)), F.lit(tag)).otherwise(out)
    return out
