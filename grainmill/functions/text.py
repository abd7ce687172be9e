"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest description kept, where it is cut, and what then ends it (fixed values).
LONGEST, CUT_AT, CUT_MARK = 5000, 4985, "… [truncated]"


def normal_title(title: Column) -> Column:
    """Lower case, letters a-z, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+", " "))


def alnum_key(title: Column) -> Column:
    """Lower case letters a-z and digits only."""
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]", "")


def shortened(text: Column) -> Column:
    """Texts beyond the longest are cut, trimmed at the right and marked."""
    return F.when(F.length(text) > LONGEST, F.concat(F.regexp_replace(F.substring(text, 1, CUT_AT), r"\s+$", ""), F.lit(CUT_MARK))).otherwise(text)


def elided(text: Column, most: int = 120) -> Column:
    """At most `most` characters, the last three dots if something is left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def redacted(text: Column) -> Column:
    """Social security numbers that no digit touches are blanked out."""
    return F.regexp_replace(text, r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "[REDACTED-SSN]")


#: What changes on a page without its content changing: dates, time stamps, form tokens (fixed patterns).
VOLATILE = (r"\d{1,2}/\d{1,2}/\d{4}", r"\d{10,13}", r"""(?i)csrf[^"']*["'][^"']*["']""")
#: Words that begin another field, so that a label's own value is missing (fixed values).
OTHER_FIELDS = ("amount", "deadline", "eligibility", "apply", "award", "who can")
#: Longest body of a mail link, and what then ends it (fixed values).
MAIL_BODY, MAIL_MARK = 1800, "\n\n…(truncated — see attached export for full list)"


def content_hash(text: Column) -> Column:
    """sha256 of a text without what is volatile and with single spaces, so that only real changes show."""
    for pattern in VOLATILE:
        text = F.regexp_replace(text, pattern, "")
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def labeled_field(text: Column, labels: list[str]) -> Column:
    """What follows the first of the labels that begins a line and has a value of its own, up to the line's end; null if none does."""
    hits = []
    for name in labels:
        got = F.trim(F.regexp_extract(text, rf"(?im)(?:^|\n)\s*{name}[.:\s]+([^\n]{{3,150}})", 1))
        hits.append(F.when((got != "") & ~got.rlike(rf"(?i)^(?:{'|'.join(OTHER_FIELDS)})"), got))
    return F.coalesce(*hits)


def unnumbered(title: Column) -> Column:
    """A title without the number of a list before it."""
    return F.trim(F.regexp_replace(title, r"^\d+\.\s*", ""))


def mail_link(subject: Column, body: Column) -> Column:
    """An address that opens a mail with a subject and a body, long bodies cut and marked; percent-encoded as RFC 3986 has it."""

    def encoded(c: Column) -> Column:
        c = F.url_encode(c)
        for plain, code in (("%20", "\\+"), ("%2A", "\\*"), ("~", "%7E")):
            c = F.regexp_replace(c, code, plain)
        return c

    short = F.when(F.length(body) > MAIL_BODY, F.concat(F.substring(body, 1, MAIL_BODY), F.lit(MAIL_MARK))).otherwise(body)
    return F.concat(F.lit("mailto:?subject="), encoded(subject), F.lit("&body="), encoded(short))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether a text holds any of the phrases; one alternation, however many there are."""
    return F.lower(text).rlike("|".join(quoted(p.lower()) for p in phrases))


def quoted(phrase: str) -> str:
    """A phrase as a literal in a pattern."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


def pretty(value: Column) -> Column:
    """An enumerated value in words: underscores as spaces, capitals at word starts."""
    return F.initcap(F.lower(F.replace(value, F.lit("_"), F.lit(" "))))


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value; unknown values stay."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(known, value), value)


def csv_field(value: Column) -> Column:
    """A field quoted as RFC 4180 wants it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def amount_chip(low: Column, high: Column) -> Column:
    """A range of sums in short: "$10k+", "up to $25k", "$10k–$50k"."""

    def short(x: Column) -> Column:
        number = lambda v: F.regexp_replace(F.format_string("%.1f", v.cast("double")), r"\.0$", "")
        return F.when(x >= 1_000_000, F.concat(F.lit("$"), number(x / 1_000_000), F.lit("M"))).when(x >= 1000, F.concat(F.lit("$"), F.format_string("%.0f", (x / 1000).cast("double")), F.lit("k"))).otherwise(F.concat(F.lit("$"), x.cast("string")))

    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(short(low), F.lit("–"), short(high)))
        .when(low.isNotNull(), F.concat(short(low), F.lit("+")))
        .when(high.isNotNull(), F.concat(F.lit("up to "), short(high)))
    )


def json_object(text: Column, schema: str) -> Column:
    """A model's reply without its code fences, parsed; null if it is no such object."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema)
