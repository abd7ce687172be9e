"""Addresses: parts, safety, canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sections that are no program page by themselves (fixed values).
GENERIC = (
    "about", "contact", "home", "index", "main", "welcome", "business", "programs", "grants", "funding", "resources",
    "services", "help", "support", "faq", "blog", "news", "partners", "sponsors", "donate", "join", "membership",
)
#: Hosts that answer about the machine itself (fixed values).
BLOCKED_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200")
LONGEST = 2048
_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, name: str) -> Column:
    """scheme, host, port, path or query of an http address; null if it is none."""
    at = {"scheme": 1, "host": 2, "port": 3, "path": 4, "query": 5}[name]
    got = F.regexp_extract(F.trim(url), _URL, at)
    if name in ("scheme", "host"):
        got = F.lower(got)
    return F.when(F.trim(url).rlike(_URL), got)


def canonical(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def path_segments(url: Column) -> Column:
    """The segments of the path that are not empty."""
    return F.filter(F.split(part(url, "path"), "/"), lambda s: s != "")


def is_generic_home(url: Column, sections: tuple[str, ...] = GENERIC) -> Column:
    """A root path, or one generic section alone; false for what is no address."""
    s = path_segments(url)
    return F.coalesce((F.size(s) == 0) | ((F.size(s) == 1) & F.lower(F.try_element_at(s, F.lit(1))).isin(*sections)), F.lit(False))


def sanitized(url: Column) -> Column:
    """An http address with its scheme and host in lower case and a path; null for anything else."""
    rest = F.regexp_extract(F.trim(url), r"^(?i)https?://[^/?#]*(.*)$", 1)
    port = F.coalesce(F.concat(F.lit(":"), F.nullif(part(url, "port"), F.lit(""))), F.lit(""))
    return F.when(part(url, "host").isNotNull(), F.concat(part(url, "scheme"), F.lit("://"), part(url, "host"), port, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def is_private_host(host: Column) -> Column:
    """Private, loopback and link-local addresses, IPv4 and IPv6, mapped ones included."""
    inner = F.regexp_replace(host, r"^\[|\]$", "")
    v4 = F.regexp_replace(inner, r"(?i)^::ffff:", "")
    private4 = v4.rlike(r"^(10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^0\.0\.0\.0$")
    # ::ffff:7f00:1 is 127.0.0.1 in hexadecimal
    high = F.conv(F.regexp_extract(inner, r"(?i)^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$", 1), 16, 10).cast("int")
    first, second = F.floor(high / 256), high % 256
    mapped = (first.isin(10, 127)) | ((first == 192) & (second == 168)) | ((first == 169) & (second == 254)) | ((first == 172) & second.between(16, 31))
    return host.isin(*BLOCKED_HOSTS) | private4 | inner.rlike(r"(?i)^::1$|^fe80:|^f[cd][0-9a-f]{2}:") | F.coalesce(mapped, F.lit(False))


def is_safe(url: Column) -> Column:
    """An http address of a public host."""
    host = part(url, "host")
    return F.coalesce(host.isNotNull() & ~is_private_host(host), F.lit(False))


def refusal(url: Column) -> Column:
    """Why an address is not accepted: empty, too_long, malformed, invalid_protocol or blocked_host; null if it is."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return (
        F.when(u == "", "empty")
        .when(F.length(u) > LONGEST, "too_long")
        .when(~u.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), "malformed")
        .when(~u.rlike(r"^(?i)https?:"), "invalid_protocol")
        .when(part(u, "host").isNull(), "malformed")
        .when(is_private_host(part(u, "host")), "blocked_host")
    )
