"""Addresses of pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that do not make another page.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid mc_cid mc_eid mkt_tok icid ref ref_ cmpid clid".split()
# Path parts, and words of the query part, of pages that hold no article.
BOILERPLATE = "about account advert advertisement advertising careers company contact cookies copyright faq feedback finance help home investors legal login logout menu newsletter privacy register settings signin signout signup subscribe support terms".split()
# Parts of the domains of pages anyone can put up.
LOW_CONFIDENCE = ["blogspot.", "wordpress", "medium.com", "substack.com", "tumblr.com", "reddit.com", "weebly.com", "notion.site", "github.io"]


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")


def host(url: Column) -> Column:
    """Lower-cased host with its port; '' for null and blank."""
    return F.lower(F.regexp_extract(_rest(url), r"^([^/?]*)", 1))


def domain(url: Column) -> Column:
    """Host without port and leading www., www2. and so on."""
    return F.regexp_replace(F.regexp_replace(host(url), r":\d+$", ""), r"^www\d*\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?]*([^?]*)", 1)


def _parameter(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def canonical(url: Column, declared: Column | None = None) -> Column:
    """The page's own canonical address, or else its address, in one form; null if both are null or blank.

    Scheme and host are lower-cased, the port is kept, the path is at least a
    slash and otherwise ends in none, the fragment and tracking parameters are
    dropped, parameters are sorted by name, the last of one name counting. An
    address without scheme or host is only trimmed.
    """
    plain = F.trim(F.coalesce(url, F.lit("")))
    if declared is not None:
        plain = F.when(F.trim(F.coalesce(declared, F.lit(""))) != "", F.trim(declared)).otherwise(plain)
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    query = F.filter(F.split(F.regexp_extract(_rest(plain), r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(_parameter(p)).isin(TRACKING))
    last = F.filter(query, lambda p, i: ~F.exists(F.slice(query, i + 2, F.size(query)), lambda q: _parameter(q) == _parameter(p)))
    kept = F.transform(F.array_sort(F.transform(last, lambda p: F.struct(_parameter(p).alias("k"), p.alias("p")))), lambda s: s["p"])
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    at = F.regexp_replace(path(plain), "/+$", "")
    whole = F.concat(scheme, F.lit("://"), host(plain), F.when(at == "", "/").otherwise(at), tail)
    return F.when(plain != "", F.when((scheme == "") | (host(plain) == ""), plain).otherwise(whole))


def seed(target: Column) -> Column:
    """The target as an https address unless it names http or https; null unless it has a host with a dot."""
    plain = F.trim(F.coalesce(target, F.lit("")))
    full = F.when(F.lower(plain).rlike("^https?://"), plain).otherwise(F.concat(F.lit("https://"), F.regexp_replace(plain, "^//", "")))
    return F.when(domain(full).rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), full)


def useful(url: Column) -> Column:
    """Whether no part of the path is boilerplate, and no such word stands in the query part."""
    parts = F.transform(F.split(F.lower(path(url)), "/"), lambda x: F.trim(x))
    query = F.lower(F.regexp_extract(_rest(url), r"^[^?]*\?(.*)$", 1))
    return ~F.arrays_overlap(parts, F.array(*[F.lit(b) for b in BOILERPLATE])) & ~query.rlike("|".join(BOILERPLATE))


def low_confidence(name: Column) -> Column:
    """Whether a domain is one of pages that anyone can put up; false for null and empty."""
    plain = F.lower(F.coalesce(name, F.lit("")))
    found = F.lit(False)
    for part in LOW_CONFIDENCE:
        found = found | plain.contains(part)
    return found


def readable_domain(name: Column) -> Column:
    """The first three labels, each with a capital."""
    return F.array_join(F.transform(F.slice(F.split(name, r"\."), 1, 3), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), " ")
