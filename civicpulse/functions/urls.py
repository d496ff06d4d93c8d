"""Functions that read and build urls."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import REVIEW_URL

# The parts of a property page's url.
PROPERTY_URL = (
    r"^http://www\.tripadvisor\.com/([A-Za-z]+_Review)-([a-z][0-9]+-[a-z][0-9]+)-.+\.html")
# Fixed value: the click target of a search result.
CLICK_TARGET = r"(http://www.tripadvisor.com)/[^/]+(/[^.]+\.html).+"
EXPANDED_REVIEWS = "/ExpandedUserReviews-"


def search_url(city: Column, base: str = REVIEW_URL) -> Column:
    return F.concat(F.lit(base + "/Search?q="), F.replace(city, F.lit(" "), F.lit("+")))


def is_search_url(url: Column, base: str = REVIEW_URL) -> Column:
    return url.rlike("^" + re.escape(base) + r"/Search\?q=[\p{L}\p{N}_]")


def search_city(url: Column, base: str = REVIEW_URL, strict: bool = False) -> Column:
    """The city of a search url, or null.  ``strict`` stops at the first ``+``."""
    if strict:
        city = F.regexp_extract(url, "^" + re.escape(base) + r"/Search\?q=([\p{L}\p{N}_]+)", 1)
        return F.nullif(city, F.lit(""))
    query = F.regexp_extract(url, r"[?&]q=([^&#]*)", 1)
    return F.when(is_search_url(url, base), F.replace(query, F.lit("+"), F.lit(" ")))


def rewrite_click_target(value: Column) -> Column:
    return F.regexp_replace(value, CLICK_TARGET, "$1$2")


def review_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("review_([0-9]+)"), F.lit(1))


def detail_url(url: Column, ids: Column) -> Column:
    """Url of the expanded reviews of a property page; null without ids or match."""
    kind = F.regexp_extract(url, PROPERTY_URL, 1)
    place = F.regexp_extract(url, PROPERTY_URL, 2)
    built = F.concat(
        F.lit(REVIEW_URL + EXPANDED_REVIEWS), place,
        F.lit("?target="), F.get(ids, F.lit(0)),
        F.lit("&context=1&reviews="), F.array_join(ids, ","),
        F.lit("&servlet="), place, kind, F.lit("&expand=1"))
    return F.when((F.size(ids) > 0) & url.rlike(PROPERTY_URL), built)


def in_domain(url: Column, domain: str) -> Column:
    """True for the domain itself and its subdomains."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (host == domain.lower()) | F.endswith(host, F.lit("." + domain.lower()))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")
