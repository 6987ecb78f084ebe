"""URL functions and crawl filters as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that are never crawled (fixed values).
BLOCKED_HOSTS = (
    "google.com", "www.google.com", "bing.com", "duckduckgo.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "tiktok.com", "linkedin.com", "donate.wikimedia.org", "foundation.wikimedia.org", "www.wikidata.org", "www.mediawiki.org",
    "stats.wikimedia.org", "commons.wikimedia.org", "scholar.google.com", "web.archive.org", "archive.org", "addtoany.com",
)
#: Encyclopaedia namespaces that are never crawled (fixed values).
BLOCKED_NAMESPACES = (
    "Talk", "User", "Wikipedia", "File", "MediaWiki", "Template", "Help", "Category", "Portal", "Special", "Main_Page",
    "Entity_Page", "Book", "Draft", "TimedText", "Module",
)
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def hostname(url: Column) -> Column:
    """Host in lower case, without user and port; null where there is none."""
    host = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")
    return F.nullif(F.lower(host), F.lit(""))


def normalized(url: Column) -> Column:
    """Lower scheme and host, no default port, no last slash, no query and fragment; null if there is no scheme."""
    s, a = scheme(url), authority(url)
    user, host = F.regexp_extract(a, "^(.*@)?(.*)$", 1), F.lower(F.regexp_extract(a, "^(.*@)?(.*)$", 2))
    host = F.when(s == "http", F.regexp_replace(host, ":80$", "")).when(s == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(s != "", F.concat(s, F.lit("://"), user, host, F.regexp_replace(path(url), "/$", "")))


def crawlable(url: Column) -> Column:
    """http(s), not a blocked host, and of the encyclopaedia only English articles of the main namespace."""
    host = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")
    title = F.regexp_replace(path(url), "^/wiki/", "")
    space = F.substring_index(title, ":", 1)
    article = F.startswith(F.concat(host, path(url)), F.lit("en.wikipedia.org/wiki/")) & ~space.isin(*BLOCKED_NAMESPACES)
    return scheme(url).isin("http", "https") & ~host.isin(*BLOCKED_HOSTS) & (~F.contains(host, F.lit("wikipedia")) | article)


def display_domain(url: Column) -> Column:
    """Host without a leading www., the URL itself if it has none."""
    return F.coalesce(F.regexp_replace(hostname(url), r"^www\.", ""), url)


def display_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), display_domain(url))
