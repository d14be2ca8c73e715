"""URL columns by regular expression (parse_url raises on what browsers accept)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base_url(url: Column) -> Column:
    """Without query and fragment, with scheme and host in lower case, no default port and at least the path /; another text up to #."""
    plain = F.regexp_replace(authority(url), "^.*@", "")
    port = F.regexp_extract(plain, ":([0-9]+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    shown = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(scheme(url), F.lit("://"), host(url), shown, F.when(path(url) == "", "/").otherwise(path(url)))
    return F.when(authority(url) != "", whole).otherwise(F.regexp_replace(url, "#.*$", ""))


def directory(url: Column) -> Column:
    """scheme://authority/ and the path up to its last slash."""
    folder = F.regexp_extract(path(url), "^(.*/)", 1)
    return F.concat(scheme(url), F.lit("://"), authority(url), F.when(folder == "", "/").otherwise(folder))


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..`` (also written ``%2e``): ``..`` takes the segment before it along, at the start nothing; as a last segment either leaves a slash."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last"), F.regexp_replace(F.lower(s), "%2e", ".").alias("k")))
    empty = F.array().cast("array<string>")

    def step(stack: Column, x: Column) -> Column:
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        kept = F.when(x["k"] == "..", shorter).otherwise(stack)
        dots = x["k"].isin(".", "..")
        return F.concat(kept, F.when(~dots, F.array(x["s"])).when(x["last"], F.array(F.lit(""))).otherwise(empty))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, empty, step), "/"))


def _plain(url: Column) -> Column:
    """A url with no dot segments in its path."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(.*)$", 1)
    front = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(path(url).rlike(r"(?i)/(\.|%2e)"), F.concat(front, without_dots(path(url)), rest)).otherwise(url)


def resolve(href: Column, page: Column) -> Column:
    """An absolute link without dot segments. Null for schemes other than http and https."""
    root = F.concat(scheme(page), F.lit("://"), authority(page))
    return _plain(
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(page), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(page, "[?#].*$", ""), href))
        .otherwise(F.concat(directory(page), href))
    )


def hrefs(html: Column) -> Column:
    """The values of double-quoted href attributes."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)href\s*=\s*"([^"]+)"'), 1)


def out_links(html: Column, page: Column, most: int = 500) -> Column:
    """The first distinct absolute links, without fragment parts removed."""
    return F.slice(F.array_distinct(F.array_compact(F.transform(hrefs(html), lambda h: resolve(h, page)))), 1, most)


def link_tokens(links: Column, most: int | None = 1000) -> Column:
    """Host, and host with the first segment of the path, of each link; distinct, in order."""

    def of(link: Column) -> Column:
        segment = F.lower(F.regexp_extract(path(link), "^/+([^/]+)", 1))
        return F.when(host(link) == "", F.array().cast("array<string>")).otherwise(F.when(segment == "", F.array(host(link))).otherwise(F.array(host(link), F.concat_ws("/", host(link), segment))))

    found = F.array_distinct(F.flatten(F.transform(links, of)))
    return found if most is None else F.slice(found, 1, most)


def html_link_tokens(html: Column) -> Column:
    """Link tokens of a fragment; relative links count for example.org."""
    return link_tokens(F.array_compact(F.transform(hrefs(html), lambda h: resolve(h, F.lit("https://example.org/")))), None)


def site_hierarchy(url: Column) -> Column:
    """The host and the segments of the path."""
    return F.concat(F.array(host(url)), F.filter(F.split(path(url), "/"), lambda s: s != ""))
