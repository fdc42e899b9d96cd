"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never choose content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "_ga")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^[^?#]*\?([^#]*)", 1)


def canonical_url(c: Column | str) -> Column:
    """Without fragment and tracking parameters, parameters sorted by name, scheme and host in lower case, path at least /."""
    c = _c(c)
    head = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    authority = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    parts = F.filter(F.split(query(c), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    parts = F.transform(parts, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    keyed = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    kept = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    where = F.when(path(c) == "", "/").otherwise(path(c))
    return F.concat(head, authority, where, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def crawl_url(c: Column | str) -> Column:
    """Without fragment and trailing slash: pages that a crawl counts once."""
    return F.regexp_replace(F.regexp_replace(_c(c), "#.*$", ""), "/$", "")


def without_dots(p: Column) -> Column:
    """A path that starts with /, its . and .. segments resolved."""
    parts = F.split(p, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(kept, tail), "/")
    return F.when(joined == "", "/").otherwise(joined)


def absolute(href: Column, base: Column) -> Column:
    """href against base: absolute, host-relative, root-relative, query, fragment and plain relative references, with dot
    segments resolved; an empty one stays empty."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path(base) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    whole = (
        F.when(href == "", href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )
    at = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)$"
    plain = F.concat(F.regexp_extract(whole, at, 1), without_dots(F.regexp_extract(whole, at, 2)), F.regexp_extract(whole, at, 3))
    return F.when(whole.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*/)?\.{1,2}([/?#]|$)"), plain).otherwise(whole)


def host_matches(h: Column, patterns: Column) -> Column:
    """Whether a host is one of the patterns (an array); *.x is x and every host under it."""
    h = F.regexp_replace(F.lower(h), r"\.$", "")
    low = F.filter(F.transform(patterns, lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.exists(low, lambda p: F.when(p.startswith("*."), (h == F.substr(p, F.lit(3))) | h.endswith(F.substr(p, F.lit(2)))).otherwise(h == p))


def path_part(c: Column | str) -> Column:
    """A path in lower case without slashes at its ends."""
    return F.regexp_replace(F.lower(_c(c)), "^/+|/+$", "")


def artifact_name(c: Column | str) -> Column:
    """A file name for an address: without scheme, other characters than letters, digits, dot, dash and underscore as single
    dashes, 100 characters at most."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(c), "^https://", ""), "^http://", ""), r"[^A-Za-z0-9._-]", "-")
    name = F.substring(F.regexp_replace(name, "-+", "-"), 1, 100)
    return F.when(name == "", "artifact").otherwise(name)


def site(h: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.lower(h), ".", -2)


def internal(href: Column, base: Column) -> Column:
    return (host(href) == "") | (host(href) == host(base)) | (site(host(href)) == site(host(base)))


def media_filename(id_: Column, src: Column) -> Column:
    """id with the source's extension of at most six characters, else .bin."""
    ext = F.lower(F.regexp_extract(path(src), r"(\.[A-Za-z0-9]{1,5})$", 1))
    return F.concat(id_, F.when(ext == "", ".bin").otherwise(ext))


def robots_pattern(rule: Column) -> Column:
    """A robots path rule as an anchored regular expression: * is any run, a last $ the end."""
    escaped = F.regexp_replace(rule, r"([.+?^(){}|\[\]\\])", r"\\$1")
    escaped = F.regexp_replace(escaped, r"\*", ".*")
    ends = escaped.endswith("$")
    return F.concat(F.lit("^"), F.when(ends, escaped).otherwise(F.replace(escaped, F.lit("$"), F.lit("\\$"))))
