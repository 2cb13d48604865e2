"""Addresses as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, and switches to the AMP form.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "gclsrc")


def host(url: Column) -> Column:
    """The host of a web address in lower case, without default port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))


def site(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalise_url(url: Column) -> Column:
    """The canonical form of an absolute http(s) address, null for anything else.

    Scheme and host in lower case, no default port, no fragment, no tracking parameters or AMP
    forms, parameters sorted by name and value, no final slash but of the root. Mobile hosts stay.
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", ""), r"#.*$", "")
    where = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    where = F.when(scheme == "http", F.regexp_replace(where, r":80$", "")).otherwise(F.regexp_replace(where, r":443$", ""))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/amp/?$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    kept = F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING, "amp") & (F.lower(p) != "output=1"),
    )
    query = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("n"), p.alias("p")))), lambda s: s["p"]), "&")
    full = F.concat(scheme, F.lit("://"), where, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (where != ""), full)


def trusted_canonical(canonical: Column, fetched: Column) -> Column:
    """canonical if it is on the host that was fetched, else null."""
    return F.when(site(canonical) == site(fetched), canonical)
