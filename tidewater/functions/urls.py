"""URL expressions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track where a reader came from (fixed values), besides utm_*.
TRACKING_KEYS = ("from", "from_source", "spm")
DEFAULT_PORTS = {"http": 80, "https": 443}


def canonical(url: str | None) -> str:
    """One spelling for a URL: no user, default port, fragment or tracking keys; query sorted."""
    text = (url or "").strip()
    if not text:
        return ""
    try:
        split = urlsplit(text)
        port = split.port
    except ValueError:
        return text
    scheme = split.scheme.lower()
    host = (split.hostname or "").lower()
    if port and DEFAULT_PORTS.get(scheme) != port:
        host = f"{host}:{port}"
    keep = sorted(p for p in parse_qsl(split.query, keep_blank_values=True) if not _tracks(p[0].lower()))
    return urlunsplit((scheme, host, re.sub("/{2,}", "/", split.path or "/"), urlencode(keep), ""))


def _tracks(key: str) -> bool:
    return key in TRACKING_KEYS or key.startswith("utm_")


@F.pandas_udf(T.StringType())
def _canonical(url: pd.Series) -> pd.Series:
    out = url.copy()
    some = url.notna()
    out[some] = [canonical(u) for u in url[some]]
    return out


#: URLs whose canonical form needs no decoding or encoding: plain host, short port, query of unreserved characters.
_PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.-]+(:[1-9][0-9]{0,3})?(/[A-Za-z0-9._~/%+:@!$&'()*,;=-]*)?(\?[A-Za-z0-9._~=&-]*)?(#[A-Za-z0-9._~/%+:@!$&'()*,;=-]*)?$"


def canonical_url(url: Column | str) -> Column:
    """Exact canonical form: in the JVM for plain URLs, in Python (which alone gets to see them) for the others."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    plain = text.rlike(_PLAIN)
    return F.when(plain, canonical_url_native(text)).otherwise(_canonical(F.when(~plain, text)))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href)], dtype=object)


join_url = join_url.asNondeterministic()  # so that Spark doesn't join once more for a filter on what came out


def canonical_url_native(url: Column) -> Column:
    """The canonical form inside the JVM, for URLs whose query needs no re-encoding."""
    text = F.trim(F.coalesce(url, F.lit("")))
    bare = F.substring_index(text, "#", 1)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^[^/]*//([^/?]*)", 1), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*//[^/?]*([^?]*)", 1), "/{2,}", "/")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(f"^(utm_.*|{'|'.join(TRACKING_KEYS)})$"))
    pairs = F.array_sort(F.transform(query, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))
    return F.when(text == "", F.lit("")).otherwise(whole)


def host(url: Column) -> Column:
    """Lower-case host and port of a URL, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def domain_allowed_strict(link: Column, base: Column, allowed: list[str]) -> Column:
    """The base domain, its subdomains, or an allowed domain and its subdomains."""
    return _under(link, base, *[F.lit(d) for d in allowed])


def domain_allowed_wide(link: Column, base: Column, allowed: list[str]) -> Column:
    """The base domain, allowed domains, or anything under the base's last two labels."""
    root = F.substring_index(base, ".", -2)
    wide = F.when(base.contains("."), _under(link, root)).otherwise(F.lit(False))
    return (link == base) | (_under(link, *[F.lit(d) for d in allowed]) if allowed else F.lit(False)) | wide


def _under(link: Column, *domains: Column) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (link == d) | link.endswith(F.concat(F.lit("."), d))
    return out


def page_url(template: Column, page: Column, first_page_url: Column, n_start: Column, n_step: Column) -> Column:
    """URL of a numbered page; a first page of its own shifts the numbering by one."""
    has_first = F.coalesce(first_page_url, F.lit("")) != ""
    n = n_start + (page - F.when(has_first, 2).otherwise(1)) * n_step
    return F.when(has_first & (page == 1), first_page_url).otherwise(F.replace(template, F.lit("{n}"), n.cast("string")))


def sign_parameters(parameters: Column, timestamp: Column, secret: Column) -> Column:
    """md5 over sorted non-blank parameters (a map), the time in milliseconds and a secret."""
    some = F.filter(F.map_entries(parameters), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    text = F.array_join(F.transform(F.array_sort(some), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.md5(F.concat(text, timestamp.cast("string"), secret))


def search_url(template: Column, query: Column, page: Column) -> Column:
    """URL of a page of search results: the query percent-encoded in place of {}, and the page from the second on."""
    encoded = F.url_encode(query)
    for form, quoted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):  # forms and paths encode differently
        encoded = F.replace(encoded, F.lit(form), F.lit(quoted))
    return F.concat(F.replace(template, F.lit("{}"), encoded), F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise(""))
