"""URL functions as Column expressions (no Python in the hot path)."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The generic syntax regex of RFC 3986, appendix B.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC3986, group)


def netloc(url: Column) -> Column:
    """Authority in lower case, userinfo and port included; '' where there is none."""
    return F.lower(_part(url, 4))


def normalize_url(url: Column) -> Column:
    """One spelling per page: no fragment, lower-case scheme and authority, no trailing slashes.

    An empty path and `/` become `/`; slashes at the end of any other path go, so that `//` becomes empty; an empty query is dropped;
    `;params` stay with the last segment, without a slash before them. Null stays null.
    """
    scheme, auth, path, query = _part(url, 2), _part(url, 4), _part(url, 5), _part(url, 7)
    plain = F.regexp_extract(path, r"^(.*?)(;[^/]*)?$", 1)
    params = F.regexp_extract(path, r"^(.*?)(;[^/]*)?$", 2)
    plain = F.when(plain == "", "/").when(plain == "/", "/").otherwise(F.regexp_replace(plain, "/+$", ""))
    out = F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(auth != "", F.concat(F.lit("//"), F.lower(auth))).otherwise(""),
        plain,
        F.when(F.length(params) > 1, params).otherwise(""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url.isNull(), F.lit(None)).otherwise(out)


def base_domain(host: Column) -> Column:
    """Last two dot labels of an authority; '' for '', a single label for itself; a port stays."""
    return F.substring_index(host, ".", -2)


def same_domain(url: Column, base: Column) -> Column:
    """Whether the URL's base domain is `base`; false for malformed or null URLs."""
    return F.coalesce(base_domain(netloc(url)) == base, F.lit(False))


def site(url: Column) -> Column:
    """Last two labels of the host, letter case ignored, without userinfo and port; null if there is no host."""
    host = F.regexp_extract(F.lower(url), r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.substring_index(F.trim(host), ".", -2), F.lit(""))


def rejected_scheme(url: Column) -> Column:
    """Links that are never followed."""
    low = F.lower(url)
    return low.startswith("mailto:") | low.startswith("javascript:")


@F.pandas_udf(StringType())
def resolve_link(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution of `href` against `base`; null where it cannot be resolved."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolve_link_native(base: Column, href: Column) -> Column:
    """The forms without `..`, `?` or relative paths: absolute URLs, `//host`, `/path`, `#frag` and ''."""
    root = F.concat(_part(base, 1), _part(base, 3))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(_part(base, 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
    )
