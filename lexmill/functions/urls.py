"""Address expressions. Column in, Column out; a null address gives null, a malformed one its best reading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def to_https(url: Column) -> Column:
    """The address with scheme https and without parameters, query and fragment."""
    bare = F.regexp_replace(path(url), r";[^/]*$", "")
    return F.concat(F.lit("https://"), authority(url), bare)


def under_prefix(url: Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it; closing slashes don't matter."""
    own, root = F.regexp_replace(path(url), "/+$", ""), prefix.rstrip("/")
    return (own == root) | own.startswith(root + "/")


def should_skip(url: Column) -> Column:
    """Mail and phone links, share, print, download and search pages, paging and sorting parameters."""
    low = F.lower(url)
    return F.rlike(low, F.lit(r"^(mailto|tel):|/share/|/print/|/download/|/search\?|[?&](page|sort|order|view|start|from|to|size|limit)="))


def segments(url: Column) -> Column:
    """Path segments between slashes, closing and opening slashes apart; the root has none."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/"))


def title_case(text: Column) -> Column:
    """Upper case after anything that is no letter, lower case elsewhere."""
    spaced = F.regexp_replace(text, r"(?<=[^\p{L}])(?=\p{L})", "\u0001 ")
    return F.regexp_replace(F.initcap(spaced), "\u0001 ", "")


def breadcrumb(url: Column) -> Column:
    """``a-b/c`` as ``A B > C``."""
    return F.array_join(F.transform(segments(url), lambda s: title_case(F.replace(s, F.lit("-"), F.lit(" ")))), " > ")


def branch_key(url: Column) -> Column:
    """The first three named segments of the path, or the path where it has fewer."""
    own = F.regexp_replace(path(url), "/+$", "")
    parts = F.split(own, "/")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), "/")).otherwise(own)


def filename(url: Column) -> Column:
    """The file under which a page is saved: slashes doubled to underscores, long names cut and hashed."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    inner = F.when(inner == "", "index").otherwise(inner)
    name = F.concat(F.replace(inner, F.lit("/"), F.lit("__")), F.lit(".html"))
    short = F.concat(F.substring(name, 1, 190), F.lit("__"), F.substring(F.md5(inner), 1, 8), F.lit(".html"))
    return F.when(F.length(name) > 200, short).otherwise(name)


def ancestors(url: Column) -> Column:
    """(depth, url, child) of the addresses above one, deepest first; child is the next segment down."""
    own = F.regexp_replace(path(url), "/+$", "")
    parts = F.split(own, "/")
    base = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1), authority(url))
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        depths,
        lambda d: F.struct(
            d.alias("depth"),
            F.concat(base, F.array_join(F.slice(parts, F.lit(1), d), "/")).alias("url"),
            F.coalesce(F.get(parts, d), F.lit("")).alias("child"),
        ),
    )


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link resolved against the address of its page; null where it can't be."""
    from urllib.parse import urljoin

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")
