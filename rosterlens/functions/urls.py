"""Web addresses, Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .arrays import contains_any, let
from .text import strip


def normalize(url: Column) -> Column:
    """With a scheme, without query, fragment and trailing slashes; blank stays blank."""
    url = strip(F.coalesce(url, F.lit("")))
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(url == "", "").otherwise(F.regexp_replace(F.regexp_replace(full, r"(?s)[?#].*\z", ""), r"/+\z", ""))


def domain(url: Column) -> Column:
    """Lowered host name without port, credentials and one leading www."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def roster_key(url: Column) -> Column:
    """What two rows of a roster share that name one site."""
    bare = F.regexp_replace(F.lower(strip(F.coalesce(url, F.lit("")))), r"^https?://", "")
    return F.split(F.regexp_replace(bare, r"^www\.", ""), "/")[0]


def cache_key(url: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "[^A-Za-z0-9]+", "_"), r"^_+|_+\z", "")
    return F.when(key == "", "unknown").otherwise(key)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``: absolute, of the same scheme, host or folder, with dot segments taken out."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"(?s)[?#].*\z", "")
    path = F.regexp_replace(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.concat(root, F.regexp_replace(path, r"[^/]*\z", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*\z", ""), href))
        .otherwise(F.concat(folder, href))
    )
    return let(whole, _without_dots)


def _without_dots(whole: Column) -> Column:
    tail = F.regexp_extract(whole, r"(?s)([?#].*)\z", 1)
    head = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    parts = F.split(F.regexp_replace(F.regexp_replace(whole, r"(?s)[?#].*\z", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
    )
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, "/").otherwise(""))
    return F.when(whole.contains("/.") & (head != ""), F.concat(head, joined, tail)).otherwise(whole)


def should_skip(url: Column, avoid: tuple[str, ...] = L.AVOID, extensions: tuple[str, ...] = L.BINARY_EXTENSIONS) -> Column:
    """A binary file, or an unwanted word anywhere in the address, the host included."""
    low = F.lower(url)
    path = F.regexp_replace(F.regexp_replace(low, r"(?s)[?#].*\z", ""), r"^[a-z][a-z0-9+.-]*://[^/]*", "")
    out = F.lit(False)
    if extensions:
        out = path.rlike("(?:" + "|".join(re.escape(x) for x in extensions) + r")\z")
    return out | contains_any(low, avoid)


def relevant(url: Column, keywords: tuple[str, ...] = L.RELEVANT_URL_WORDS) -> Column:
    return contains_any(F.lower(url), keywords)


def link_score(url: Column, anchor: Column, hints: tuple[str, ...] = L.PATH_HINTS, keywords: tuple[str, ...] = L.LINK_WORDS) -> Column:
    low, text = F.lower(url), F.lower(F.coalesce(anchor, F.lit("")))
    out = F.lit(0)
    for h in hints:
        out = out + F.when(low.contains(h), 10).otherwise(0)
    for w in keywords:
        out = out + F.when(low.contains(w) | text.contains(w), 5).otherwise(0)
    return out
