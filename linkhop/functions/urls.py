"""Columns over URL texts: cleaning, redaction, parts of canonical hrefs, query parameters, clean URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MAX_URL_LENGTH = 8192

#: Parameter names that only say where a visit came from, besides those that begin with utm_.
TRACKING_NAMES = [
    "gclid", "gclsrc", "gad_source", "dclid", "gbraid", "wbraid", "srsltid", "_ga", "_gl",
    "fbclid", "msclkid", "twclid", "ttclid", "li_fat_id", "epik", "yclid",
    "igshid", "igsh",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "vero_conv", "oly_anon_id", "oly_enc_id",
]
#: Parameter names that choose what a page shows.
FUNCTIONAL_NAMES = ["id", "q", "query", "search", "page", "lang", "v"]
#: Fixed value: the white space that is trimmed from input, besides control characters.
TRIMMED = r"[\s   -     　﻿]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit of all limits."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def without_ignored(text: Column) -> Column:
    """Without tabs and line breaks anywhere and without characters up to U+0020 at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def clean_input(text: Column) -> Column:
    """Input as it is parsed: without ignored characters, then without Unicode spaces at both ends."""
    return F.regexp_replace(without_ignored(text), rf"^{TRIMMED}|{TRIMMED}$", "")


def redact(text: Column) -> Column:
    """For display: what stands between scheme and slashes and the last @ is cut, then the rest at the limit."""
    return F.left(F.regexp_replace(without_ignored(text), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?([/\\]*)(?s:.*)@", "$1$2"), F.lit(MAX_URL_LENGTH))


def without_fragment(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def fragment(href: Column) -> Column:
    """From the first #, which is part of it; '' without one."""
    return F.substr(href, F.length(without_fragment(href)) + 1)


def is_http_url(href: Column) -> Column:
    return href.rlike("^https?:")


def origin(href: Column) -> Column:
    return F.regexp_extract(href, r"^https?://[^/?#]+", 0)


def scheme(href: Column) -> Column:
    return F.regexp_extract(href, r"^([a-z][a-z0-9+.-]*):", 1)


def host(href: Column) -> Column:
    """Host and explicit port of a canonical href."""
    return F.regexp_extract(href, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def hostname(href: Column) -> Column:
    return F.regexp_replace(host(href), r":[0-9]*$", "")


def port(href: Column) -> Column:
    """The explicit port, null where there is none."""
    found = F.regexp_extract(host(href), r":([0-9]+)$", 1)
    return F.when(found != "", found.cast("int"))


def path(href: Column) -> Column:
    return F.regexp_extract(href, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(href: Column) -> Column:
    """What stands between the first ? and the fragment; '' without a query."""
    return F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)


def strip_credentials(href: Column) -> Column:
    """struct(href, removed) of a canonical href."""
    bare = F.regexp_replace(href, r"^([a-z][a-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.struct(bare.alias("href"), (bare != href).alias("removed"))


def percent_decoded(text: Column) -> Column:
    """Decoded as a server reads a query: + is a space, a stray % stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def param_kind(name: Column) -> Column:
    """tracking, functional or unknown, whatever the case."""
    lower = F.lower(name)
    return F.when(lower.startswith("utm_") | lower.isin(TRACKING_NAMES), "tracking").when(lower.isin(FUNCTIONAL_NAMES), "functional").otherwise("unknown")


def _pieces(href: Column) -> Column:
    return F.filter(F.split(query(href), "&"), lambda p: p != "")


def _name(piece: Column) -> Column:
    return percent_decoded(F.substring_index(piece, "=", 1))


def query_params(href: Column) -> Column:
    """array of (name, value, kind) in order, repeats kept; only & separates, empty pieces are left out."""

    def param(piece: Column) -> Column:
        name = _name(piece)
        value = F.when(piece.contains("="), percent_decoded(F.substr(piece, F.length(F.substring_index(piece, "=", 1)) + 2))).otherwise("")
        return F.struct(name.alias("name"), value.alias("value"), param_kind(name).alias("kind"))

    return F.transform(_pieces(href), param)


def clean_url(href: Column) -> Column:
    """href without tracking parameters; as it is if it has none."""
    kept = F.filter(_pieces(href), lambda p: param_kind(_name(p)) != "tracking")
    rebuilt = F.concat(
        F.substring_index(without_fragment(href), "?", 1),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
        fragment(href),
    )
    return F.when(F.size(kept) == F.size(_pieces(href)), href).otherwise(rebuilt)


def tracking_names(href: Column) -> Column:
    """Names of the tracking parameters in order."""
    return F.transform(F.filter(query_params(href), lambda p: p["kind"] == "tracking"), lambda p: p["name"])


def tracking_report(href: Column) -> Column:
    return F.struct(clean_url(href).alias("clean_url"), query_params(href).alias("parameters"))


def request_key(href: Column, cookie: Column | None = None) -> Column:
    """What makes two requests the same: the URL without fragment, and the cookie header."""
    return F.concat_ws(" ", without_fragment(href), F.coalesce(cookie, F.lit("")) if cookie is not None else F.lit(""))


def utf8_header(value: Column) -> Column:
    """A header whose bytes were read as Latin-1, read as UTF-8."""
    return F.decode(F.encode(value, "ISO-8859-1"), "UTF-8")


def utf8_url(value: Column) -> Column:
    """A header that holds a URL: read as UTF-8 where its characters are bytes that are UTF-8, else as it is."""
    # characters that are no bytes are taken out first, as encode() fails on them wherever it is evaluated
    bytes_ = F.encode(F.regexp_replace(value, "[^\u0000-\u00ff]", ""), "ISO-8859-1")
    fits = value.rlike("[\u0080-\u00ff]") & ~value.rlike("[^\u0000-\u00ff]") & F.is_valid_utf8(bytes_.cast("string"))
    return F.when(fits, bytes_.cast("string")).otherwise(value)


def has_invisible(text: Column) -> Column:
    """Whether control or format characters occur, which visible() and json_safe() rewrite."""
    return text.rlike(r"[\p{Cc}\p{Cf}]")
