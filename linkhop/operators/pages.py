"""Redirects that pages make: refreshes, frames, leaving pages, what scripts.py reads of scripts.

A page is scanned once, by a small parser on batches; what follows is column work on the
arrays that the scan gives.  Pages that hold nothing of interest are settled by one
pattern and not scanned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.functions.urls import hostname, is_http_url, let, query_params, without_fragment
from linkhop.functions.whatwg import named_urls, parse
from linkhop.operators.scripts import WORDS, sinks_of, within_budget
from linkhop.sources.tables import short_batches

MAX_DELAY, MAX_DEPTH = 60, 512
#: Visible widgets that only a person completes.
CAPTCHA_CLASSES = ["cf-turnstile", "g-recaptcha", "h-captcha"]
#: Script types that browsers run.
SCRIPT_TYPES = [
    "", "module", "application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript",
    "text/ecmascript", "text/javascript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3",
    "text/javascript1.4", "text/javascript1.5", "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript",
]
_VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_WS = r"\t\n\f\r "

_REFRESHES = T.ArrayType(T.StructType([T.StructField("delay", T.DoubleType()), T.StructField("url", T.StringType()), T.StructField("href", T.StringType()), T.StructField("noscript", T.BooleanType())]))
_LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]))
_HREFS = T.ArrayType(T.StringType())
SCAN = T.StructType([
    T.StructField("refreshes", _REFRESHES), T.StructField("human", T.BooleanType()), T.StructField("password", T.BooleanType()),
    T.StructField("frameset", T.BooleanType()), T.StructField("frames", _HREFS), T.StructField("links", _LINKS),
    T.StructField("text", T.StringType()), T.StructField("jumps", _HREFS), T.StructField("loose", T.IntegerType()), T.StructField("mentions", T.IntegerType()),
])
NAMED = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("href", T.StringType()), T.StructField("written", T.StringType())]))


class _Deep(Exception):
    pass


class _Scan(HTMLParser):
    """Collects what the rules below read; templates are inert, reading stops past MAX_DEPTH open elements."""

    def __init__(self, page: str, links: bool):
        super().__init__(convert_charrefs=True)
        self.page, self.want = page, links
        self.base, self.base_seen = page, False
        self.open: list[str] = []
        self.script: list[str] | None = None
        self.out: dict = {"refreshes": [], "human": False, "password": False, "frameset": False, "frames": [], "links": [], "scripts": []}
        self.text: list[str] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag, attrs):
        if len(self.open) >= MAX_DEPTH:
            raise _Deep
        inert, noscript = "template" in self.open, "noscript" in self.open
        if tag not in _VOID:
            self.open.append(tag)
        if inert or tag == "template":
            return
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        out = self.out
        if not noscript:
            kind = a.get("type", "text/" + a["language"] if a.get("language") else "").strip().lower()
            if tag == "script" and kind in SCRIPT_TYPES and "src" not in a and (kind == "module" or "nomodule" not in a):
                self.script = []
            if tag in ("body", "frameset") and a.get("onload"):
                out["scripts"].append(a["onload"])
        if tag == "base" and not self.base_seen and "href" in a:
            self.base_seen = True
            url = parse(a["href"], parse(self.page))
            if url is not None and url.scheme in ("http", "https"):
                self.base = url.href
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            out["refreshes"].append((a.get("content", ""), self.base, noscript))
        classes = a.get("class", "").lower().split()
        if any(c in classes for c in CAPTCHA_CLASSES):
            out["human"] |= a.get("data-size", "").lower() != "invisible"
        elif tag == "input" and a.get("type", "").lower() != "hidden" and "captcha" in f"{a.get('name', '')} {a.get('id', '')}".lower():
            out["human"] = True
        out["password"] |= tag == "input" and a.get("type", "").strip().lower() == "password"
        out["frameset"] |= tag == "frameset"
        src = a.get("src", "").strip()
        if tag == "frame" and src and src != "about:blank":
            out["frames"].append(src)
        if self.want:
            canonical = tag == "link" and "canonical" in a.get("rel", "").lower().split()
            places = {("href", t) for t in ("a", "area")} | {("action", "form"), ("src", "iframe"), ("src", "frame")}
            out["links"] += [v for k, v in a.items() if k.startswith("data-") or (k, tag) in places or (k == "href" and canonical)]

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.out["scripts"].append("".join(self.script))
            self.script = None
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.want and not {"template", "script", "style"} & set(self.open[-3:]):
            self.text.append(data)


def refresh_parts(content: str) -> tuple[float, str | None] | None:
    """What parse_refresh() gives, for one value."""
    m = re.match(_REFRESH, content)
    if not m or not (m[1] or m[2].startswith(".")):
        return None
    rest = m[3] or ""
    body = re.sub(rf"(?i)\A(?:url[{_WS}]*=[{_WS}]*)", "", rest)
    if body == rest and rest[:1] in ("u", "U"):
        return float(m[1] or 0), rest
    if body[:1] in ('"', "'"):
        body = body[1:].split(body[0])[0]
    return float(m[1] or 0), body if rest else None


def scan(html: str | None, page: str, links: bool) -> tuple:
    s = _Scan(page, links)
    try:
        s.feed(html or "")
        s.close()
    except _Deep:
        pass
    o, bases = s.out, {}

    def href(ref: str | None, base: str) -> str | None:
        if base not in bases:
            bases[base] = parse(base)
        url = None if ref is None else parse(ref, bases[base])
        return None if url is None else url.href

    refreshes = [(p[0], p[1], href(p[1], base), quiet) for content, base, quiet in o["refreshes"] if (p := refresh_parts(content)) is not None]
    targets, loose, soft = sinks_of(o["scripts"])
    jumps = [href(t, s.base) for t in targets]
    linked = [(h, [k for k, _, _ in named_urls(h)]) for x in o["links"] if (h := href(x, s.base)) is not None]
    return refreshes, o["human"], o["password"], o["frameset"], [href(x, s.base) for x in o["frames"]], linked, "".join(s.text), jumps, loose, len(targets) + loose + soft


#: What a scan tells, and the external http(s) URLs that the query of the page's own URL names.
SCANNED = T.StructType([*SCAN.fields, T.StructField("named", NAMED)])


@F.pandas_udf(SCANNED)
def scan_page(html: pd.Series, url: pd.Series, names: pd.Series, held: pd.Series) -> pd.DataFrame:
    """Pages scanned, with what their URLs name where they may name any; of those that hold nothing to look for, only ones that do are read."""
    rows = []
    for h, u, n, x in zip(html, url, names, held, strict=True):
        named = named_urls(u) if n else []
        rows.append((*scan(h if x or named else None, u, bool(named)), named))
    return pd.DataFrame(rows, columns=SCANNED.names)


_REFRESH = rf"(?s)^[{_WS}]*([0-9]*)([0-9.]*)(?:(?=[;,{_WS}])[{_WS}]*[;,]?[{_WS}]*(.*))?$"


def parse_refresh(content: Column) -> Column:
    """struct(delay, url) of a refresh value, null for one that browsers ignore; url is null for a reload."""
    digits, rest = F.regexp_extract(content, _REFRESH, 1), F.regexp_extract(content, _REFRESH, 3)
    fine = content.rlike(_REFRESH) & ((digits != "") | F.regexp_extract(content, _REFRESH, 2).startswith("."))
    body = F.regexp_replace(rest, rf"(?i)^url[{_WS}]*=[{_WS}]*", "")
    quote = F.left(body, F.lit(1))
    bare = F.when(quote == '"', F.substring_index(F.substr(body, F.lit(2)), '"', 1)).when(quote == "'", F.substring_index(F.substr(body, F.lit(2)), "'", 1)).otherwise(body)
    url = F.when(rest == "", None).when((body == rest) & rest.rlike("^[uU]"), rest).otherwise(bare)
    return F.when(fine, F.struct(F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(0.0)).alias("delay"), url.alias("url")))


def refresh_target(delay: Column, href: Column, page: Column) -> Column:
    """A refresh's absolute target, null when it is slow or leads to the page itself."""
    return F.when((delay <= MAX_DELAY) & (without_fragment(href) != without_fragment(page)), href)


def return_to(url: Column) -> Column:
    """Whether a query says where to go back to."""
    return F.exists(query_params(url), lambda p: p["value"].rlike("^(/|(?i)https?://)"))


@F.pandas_udf(T.StructType([T.StructField("targets", T.ArrayType(T.StringType())), T.StructField("loose", T.IntegerType()), T.StructField("soft", T.IntegerType())]))
def script_sinks(scripts: pd.Series) -> pd.DataFrame:
    """struct(targets, loose, soft) of the scripts of a page together, within a budget: sure targets, other ways out, and what else may move the page.

    page_findings() has no budget and doesn't use this.
    """
    return pd.DataFrame([sinks_of(within_budget([] if s is None else list(s))) for s in scripts], columns=["targets", "loose", "soft"])


def single_target(sinks: DataFrame) -> DataFrame:
    """(page_id, kind, url) from rows (page_id, kind, url) of sinks, kind target, unknown or maybe.

    One distinct target and nothing unknown is a redirect; a target or unknown otherwise is
    unknown; else maybe.
    """
    g = sinks.groupBy("page_id").agg(F.count_distinct(F.when(F.col("kind") == "target", F.col("url"))).alias("n"), F.bool_or(F.col("kind") == "unknown").alias("unknown"), F.min(F.when(F.col("kind") == "target", F.col("url"))).alias("url"))
    kind = F.when((F.col("n") == 1) & ~F.col("unknown"), "redirect").when((F.col("n") > 0) | F.col("unknown"), "unknown").otherwise("maybe")
    return g.select("page_id", kind.alias("kind"), F.when(kind == "redirect", F.col("url")).alias("url"))


#: What a page's markup, in any case, and what its scripts must hold to be looked at further.
_MARKUP = ["http-equiv", "frameset", "captcha", "turnstile", "password"]
_SCRIPTS = r"location|open\s*\(|\b(?:submit|click)\s*\(|\beval\b|\bnew\s+Function\b"


def script_mentions(text: Column) -> Column:
    """Whether scripts, or a page with its scripts, hold a word that could move the page on; where none does, nothing is parsed.

    Words are looked for first: a pattern tried at each place of a long script takes a hundred times as long.
    """
    return F.coalesce(text.contains("location") | (_holds(text, WORDS) & text.rlike(_SCRIPTS)), F.lit(False))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def page_findings(pages: DataFrame) -> DataFrame:
    """(page_id, kind, url, method, scripts_may_leave, script_unsettled) of pages (page_id, url, html, error_page?).

    kind: redirect, human-check, unknown-script, needs-click or none.  On an error page only
    human-check is looked for.  A page without html has none.  All scripts are read, whatever
    their length, for constant targets of top-level statements only, so script_unsettled marks
    pages that rendering may still move.  Each page is read once, in one helper a task that is given short batches, so
    its memory doesn't grow with the table; nothing is shuffled.
    """
    short_batches(pages.sparkSession)
    error = F.col("error_page") if "error_page" in pages.columns else F.lit(False)
    p = pages.select("page_id", F.col("url").alias("page"), F.coalesce("html", F.lit("")).alias("html"), F.coalesce(error, F.lit(False)).alias("error"))
    names = F.coalesce(F.col("page").rlike(r"(?i)\?.*https?(:|%3a)"), F.lit(False))
    held = let(F.lower("html"), lambda low: _holds(low, _MARKUP)) | script_mentions(F.col("html"))
    p = p.select("page_id", "page", "html", "error", names.alias("names"), held.alias("held"))
    # a page that is settled by these isn't sent
    read = F.when(F.col("held") | F.col("names"), F.col("html"))
    s = p.withColumn("s", scan_page(read, "page", "names", "held")).select("page_id", "page", "error", "s.*")
    none = F.lit(None).cast("string")
    # the first readable refresh decides; one in noscript only counts if it leaves the host
    usable = F.filter("refreshes", lambda r: (r["url"].isNull() | r["href"].isNotNull()) & ~F.coalesce(r["noscript"] & (hostname(r["href"]) == hostname(F.col("page"))), F.lit(False)))
    first = F.get(usable, F.lit(0))
    refreshed = refresh_target(first["delay"], first["href"], F.col("page"))
    human = F.col("human") | (F.col("password") & return_to(F.col("page")))
    frame = F.get("frames", F.lit(0))
    framed = F.when(F.col("frameset") & (F.size("frames") == 1) & (without_fragment(frame) != without_fragment(F.col("page"))), frame)
    keys = F.transform("named", lambda n: n["key"])
    direct = F.get(F.filter("links", lambda u: F.array_contains(keys, without_fragment(u["href"]))), F.lit(0))["href"]
    leaving = F.when(direct.isNotNull(), F.element_at(F.filter("named", lambda n: n["key"] == without_fragment(direct)), -1)["href"])
    handed = F.get(F.filter("links", lambda u: (hostname(u["href"]) != hostname(F.col("page"))) & F.arrays_overlap(u["keys"], keys)), F.lit(0))["href"]
    # a target that is the page itself is a reload
    sure = F.array_distinct(F.filter("jumps", lambda u: F.coalesce(is_http_url(u) & (without_fragment(u) != without_fragment(F.col("page"))), F.lit(False))))
    loose = F.col("loose") > 0
    shown = F.exists("named", lambda n: F.col("text").contains(n["written"]) | F.col("text").contains(n["href"]) | F.col("text").contains(F.regexp_replace(n["href"], "/$", "")))
    maybe = (F.size(sure) == 0) & (F.col("mentions") > 0)

    def found(kind: str, url: Column = none, method: str | None = None, leave: Column = F.lit(False)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), url.alias("url"), F.lit(method).cast("string").alias("method"), leave.alias("scripts_may_leave"), leave.alias("script_unsettled"))

    f = (
        F.when(refreshed.isNotNull() & ~F.col("error"), found("redirect", refreshed, "meta-refresh"))
        .when(human, found("human-check")).when(F.col("error"), found("none"))
        .when(framed.isNotNull(), found("redirect", framed, "html"))
        .when(leaving.isNotNull(), found("redirect", leaving, "html"))
        .when(handed.isNotNull(), found("redirect", handed, "html"))
        .when((F.size(sure) == 1) & ~loose, found("redirect", F.get(sure, F.lit(0)), "javascript"))
        .when(F.size(sure) > 0, found("unknown-script"))
        .when(shown, found("needs-click", leave=maybe)).otherwise(found("none", leave=maybe))
    )
    return s.select("page_id", f.alias("f")).select("page_id", "f.*")
