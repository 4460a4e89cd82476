"""What a captured answer says about the next hop; one row per answer, before any chain is followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from linkhop.functions.policy import bad_port, bad_port_error
from linkhop.functions.urls import host, hostname, is_http_url, path, port, query, fragment, scheme, strip_credentials, utf8_url, without_fragment
from linkhop.operators.adapters import Adapter, apply_adapters, ask
from linkhop.operators.cookies import set_cookies_of
from linkhop.operators.network import check_dns
from linkhop.operators.pages import page_findings, parse_refresh, refresh_target
from linkhop.operators.targets import with_location
from linkhop.sources.tables import broadcast_if_small, decode_body, written

#: Statuses whose Location is followed.
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
#: Methods from light to heavy.
METHODS = ["http", "html", "meta-refresh", "javascript", "browser", "adapter"]


def method_weight(method: Column) -> Column:
    """1 for the lightest; 0 for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, METHODS)), method), F.lit(0)).cast("int")


def heavier(a: Column, b: Column) -> Column:
    return F.when(method_weight(a) >= method_weight(b), a).otherwise(b)


def challenge(cf_mitigated: Column) -> Column:
    return F.coalesce(cf_mitigated == "challenge", F.lit(False))


def hop_kind(status_code: Column, location: Column) -> Column:
    """struct(location, error): the Location of a redirect status; two that differ are an error."""
    several = F.size(F.array_distinct(location)) > 1
    follows = status_code.isin(REDIRECT_STATUSES)
    return F.struct(
        F.when(follows & ~F.coalesce(several, F.lit(False)), F.get(location, F.lit(0))).alias("location"),
        F.when(follows & several, F.lit("Response has more than one Location header")).alias("error"),
    )


def hop_error(code: Column, message: Column, cause: Column) -> Column:
    """struct(status, error) of a failed request; nulls without a code.  cause: why it was given up, if it was."""
    status = F.when(code == "BLOCKED", "BLOCKED").when(cause == "TimeoutError", "TIMEOUT").when(cause.isNotNull(), "ERROR").when(code.isin("ETIMEDOUT", "ETIMEOUT"), "TIMEOUT").when(code.isNotNull(), "ERROR")
    error = (
        F.when(code == "BLOCKED", message).when(cause == "TimeoutError", F.lit("Request timed out")).when(cause.isNotNull(), F.lit("Request was cancelled"))
        .when(code == "ETIMEDOUT", F.lit("Connection timed out")).when(code == "ETIMEOUT", F.lit("DNS lookup timed out")).when(code.isNotNull(), F.concat(F.lit("Request failed ("), code, F.lit(")")))
    )
    return F.struct(status.alias("status"), error.alias("error"))


HUMAN, CLICK, SCRIPT = "Human verification required", "The page asks for a click to continue to another site", "JavaScript destination could not be determined"


def next_step(status_code: Column, challenged: Column, location: Column, refresh: Column, finding: Column, adapter: Column) -> Column:
    """The decision for one answer: struct(kind, target, method, status, error, try_browser).

    kind: follow, stop or arrived.  finding: struct(kind, url, method, scripts_may_leave) of
    the page or null; of an error page only human-check counts.  refresh: usable target.
    """
    ok = status_code.between(200, 299)
    kind = F.coalesce(finding["kind"], F.lit("none"))
    failed = F.concat(F.lit("The server answered with HTTP "), status_code.cast("string"), F.when(status_code.between(300, 399), F.lit(" without a redirect to follow")).otherwise(""))
    may_leave = F.coalesce(finding["scripts_may_leave"], F.lit(False))
    no = F.lit(None).cast("string")

    def step(what, target=no, method=no, error=no, browser=F.lit(False)):
        status = {"stop": F.lit("UNRESOLVED"), "arrived": F.lit("RESOLVED")}.get(what, no)
        return F.struct(F.lit(what).alias("kind"), target.alias("target"), method.alias("method"), status.alias("status"), error.alias("error"), browser.alias("try_browser"))

    return (
        F.when(challenged, step("stop", error=F.lit(HUMAN)))
        .when(location.isNotNull(), step("follow", location, F.lit("http")))
        .when(ok & refresh.isNotNull(), step("follow", refresh, F.lit("meta-refresh")))
        .when(kind == "human-check", step("stop", error=F.lit(HUMAN)))
        .when(~ok, step("stop", error=failed))
        .when(kind == "redirect", step("follow", finding["url"], finding["method"]))
        .when(adapter.isNotNull(), step("follow", adapter, F.lit("adapter")))
        .when(kind == "unknown-script", step("stop", error=F.lit(SCRIPT), browser=F.lit(True)))
        .when(kind == "needs-click", step("stop", error=F.lit(CLICK), browser=may_leave))
        .otherwise(step("arrived", browser=may_leave))
    )


def needs_rendering(step: Column) -> Column:
    """Rows that the static readers can't settle."""
    return (step["kind"] != "follow") & step["try_browser"]


def security_view(final_url: Column, status: Column, error: Column, credentials_removed: Column) -> Column:
    """struct(https, public, blocked_reason, credentials_removed) for display."""
    return F.struct(
        (scheme(final_url) == "https").alias("https"),
        F.when(status == "BLOCKED", False).when(final_url.isNotNull(), True).alias("public"),
        F.when(status == "BLOCKED", error).alias("blocked_reason"),
        credentials_removed.alias("credentials_removed"),
    )


def url_view(original: Column, final: Column, chain: Column) -> Column:
    """struct of the parts of a result's URLs."""
    return F.struct(
        hostname(original).alias("original_host"), hostname(final).alias("final_host"), (hostname(original) != hostname(final)).alias("domain_changed"),
        scheme(final).alias("protocol"), F.coalesce(port(final), F.when(scheme(final) == "https", 443).otherwise(80)).alias("port"),
        path(final).alias("path"), query(final).alias("query"), fragment(final).alias("fragment"), F.transform(chain, host).alias("hosts"),
    )


EDGE = "request_key, kind, target, method, status, error, http_status, try_browser, credentials_removed, elapsed_ms, adapter, and of rendered ones visited, cleaned, asked"


def _judged(answers: DataFrame, headers: bool = True, pages: bool = True) -> DataFrame:
    """Rows (own, url, status_code, challenged, location, refresh, bad, why, page, adapter, adapter_name) to (own, kind, target, method, status, error, http_status, try_browser, credentials_removed, adapter).

    page: the page's text or null; refresh: the first Refresh header.  Pages that hold nothing
    of interest are not scanned.  Targets are resolved against url; own is carried along.
    headers, pages: whether there are Refresh headers and pages to read at all.
    """
    if headers:
        header = parse_refresh(F.col("refresh"))
        # a reload has no URL; it resolves to the page itself, so that it isn't followed
        read = answers.where("refresh is not null").select("refresh", "url").distinct().where(header.isNotNull())
        sent = written(read.select("refresh", "url", header["delay"].alias("delay"), F.coalesce(header["url"], F.lit("")).alias("leads")), "refreshes")
        if sent.isEmpty():
            told = answers.withColumn("refresh", F.lit(None).cast("string"))
        else:
            led = with_location(sent, F.col("leads"), F.col("url"), "to")
            led = written(led.select("refresh", "url", refresh_target(F.col("delay"), F.col("to.href"), F.col("url")).alias("to")), "refreshes")
            told = answers.join(broadcast_if_small(led), ["refresh", "url"], "left").withColumn("refresh", F.col("to")).drop("to")
    else:
        told = answers
    slim = F.struct("own", "url", "status_code", "challenged", "location", "refresh", "bad", "why", "adapter", "adapter_name")
    ok = F.col("status_code").between(200, 299)
    if pages:
        found = page_findings(told.select(slim.alias("page_id"), "url", F.when(F.col("location").isNull() & F.col("bad").isNull(), F.col("page")).alias("html"), (~F.coalesce(ok, F.lit(False))).alias("error_page")))
        rows = found.select("page_id.*", F.struct("kind", found["url"].alias("url"), "method", "scripts_may_leave").alias("finding"))
    else:
        rows = told.select(slim.alias("r"), F.lit(None).cast("struct<kind:string,url:string,method:string,scripts_may_leave:boolean>").alias("finding")).select("r.*", "finding")
    step = next_step(F.col("status_code"), F.col("challenged"), F.col("location"), F.col("refresh"), F.col("finding"), F.col("adapter"))
    rows = with_location(written(rows.withColumn("s", step).drop("finding"), "decided"), F.col("s.target"), F.col("url"), "next")
    follows = F.col("bad").isNull() & (F.col("s.kind") == "follow")
    return rows.select(
        "own", F.when(F.col("bad").isNotNull(), "failed").otherwise(F.col("s.kind")).alias("kind"), F.when(follows, F.col("next.href")).alias("target"), F.when(F.col("bad").isNull(), F.col("s.method")).alias("method"),
        F.coalesce("bad", F.when(follows, F.col("next.status")), "s.status").alias("status"), F.coalesce("why", F.when(follows, F.col("next.error")), "s.error").alias("error"),
        F.when(F.col("bad").isNull(), F.col("status_code")).alias("http_status"), (F.col("bad").isNull() & F.col("s.try_browser")).alias("try_browser"), F.coalesce(follows & F.col("next.credentials_removed"), F.lit(False)).alias("credentials_removed"),
        F.when(F.col("s.method") == "adapter", F.col("adapter_name")).alias("adapter"),
    )


def latest_answers(responses: DataFrame, cookies: bool = False) -> DataFrame:
    """Of several answers to one request the latest, then the one with the greater hash; with _key, _cookie, _at and _h.

    Without cookies only answers to requests that sent none count, and a URL is the request;
    with them a URL and its cookies are.  Rows that are equal all stay.
    """
    has = lambda c, kind: F.col(c) if c in responses.columns else F.lit(None).cast(kind)
    at = F.coalesce(has("fetched_at", "timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    cookie = F.coalesce(has("cookie", "string"), F.lit(""))
    keyed = responses.withColumns({"_key": without_fragment(utf8_url(F.col("request_url"))), "_cookie": cookie, "_at": at, "_h": F.xxhash64(*responses.columns)})
    if not cookies:
        keyed = keyed.where("_cookie = ''")
    counted = keyed.groupBy("_key", "_cookie").agg(F.max(F.struct("_at", "_h")).alias("_latest"), F.count("*").alias("_n"))
    several = written(counted.where("_n > 1").drop("_n"), "several")
    marked = keyed.join(broadcast_if_small(several), ["_key", "_cookie"], "left")
    return marked.where("_latest is null or (_latest._at = _at and _latest._h = _h)").drop("_latest")


def edges_of(responses: DataFrame, rules: DataFrame | None = None, cookies: bool = False, adapters: Sequence[Adapter] = ()) -> DataFrame:
    """What each captured answer says about the next hop, one row (EDGE) a request key: of several answers the latest, then the one with the greater hash.

    Every answer is judged once, whatever number of links meets it: its Location, its Refresh
    header, its page (body, or html as text) and the adapter rules, then the adapters where no
    rule knows its URL.  Targets are resolved
    against the URL that sent them; one that can't be followed is null and has its status
    and error.  Headers whose bytes are UTF-8 are read as such.  Columns that responses lack
    count as null.  Without cookies only answers to requests that sent none are read; with
    them there is a row for each URL and cookie header, with the Set-Cookie lines it answers.
    """
    has = lambda c, kind: F.col(c) if c in responses.columns else F.lit(None).cast(kind)
    latest = latest_answers(responses, cookies)
    hop = hop_kind(F.col("status_code"), F.transform("location", utf8_url))
    failed = hop_error(F.col("error_code"), F.col("error_message"), has("cause", "string"))
    own = F.struct(F.col("_key").alias("request_key"), F.col("_cookie").alias("cookie"), has("elapsed_ms", "long").alias("elapsed_ms"))
    if cookies:
        # without a time of its own an answer is as old as the run
        now = F.coalesce(has("fetched_at", "timestamp_ntz"), F.current_timestamp().cast("timestamp_ntz")).cast("timestamp")
        own = F.struct(own["request_key"].alias("request_key"), own["cookie"].alias("cookie"), own["elapsed_ms"].alias("elapsed_ms"), set_cookies_of(has("set_cookies", "array<string>"), now).alias("set_cookies"))
    text = has("html", "string") if "html" in responses.columns else decode_body(has("body", "binary"), has("content_type", "string"), has("content_encoding", "string"), hop["location"])
    rows = latest.select(
        own.alias("own"), F.col("_key").alias("url"), "status_code", challenge(F.col("cf_mitigated")).alias("challenged"), hop["location"].alias("location"),
        utf8_url(F.get(has("refresh", "array<string>"), F.lit(0))).alias("refresh"), F.coalesce(failed["status"], F.when(hop["error"].isNotNull(), "ERROR")).alias("bad"), F.coalesce(failed["error"], hop["error"]).alias("why"), text.alias("page"),
    )
    no = F.lit(None).cast("string")
    if rules is None:
        rows = rows.withColumns({"adapter": no, "adapter_name": no})
    else:
        asked = apply_adapters(rows.select(F.col("url").alias("page_id"), "url").distinct(), rules).select(F.col("page_id").alias("url"), F.col("target").alias("adapter"), "adapter_name")
        rows = rows.join(asked, "url", "left")
    if adapters:
        open_ = F.col("adapter_name").isNull() & F.col("status_code").between(200, 299) & F.col("bad").isNull()
        rows = rows.withColumn("_a", ask(adapters, F.when(open_, F.col("url")), F.col("page")))
        rows = rows.withColumns({"adapter": F.coalesce("adapter", "_a.target"), "adapter_name": F.coalesce("adapter_name", "_a.name")}).drop("_a")
    judged = _judged(rows, "refresh" in responses.columns, not {"html", "body"}.isdisjoint(responses.columns))
    # equal answers are one
    one = judged.groupBy("own.request_key", "own.cookie").agg(F.first(F.struct(*judged.columns)).alias("r"))
    edges = one.select("request_key", *(f"r.{c}" for c in judged.columns[1:]), F.col("r.own.elapsed_ms").alias("elapsed_ms"), *(["cookie", "r.own.set_cookies"] if cookies else []))
    return edges


def rendered_edges(edges: DataFrame, rendered: DataFrame) -> DataFrame:
    """edges, where those that the static readers can't settle take in the visit of a browser, if one was made.

    visited: the URLs that it went to, without the one it opened; user information is cut and
    no fragment passed on.  The page it stayed on is judged like any other, once, without a
    Location and without a third look; a failed visit keeps its status.
    """
    opened = without_fragment(F.col("request_url"))
    chain = F.coalesce("chain", F.array().cast("array<string>"))
    went = F.when(without_fragment(F.get(chain, F.lit(0))) == opened, F.slice(chain, 2, F.greatest(F.size(chain), F.lit(1)))).otherwise(chain)
    bare = F.transform(went, lambda u: strip_credentials(u)["href"])
    own = F.struct(opened.alias("v_key"), bare.alias("visited"), F.transform(went, lambda u: strip_credentials(u)["removed"]).alias("cleaned"), (F.col("visited_at") if "visited_at" in rendered.columns else F.lit(None).cast("timestamp")).alias("at"))
    at = F.coalesce(F.element_at(F.when(F.size(bare) > 0, bare), -1), opened)
    no = F.lit(None).cast("string")
    rows = rendered.select(
        own.alias("own"), at.alias("url"), "status_code", F.coalesce("challenge", F.lit(False)).alias("challenged"), no.alias("location"), "refresh",
        F.when(~F.col("ok"), F.coalesce("status", F.lit("ERROR"))).alias("bad"), F.when(~F.col("ok"), F.col("error")).alias("why"), F.col("html").alias("page"), no.alias("adapter"), no.alias("adapter_name"),
    )
    judged = _judged(rows)
    names = [c for c in judged.columns if c not in ("own", "try_browser")]
    visits = judged.select("own.v_key", "own.at", F.struct(*names, F.col("own.visited").alias("visited"), F.col("own.cleaned").alias("cleaned")).alias("v"))
    # the latest visit, then the one with the greater hash
    visits = visits.groupBy("v_key").agg(F.max_by("v", F.struct("at", F.xxhash64("v"))).alias("v"))
    met = edges.join(visits, F.when(F.col("try_browser"), F.col("request_key")) == F.col("v_key"), "left")
    new = lambda c: F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c)
    kept = [c for c in ("request_key", "cookie", "set_cookies", "try_browser", "elapsed_ms") if c in edges.columns]
    replaced = [c for c in names if c in edges.columns and c != "http_status"]
    # asked: what the page answered when it was first requested, which a failed visit leaves in place
    return met.select(*kept, *map(new, replaced), F.coalesce("v.http_status", "http_status").alias("http_status"), F.col("v.visited").alias("visited"), F.col("v.cleaned").alias("cleaned"), F.when(F.col("v").isNotNull(), F.col("http_status")).alias("asked"))


def refused_urls(edges: DataFrame, dns: DataFrame | None, links: DataFrame | None = None, suffixes: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(request_key, kind, status, error) of URLs that must not or can't be requested, captured or not.

    Judged are the keys of edges, their targets and the hrefs of links: ports that browsers
    refuse and what check_dns() says of their hosts; without dns, of addresses and internal
    names only.  Each host is judged once.  suffixes and blocks replace the policy's own.
    """
    keys = edges.select("request_key").unionByName(edges.select(without_fragment(F.col("target")).alias("request_key")))
    if links is not None:
        keys = keys.unionByName(links.select(without_fragment(F.col("href")).alias("request_key")))
    keys = keys.where("request_key is not null").distinct().select("request_key", hostname(F.col("request_key")).alias("host"), port(F.col("request_key")).alias("port"))
    # check_dns gives one row a host
    verdicts = check_dns(keys, dns, suffixes=suffixes, blocks=blocks).toDF("v_host", "v_status", "v_error")
    judged = keys.join(verdicts, F.col("host") == F.col("v_host"), "left")
    status = F.when(bad_port(F.col("port")), "BLOCKED").otherwise(F.col("v_status"))
    return judged.select("request_key", F.lit("failed").alias("kind"), status.alias("status"), F.coalesce(bad_port_error(F.col("port")), "v_error").alias("error")).where("status is not null")


def checked_edges(edges: DataFrame, dns: DataFrame | None, links: DataFrame | None = None, suffixes: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """edges, with a failed one in place of those of each URL that refused_urls() names."""
    refused = written(refused_urls(edges, dns, links, suffixes, blocks), "refused")
    return edges.join(refused.select("request_key"), "request_key", "left_anti").unionByName(refused, allowMissingColumns=True).select(*edges.columns)
