"""Queries of single rules over the driver's tables: hosts, headers, errors, bodies, records, pages that lead on."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkhop.functions import policy, urls
from linkhop.jobs.queries import _RESULTS, ORACLES, QUERIES, query, results, table
from linkhop.operators import hops
from linkhop.sources import tables

__all__ = ["ORACLES", "QUERIES"]


def _case(i, *values):
    """values[i % n], by a chain of WHENs."""
    out = F
    for k, v in enumerate(values):
        out = out.when(i % len(values) == k, v)
    return out


# --- hosts and addresses ------------------------------------------------------------------


@query(
    "public_ipv6",
    """WITH h AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 8193 WHEN 1 THEN 8194 WHEN 2 THEN 16383 WHEN 3 THEN 65152 ELSE o_orderkey * 7919 % 65536 END AS a,
      CASE o_orderkey % 4 WHEN 0 THEN 3512 WHEN 1 THEN o_orderkey % 512 ELSE o_orderkey * 31 % 65536 END AS b FROM orders)
    SELECT k AS o_orderkey, format('{:x}:{:x}::{:x}', a, b, k % 65536) AS ip,
      a BETWEEN 8192 AND 16383 AND NOT (a = 8193 AND (b < 512 OR b = 3512)) AND a <> 8194 AND NOT (a = 16383 AND b < 4096) AS is_public FROM h""",
)
def public_ipv6(spark, sf):
    """Addresses around the edges of the special blocks."""
    k = F.col("o_orderkey")
    a = F.when(k % 6 == 0, 8193).when(k % 6 == 1, 8194).when(k % 6 == 2, 16383).when(k % 6 == 3, 65152).otherwise(k * 7919 % 65536)
    b = F.when(k % 4 == 0, 3512).when(k % 4 == 1, k % 512).otherwise(k * 31 % 65536)
    digits = lambda n: F.lower(F.hex(n.cast("long")))
    ip = F.concat(digits(a), F.lit(":"), digits(b), F.lit("::"), digits(k % 65536))
    return table(spark, sf, "orders").select("o_orderkey", ip.alias("ip")).withColumn("is_public", policy.is_public(F.col("ip")))


@query(
    "ip_literals",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '2001:db8::' || c_custkey % 10 WHEN 1 THEN '10.0.0.' || c_custkey % 256 WHEN 2 THEN 'h.example' WHEN 3 THEN '10.0.0.300' ELSE '::1' END AS address,
    CASE c_custkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 4 THEN 6 END::INTEGER AS family FROM customer""",
)
def ip_literals(spark, sf):
    k = F.col("c_custkey")
    host = _case(k, F.concat(F.lit("[2001:db8::"), k % 10, F.lit("]")), F.concat(F.lit("10.0.0."), k % 256), F.lit("h.example"), F.lit("10.0.0.300"), F.lit("[::1]"))
    return table(spark, sf, "customer").select("c_custkey", policy.ip_literal(host).alias("l")).select("c_custkey", "l.*")


@query("strip_credentials", "SELECT page_id, url || '?m=a@b' AS href, page_id % 3 < 2 AS removed FROM pages")
def strip_credentials(spark, sf):
    i = F.col("page_id")
    put = lambda user: F.replace("url", F.lit("://"), F.lit(f"://{user}@"))
    href = F.concat(_case(i, put("u:p"), put("u"), F.col("url")), F.lit("?m=a@b"))
    return table(spark, sf, "pages").select("page_id", urls.strip_credentials(href).alias("s")).select("page_id", "s.*")


@query(
    "display_texts",
    r"""SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '\u{202e}\u{7}' ELSE '\u{e0001}' END AS shown,
    c_name || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '\u202e\u0007' ELSE '\udb40\udc01' END AS json FROM customer""",
)
def display_texts(spark, sf):
    """Control and format characters made visible; only texts that have some go through the helper."""
    from linkhop.functions.whatwg import json_safe, visible

    k, text = F.col("c_custkey"), F.col("text")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", _case(k, F.lit(""), F.lit("\u202e\x07"), F.lit("\U000e0001"))).alias("text"))
    odd = rows.where(urls.has_invisible(text)).select("c_custkey", visible(text).alias("shown"), json_safe(text).alias("json"))
    return odd.unionByName(rows.where(~urls.has_invisible(text)).select("c_custkey", text.alias("shown"), text.alias("json")))


# --- answers ------------------------------------------------------------------------------


@query(
    "hop_headers",
    """WITH e AS (SELECT event_id AS i, event_id % 7 NOT IN (3, 6) AS follows, event_id % 4 AS l FROM events)
    SELECT i AS event_id, CASE WHEN follows AND l < 2 THEN 'http://a.example/ü' || i END AS location,
    CASE WHEN follows AND l = 2 THEN 'Response has more than one Location header' END AS error, i % 5 = 0 AS challenged FROM e""",
)
def hop_headers(spark, sf):
    """Locations as headers bear them: none, one, two that are equal, two that differ; UTF-8 read as Latin-1."""
    i = F.col("event_id")
    one = F.concat(F.lit("http://a.example/Ã¼"), i.cast("string"))
    location = F.when(i % 4 == 0, F.array(one)).when(i % 4 == 1, F.array(one, one)).when(i % 4 == 2, F.array(one, F.lit("http://b.example/")))
    kind = hops.hop_kind(_case(i, *map(F.lit, (301, 302, 303, 304, 307, 308, 200))), location)
    cf = F.when(i % 5 == 0, "challenge").when(i % 5 == 1, "other")
    rows = table(spark, sf, "events").select("event_id", kind.alias("k"), hops.challenge(cf).alias("challenged"))
    return rows.select("event_id", urls.utf8_header(F.col("k.location")).alias("location"), "k.error", "challenged")


@query(
    "hop_errors",
    """WITH e AS (SELECT event_id AS i, event_id % 6 AS c, event_id % 4 AS w FROM events)
    SELECT i AS event_id, CASE WHEN c = 0 THEN 'BLOCKED' WHEN w = 2 THEN 'TIMEOUT' WHEN w = 3 THEN 'ERROR' WHEN c IN (1, 2) THEN 'TIMEOUT' WHEN c IN (3, 5) THEN 'ERROR' END AS status,
    CASE WHEN c = 0 THEN 'm' || i WHEN w = 2 THEN 'Request timed out' WHEN w = 3 THEN 'Request was cancelled' WHEN c = 1 THEN 'Connection timed out'
         WHEN c = 2 THEN 'DNS lookup timed out' WHEN c = 3 THEN 'Request failed (ECONNRESET)' WHEN c = 5 THEN 'Request failed (EPROTO)' END AS error FROM e""",
)
def hop_errors(spark, sf):
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    code = _case(i, F.lit("BLOCKED"), F.lit("ETIMEDOUT"), F.lit("ETIMEOUT"), F.lit("ECONNRESET"), none, F.lit("EPROTO"))
    cause = _case(i, none, none, F.lit("TimeoutError"), F.lit("AbortError"))
    return table(spark, sf, "events").select("event_id", hops.hop_error(code, F.concat(F.lit("m"), i), cause).alias("e")).select("event_id", "e.*")


@query(
    "decode_bodies",
    "SELECT page_id, CASE WHEN page_id % 4 <> 3 AND page_id % 5 <> 0 AND page_id % 7 <> 0 THEN '<p>é' || url END AS html FROM pages",
)
def decode_bodies(spark, sf):
    """Bodies in three charsets; pictures, packed bodies and answers with a Location have no page."""
    i = F.col("page_id")
    text = F.concat(F.lit("<p>é"), "url")
    body = _case(i, F.encode(text, "UTF-8"), F.encode(text, "ISO-8859-1"), F.encode(text, "UTF-16LE"), F.encode(text, "UTF-8"))
    kind = _case(i, F.lit("Text/HTML"), F.lit("text/html; charset=ISO-8859-1"), F.lit('application/xhtml+xml;charset="utf-16"'), F.lit("image/png"))
    html = tables.decode_body(body, kind, F.when(i % 7 == 0, "gzip"), F.when(i % 5 == 0, "http://t.example/"))
    return table(spark, sf, "pages").select("page_id", html.alias("html"))


@query("security_view", f"SELECT link_id, CASE WHEN final_url IS NOT NULL THEN starts_with(final_url, 'https:') END AS https, CASE WHEN final_url IS NOT NULL THEN true END AS public, link_id % 2 = 0 AS credentials_removed FROM ({_RESULTS})")
def security_view(spark, sf):
    v = hops.security_view(F.col("final_url"), F.col("status"), F.col("error"), F.col("link_id") % 2 == 0)
    return results(spark, sf).select("link_id", v.alias("v")).select("link_id", "v.https", "v.public", "v.credentials_removed")


@query("stored_results", f"SELECT chain[1] AS original_url, final_url, status, method, redirect_count, chain, http_status, error FROM ({_RESULTS})")
def stored_results(spark, sf):
    """Result records written as JSON, nulls kept, and read again."""
    path = tables.new_path(spark, "results")
    tables.write_results(results(spark, sf).withColumn("original_url", F.get("chain", F.lit(0))), path, "json")
    read = spark.read.text(path).select(tables.from_result_json(F.col("value")).alias("r"))
    return read.select(*(f"r.{c}" for c in ("original_url", "final_url", "status", "method", "redirect_count", "chain", "http_status", "error")))


@query("links_of_text", "SELECT url AS raw_url, NULL::VARCHAR AS expected FROM pages WHERE page_id % 10 <> 9")
def links_of_text(spark, sf):
    """Page URLs as a text file of one link a line, every tenth line blank, read as links."""
    path = tables.new_path(spark, "lines")
    table(spark, sf, "pages").select(F.when(F.col("page_id") % 10 == 9, "  ").otherwise(F.col("url")).alias("value")).write.text(path)
    return tables.read_links(spark, path, "text").select("raw_url", "expected")


# --- pages that lead on -------------------------------------------------------------------


@query(
    "leaving_pages",
    """SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'needs-click' WHEN 4 THEN 'none' ELSE 'redirect' END AS kind,
    CASE page_id % 5 WHEN 0 THEN 'http://t.example/' || page_id WHEN 1 THEN 'http://x.example/r?u=http%3A%2F%2Ft.example%2F' || page_id WHEN 3 THEN 'http://t.example/' || page_id END AS url,
    CASE WHEN page_id % 5 IN (0, 1, 3) THEN 'html' END AS method FROM pages""",
)
def leaving_pages(spark, sf):
    """Pages whose query names the way out: linked directly, handed on to another host, only shown, linked below a base, or not there (a refresh in noscript stays on the host)."""
    from linkhop.operators.pages import page_findings

    i = F.col("page_id")
    n = i.cast("string")
    snippet = _case(
        i,
        F.concat(F.lit("<a href='http://t.example/"), n, F.lit("'>go</a>")),
        F.concat(F.lit("<a href='http://x.example/r?u=http%3A%2F%2Ft.example%2F"), n, F.lit("'>go</a>")),
        F.concat(F.lit("<p>You leave for http://t.example/"), n, F.lit(" now</p>")),
        F.concat(F.lit("<base href='http://t.example/a/'><a href='../"), n, F.lit("'>go</a>")),
        F.lit("<noscript><meta http-equiv=refresh content='0;url=/same'></noscript>"),
    )
    at = F.concat(F.lit("http://p.example/out?to=http%3A%2F%2Ft.example%2F"), n)
    pages = table(spark, sf, "pages").select("page_id", at.alias("url"), F.concat(snippet, F.coalesce("html", F.lit(""))).alias("html"))
    return page_findings(pages).select("page_id", "kind", "url", "method")
