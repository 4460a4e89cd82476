import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkhop.functions import policy, urls
from linkhop.functions.whatwg import input_url, json_safe, location_url, visible

INPUTS = [
    ("bit.ly/x", "https://bit.ly/x"), ("//bit.ly/x", "https://bit.ly/x"), ("localhost:8080/x", "https://localhost:8080/x"),
    ("HTTP://EXAMPLE.com:80/a/../b?q=a|b#f g", "http://example.com/b?q=a|b#f%20g"), ("http://bücher.example/", "http://xn--bcher-kva.example/"),
    ("http://0x7f.1/", "http://127.0.0.1/"), ("http://a.test/x y", "http://a.test/x%20y"), ("http://[2001:db8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"),
    ("http://①②③.④/", "http://123.0.0.4/"), ("http:/a.test/x", "http://a.test/x"), ("http://a.test\\b\\c", "http://a.test/b/c"),
    (" \thttp://a.test/\n", "http://a.test/"), ("https://user:pa@ss@evil.example/", "https://evil.example/"),
]


@pytest.mark.parametrize("raw,href", INPUTS)
def test_input_urls(raw, href):
    ok, got, *_, removed = input_url(raw)
    assert (ok, got, removed) == (True, href, "@" in raw)


@pytest.mark.parametrize("raw,error", [
    ("", "URL is empty"), (None, "URL is empty"), ("http://256.1.1.1/", "Not a valid URL"), ("http://x:99999/", "Not a valid URL"),
    ("javascript:alert(1)", 'Only http and https links can be resolved (got "javascript:")'), ("http://a/" + "x" * 9000, "URL is longer than 8192 characters"),
])
def test_rejected_input(raw, error):
    ok, href, status, got, *_ = input_url(raw)
    assert (ok, href, status, got) == (False, None, "INVALID_URL", error)


@pytest.mark.parametrize("location,base,href", [
    ("/next?a=1", "http://a.test/x#frag", "http://a.test/next?a=1#frag"), ("#z", "http://a.test/x#q", "http://a.test/x#z"),
    ("../c", "http://a.test/a/b/d", "http://a.test/a/c"), ("//b.test/z", "https://a.test/", "https://b.test/z"), ("http:foo", "http://a.test/x/y", "http://a.test/x/foo"),
])
def test_locations(location, base, href):
    assert location_url(location, base)[1] == href


def test_location_errors():
    assert location_url("mailto:x", "http://a.test/")[2:4] == ("BLOCKED", 'Redirect to a "mailto:" URL was not followed (only http and https)')
    assert location_url("http://", "http://a.test/")[2] == "ERROR"
    assert location_url("/x", "http://a.test/#f", inherit_fragment=False)[1] == "http://a.test/x"


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).head()["x"]


def test_tracking(spark):
    c = F.col("u")
    assert one(spark, urls.clean_url(c), u="http://a.test/?a=1&UTM_x=2&&b=%zz#f") == "http://a.test/?a=1&b=%zz#f"
    assert one(spark, urls.clean_url(c), u="http://a.test/?a=1&&b=2") == "http://a.test/?a=1&&b=2"
    assert one(spark, urls.clean_url(c), u="http://a.test/?gclid=1") == "http://a.test/"
    got = one(spark, urls.query_params(c), u="http://a.test/?q=50%+off&q=%41;b&utm_source=x")
    assert [tuple(p) for p in got] == [("q", "50% off", "functional"), ("q", "A;b", "functional"), ("utm_source", "x", "tracking")]


def test_redact_and_header(spark):
    c = F.col("u")
    assert one(spark, urls.redact(c), u="ht\ntps://key:a/b@host/x") == "https://host/x"
    assert one(spark, urls.redact(c), u="blob:https://u:p@h") == "blob:h"
    assert one(spark, urls.utf8_header(c), u="/Ã¼") == "/ü"
    assert one(spark, urls.utf16_length(c), u="a😀") == 3
    assert one(spark, visible(c), u="a‮b\n") == "a\\u{202e}b\\u{a}"
    assert one(spark, json_safe(c), u="‮") == "\\u202e"


def test_addresses(spark):
    public = ["1.1.1.1", "168.63.129.15", "172.32.0.0", "2606:4700::1111", "2001:4860:4860::8888"]
    other = ["10.0.0.1", "168.63.129.16", "172.31.255.255", "01.1.1.1", "255.255.255.255", "::1", "2001:db8::1", "fe80::1%eth0", "::ffff:1.1.1.1", "x", "2002:7f00:1::"]
    df = spark.createDataFrame([(a,) for a in public + other], "ip string")
    got = {r.ip: r.p for r in df.select("ip", policy.is_public(F.col("ip")).alias("p")).collect()}
    assert got == {a: a in public for a in public + other}


def test_hosts(spark):
    df = spark.createDataFrame([("intranet",), ("a.local.",), ("LOCALHOST",), ("mylan.example",), ("x.home.arpa",), ("a" + "." * 8000,)], "h string")
    assert [r.x for r in df.select(policy.internal_host(F.col("h")).alias("x")).collect()] == [True, True, True, False, True, True]


def test_empty_tables(spark):
    from linkhop.operators import chains, network

    none = spark.createDataFrame([], "host string")
    assert network.check_dns(none, spark.createDataFrame([], "host string, addresses array<string>")).count() == 0
    links = spark.createDataFrame([], "link_id long, href string")
    edges = spark.createDataFrame([], "request_key string, kind string, target string, method string, status string, error string, http_status int")
    assert chains.resolve_chains(links, edges).count() == 0
    assert dt


def test_plain_urls_by_columns(spark):
    """What columns give for plain input and targets is what the helper gives, with and without inherited fragments."""
    import random

    from linkhop.operators.targets import with_input, with_location

    rng = random.Random(6)
    hosts = ["a.test", "a.b-c.example", "A.test", "1.2.3.4", "a.1", "xn--a.test", "a_b.test", "a.test:80", "a.test:8080", "u@a.test", "-a.test", "a", "a..test", "b\u00fc.test", "a.test."]
    paths = ["/", "", "/x", "/x/", "/./y", "/x/../y", "/..", "/.x", "/x.html", "/...", "/a/.b./c", "//x", "/x//y", "/x%41", "/x y", "/\u00fc", "/x;p=1", "/x|y", "/.", "\\x", "/%2e/x"]
    rests = ["", "?", "?a=b&c", "#", "#f", "?q=%41#f/g", "?q='", "#f g", "?a?b#c#d", "?\u00fc", "?x={}"]
    url = lambda: rng.choice(["http://", "https://", "HTTP://", "ftp://", "//", "http:", ""]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(rests)
    texts = [*{url() for _ in range(700)}, *(p + r for p in paths for r in rests), "mailto:a@b.c", "javascript:x", "x/y", "../x", "http://a.test/" + "x" * 8180, None, " /x", "/x\n", "http://a.test/\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: tuple(r.p) for r in with_input(df, "t", "p").collect()}
    assert {texts[i]: p for i, p in got.items()} == {t: input_url(t) for t in texts}
    bases = ["http://a.test/x/y?q#f", "https://b.example/", "http://1.2.3.4/z", "http://a.test:8080/#g"]
    pairs = [(t, bases[i % len(bases)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(pairs)], "i int, t string, b string")
    for inherit in (True, False):
        got = {r.i: tuple(r.p or (None,) * 6) for r in with_location(df, F.col("t"), F.col("b"), "p", inherit).collect()}
        assert {(pairs[i]): p for i, p in got.items()} == {(t, b): (None,) * 6 if t is None else location_url(t, b, inherit) for t, b in pairs}


def test_plain_urls_need_no_python(spark):
    from linkhop.operators.targets import with_input, with_location

    df = spark.createDataFrame([("http://a.test/x.html?q=1#f", "/y"), ("https://b.example/", "//c.example/z")], "t string, l string")
    rows = with_location(with_input(df, "t", "p"), F.col("l"), F.col("t"), "n")
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert sorted(r.n.href for r in rows.collect()) == ["http://a.test/y", "https://c.example/z"]
