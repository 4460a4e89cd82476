import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from linkhop.operators import reports
from linkhop.sources import tables


def test_read_links(spark, tmp_path):
    rows = [{"service": "s", "url": "http://a.test/", "expected": "RESOLVED"}, {"service": "t", "url": "http://b.test/", "note": "n"}]
    (tmp_path / "links.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "links.txt").write_text("http://a.test/\n\nhttp://b.test/\n")
    got = tables.read_links(spark, str(tmp_path / "links.json")).orderBy("link_id").collect()
    assert [(r.raw_url, r.service, r.expected, r.note) for r in got] == [("http://a.test/", "s", "RESOLVED", None), ("http://b.test/", "t", None, "n")]
    assert [r.raw_url for r in tables.read_links(spark, str(tmp_path / "links.txt"), "text").collect()] == ["http://a.test/", "http://b.test/"]


def test_decode_body(spark):
    rows = [
        (bytearray("ü".encode()), "text/html", None, None), (bytearray(b"\xfc"), "text/html; charset=ISO-8859-1", "identity", None), (bytearray(b"x"), "text/html", "gzip", None),
        (bytearray(b"x"), "image/png", None, None), (bytearray(b"x"), "text/html", None, "/to"), (bytearray(b"a" * 1_048_580), "application/xhtml+xml; charset=none", None, None),
    ]
    df = spark.createDataFrame(rows, "b binary, t string, e string, l string")
    got = [r.x for r in df.select(tables.decode_body(F.col("b"), F.col("t"), F.col("e"), F.col("l")).alias("x")).collect()]
    assert got[:5] == ["ü", "ü", None, None, None] and len(got[5]) == 1_048_576


def test_result_json_and_report(spark, tmp_path):
    row = ("http://a.test/", None, "UNRESOLVED", None, 0, ["http://a.test/"], None, (5,), (False,), None, "a|b")
    df = spark.createDataFrame([row], tables.RESULT)
    text = df.select(tables.result_json(F.struct("*")).alias("j")).head()["j"]
    assert list(json.loads(text)) == ["original_url", "final_url", "status", "method", "redirect_count", "chain", "http_status", "timing", "security", "tracking", "error"]
    assert tuple(spark.createDataFrame([(text,)], "j string").select(tables.from_result_json(F.col("j")).alias("r")).select("r.*").head()) == tuple(df.head())
    tables.write_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    tables.write_results(df, str(tmp_path / "j"), "json")
    assert json.loads(spark.read.text(str(tmp_path / "j")).head()["value"])["final_url"] is None
    tables.write_report(df.select(F.lit(1).alias("link_id"), "status", "error"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| status | error |", "| --- | --- |", "| UNRESOLVED | a\\|b |"]


def test_report_of_two_runs(spark, tmp_path):
    links = spark.createDataFrame([(1, "http://a.test/", "s", "http://b.test/", None), (2, "http://c.test/", "t", "RESOLVED", "x|y"), (3, "http://d.test/", "u", None, None)], "link_id long, raw_url string, service string, expected string, note string")
    schema = "link_id long, final_url string, status string, method string, error string"
    plain = spark.createDataFrame([(1, "http://b.test/", "RESOLVED", "http", None), (2, None, "UNRESOLVED", "http", "no"), (3, None, "TIMEOUT", None, "late")], schema)
    full = spark.createDataFrame([(1, "http://z.test/", "RESOLVED", "browser", None), (2, "http://e.test/", "RESOLVED", "browser", None), (3, None, "TIMEOUT", None, "late")], schema)
    tables.write_report(reports.report_table(links, plain, full), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == [
        "| service | url | without_browser | as_expected_without | with_browser | as_expected_with | expected | note |", "| --- | --- | --- | --- | --- | --- | --- | --- |",
        "| s | http://a.test/ | RESOLVED (http) | yes | RESOLVED (browser) | no | http://b.test/ |  |", "| t | http://c.test/ | UNRESOLVED (http): no | no | RESOLVED (browser) | yes | RESOLVED | x\\|y |",
        "| u | http://d.test/ | TIMEOUT: late |  | TIMEOUT: late |  |  |  |",
    ]


def test_read_responses(spark, tmp_path):
    spark.createDataFrame([("http://a.test/", None, 200, None, None, None, None, None, None, bytearray(b"x"), None, None, None, 3)], tables.RESPONSES).drop("refresh").write.parquet(str(tmp_path / "r"))
    row = tables.read_responses(spark, str(tmp_path / "r")).head()
    assert (row.request_url, row.body, row.refresh, row.elapsed_ms) == ("http://a.test/", b"x", None, 3)


def test_log_of_every_step(spark):
    from linkhop.operators.adapters import Adapter
    from linkhop.operators.chains import resolve_links

    final = "http://dest.test/page?id=1&utm_source=x"
    removed = ("SECURITY", "A user name or password in the URL was taken out")

    def answer(url, code=200, location=None, html=None):
        return (url, None, code, location and [location], ["token=topsecret"], None, None, "text/html", None, html and bytearray(html.encode()), None, None, None, 1)

    responses = spark.createDataFrame([
        answer("http://a.test/start", 301, "/meta"), answer("http://a.test/meta", html="<meta http-equiv=refresh content='0; url=/js'>"), answer("http://a.test/js", html=f"<script>location = '{final}'</script>"), answer(final),
        answer("http://a.test/session", 302, "http://u:hunter2@dest.test/page"), answer("http://dest.test/page", html="<p>hunter2"), answer("http://dest.test/page?utm_%0Aevil=1"), answer("http://a.test/to-inside", 302, "http://inside.test/"),
        answer("http://a.test/plain", html="<p>x"), answer("http://a.test/fetch", html="<script>function f() { location = x }</script>"),
    ], tables.RESPONSES)
    rendered = spark.createDataFrame([("http://a.test/fetch", True, ["http://a.test/fetch", "http://user:pw@dest.test/page"], 200, False, None, "<p>destination", None, None)], tables.RENDERED)
    dns = spark.createDataFrame([("a.test", ["8.8.8.8"]), ("dest.test", ["8.8.8.8"]), ("inside.test", ["10.0.0.1"])], tables.DNS)
    raw = ["http://a.test/start", "http://user:s3cret@a.test/session", "http://dest.test/page?utm_%0Aevil=1", "http://a.test/to-inside", "javascript:alert(1)", "http://a.test/plain", "http://a.test/fetch"]
    links = spark.createDataFrame(list(enumerate(raw)), "link_id long, raw_url string")
    adapter = Adapter("example", lambda u: u.endswith("/plain"), lambda u, h: "http://dest.test/page")
    found = resolve_links(links, responses, dns, rendered=rendered, adapters=[adapter], log=True)
    log = {}
    for r in reports.steps_log(found).orderBy("link_id", "seq").collect():
        log.setdefault(r.link_id, []).append((r.tag, r.message))
    assert log[0] == [
        ("URL", "http://a.test/start"), ("HTTP", "301 http://a.test/start"), ("REDIRECT", "to http://a.test/meta"), ("HTTP", "200 http://a.test/meta"), ("HTML", "a refresh leads to http://a.test/js"), ("HTTP", "200 http://a.test/js"),
        ("JAVASCRIPT", f"a script goes to {final}"), ("HTTP", f"200 {final}"), ("TRACKING", "1 tracking parameter: utm_source"), ("FINAL", f"RESOLVED {final}"),
    ]
    assert log[1].count(removed) == 2 and log[1][-1] == ("FINAL", "RESOLVED http://dest.test/page")
    assert ("TRACKING", "1 tracking parameter: utm_%0Aevil") in log[2]
    assert log[3][-2:] == [("SECURITY", "inside.test resolves to a private or reserved address"), ("FINAL", "BLOCKED: inside.test resolves to a private or reserved address")]
    assert log[4] == [("FINAL", 'INVALID_URL: Only http and https links can be resolved (got "javascript:")')]
    assert ("REDIRECT", 'adapter "example" says the page leads to http://dest.test/page') in log[5]
    assert [x for x in log[6] if x[0] in ("BROWSER", "SECURITY")] == [("BROWSER", "opens http://a.test/fetch"), removed, ("BROWSER", "went to http://dest.test/page")]
    assert log[6][1] == ("HTTP", "200 http://a.test/fetch")
    assert not any(secret in m for lines in log.values() for _, m in lines for secret in ("s3cret", "topsecret", "hunter2", "pw@"))


def test_policy_of_ones_own(spark):
    """Blocks of both families and suffixes in place of the policy's own, through resolving; many blocks, some within others."""
    from linkhop.operators.chains import resolve_links
    from linkhop.operators.network import in_ranges, placed

    blocks = spark.createDataFrame([("8.8.0.0/16",), ("2600::/12",), ("2001:db8::1/128",)], "cidr string")
    dns = spark.createDataFrame([("a.test", ["8.8.8.8"]), ("b.test", ["10.0.0.1", "2001:db8::2"]), ("c.test", ["2606::1"]), ("d.local", ["9.9.9.9"]), ("e.own", ["9.9.9.9"]), ("f.test", ["fe80::1%eth0"])], tables.DNS)
    urls = ["http://a.test/", "http://b.test/", "http://c.test/", "http://d.local/", "http://e.own/", "http://[2001:db8::1]/", "http://[2001:db8::3]/", "http://127.0.0.1/", "http://8.8.1.1/", "http://f.test/"]
    responses = spark.createDataFrame([(u, None, 200, *[None] * 10, 1) for u in urls], tables.RESPONSES)
    links = spark.createDataFrame(list(enumerate(urls)), "link_id long, raw_url string")
    got = {r.link_id: r.status for r in resolve_links(links, responses, dns, suffixes=["own"], blocks=blocks).collect()}
    assert [got[i] for i in range(len(urls))] == ["BLOCKED", "RESOLVED", "BLOCKED", "RESOLVED", "BLOCKED", "BLOCKED", "RESOLVED", "RESOLVED", "BLOCKED", "BLOCKED"]
    many = spark.range(100_000).select(F.concat_ws(".", F.lit("10"), (F.col("id") / 65536).cast("int").cast("string"), (F.col("id") / 256).cast("int") % 256, F.col("id") % 256).alias("ip")).select(F.concat("ip", F.lit("/32")).alias("cidr"))
    many = many.unionByName(spark.createDataFrame([("10.0.0.0/9",), ("0.0.0.0/1",), ("::/0",)], "cidr string"))
    ips = spark.createDataFrame([("10.0.1.2",), ("10.127.1.2",), ("11.0.0.1",), ("200.0.0.1",), ("::1",), ("no",), (None,)], "ip string")
    assert {r.ip: (r.family, r.cidr) for r in placed(ips, many).collect()} == {"10.0.1.2": (4, "10.0.1.2/32"), "10.127.1.2": (4, "10.0.0.0/9"), "11.0.0.1": (4, "0.0.0.0/1"), "200.0.0.1": (4, None), "::1": (6, "::/0"), "no": (None, None), None: (None, None)}
    assert {r.ip for r in in_ranges(ips, many, how="left_anti").collect()} == {"200.0.0.1", "no", None}


def test_hot_keys_in_slices(spark):
    """One URL and one client with most of the log: lookups and counts as over the whole, from many slices."""
    import random

    from linkhop.operators import cache

    rng = random.Random(3)
    stored = sorted({(rng.choice(["hot"] * 8 + ["b"]), rng.randint(0, 900)) for _ in range(200)})
    asked = [(i, rng.choice(["hot"] * 8 + ["b", "c"]), rng.randint(0, 1000)) for i in range(400)]
    at = lambda s: f"2024-01-01 {s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"
    time = lambda df, *cs: df.withColumns({c: F.to_timestamp_ntz(F.col(c)) for c in cs})
    q = time(spark.createDataFrame([(i, u, at(s)) for i, u, s in asked], "request_id int, url string, ts string"), "ts")
    c = time(spark.createDataFrame([(u, at(s)) for u, s in stored], "url string, stored_at string"), "stored_at")
    want = {i: max((t for v, t in stored if v == u and t <= s), default=-99) + 20 > s for i, u, s in asked}
    assert {r.request_id: r.hit for r in cache.asof_cache(q, c, "20 seconds").collect()} == want
    assert cache.sliced(q, ["url", "ts", "request_id"], "t").where("url = 'hot'").select("_slice").distinct().count() > 1
    runs = [(rng.choice(["hot"] * 8 + ["b"]), s, s + rng.randint(0, 60)) for s in (rng.randint(0, 900) for _ in range(300))]
    df = time(spark.createDataFrame([(k, at(a), at(b)) for k, a, b in runs], "client string, ts string, end_ts string"), "ts", "end_ts")
    most = {}
    for k in ("hot", "b"):
        n = top = 0
        for _, d in sorted([(a, 1) for c, a, b in runs if c == k] + [(b, -1) for c, a, b in runs if c == k]):
            n += d
            top = max(top, n)
        most[k] = top
    assert {r.client: r.most for r in cache.concurrency(df).collect()} == most


def test_only_one_machine_may_lack_a_shared_folder():
    session = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {k.replace("_", "."): v for k, v in conf.items()}))
    assert tables.new_path(session("yarn", spark_checkpoint_dir="hdfs://shared/"), "x").startswith("hdfs://shared/linkhop/x-")
    own = tables.new_path(session("local[2]"), "x")
    assert own.rsplit("/linkhop/", 1)[0] == tables.new_path(session("local[2]"), "y").rsplit("/linkhop/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.new_path(session("spark://host:7077"), "x")


def test_six_texts_among_four_blocks(spark):
    from linkhop.operators.network import in_ranges, range_of

    ips = spark.createDataFrame([("10.0.0.1",), ("11.0.0.1",), ("::1",), ("::ffff:10.0.0.1",), ("x:y",), (None,)], "ip string")
    four = spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    found = range_of(ips, four)
    assert {r.ip: r.cidr for r in found.collect()} == {"10.0.0.1": "10.0.0.0/8", "11.0.0.1": None, "::1": None, "::ffff:10.0.0.1": None, "x:y": None, None: None}
    # where no block is IPv6, no text goes through a helper
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert in_ranges(ips, four).count() == 1 and in_ranges(ips, four, how="left_anti").count() == 5
    both = four.unionByName(spark.createDataFrame([("::/64",)], "cidr string"))
    assert {r.ip: r.cidr for r in range_of(ips, both).collect() if r.cidr} == {"10.0.0.1": "10.0.0.0/8", "::1": "::/64", "::ffff:10.0.0.1": "::/64"}
