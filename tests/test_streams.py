"""Streams in several runs over one checkpoint: links that wait for answers, deadlines, pages that settle."""

import datetime as dt

import pandas as pd

from linkhop.sources.tables import RESPONSES
from linkhop.streaming import requests as r


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def answer(url, seconds, to=None, cookie=None, sets=None):
    return (url, cookie, 302 if to else 200, [to] if to else None, sets, None, None, None, None, None, None, None, at(seconds), 1)


def test_links_wait_for_answers(spark, tmp_path):
    own, came, state = (str(tmp_path / n) for n in ("links", "answers", "state"))
    schema = "link_id long, raw_url string, ts timestamp"
    found = {}

    def run(links=(), answers=()):
        """One more run of the stream over what has come since, from where the last one stopped."""
        spark.createDataFrame(list(links), schema).coalesce(1).write.mode("append").parquet(own)
        spark.createDataFrame(list(answers), RESPONSES).coalesce(1).write.mode("append").parquet(came)
        found.clear()
        streams = [spark.readStream.schema(s).parquet(p) for s, p in ((schema, own), (RESPONSES, came))]
        keep = lambda results, _: found.update({x.link_id: (x.status, x.redirect_count, x.final_url) for x in results.collect()})
        r.resolve_stream(*streams, keep, state, wait="60 seconds", cookies=True).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "offsets")).start().awaitTermination()
        return dict(found)

    a = "http://a.test/"
    first = run([(1, a + "x", at(0)), (2, a + "never", at(0)), (3, "ftp://a.test/", at(0)), (4, "http://127.0.0.1/", at(0)), (5, a + "set", at(5))], [answer(a + "set", 1, "/gate", sets=["s=1"]), answer(a + "gate", 1, "/wrong")])
    assert first == {3: ("INVALID_URL", 0, None), 4: ("BLOCKED", 0, None)}
    # an answer comes, and leads to one that is still missing; another only answers other cookies
    assert run(answers=[answer(a + "x", 10, "/y")]) == {}
    assert run(answers=[answer(a + "gate", 20, None, "s=1")]) == {5: ("RESOLVED", 1, a + "gate")}
    assert run([(6, a + "y", at(30))], [answer(a + "y", 40)]) == {1: ("RESOLVED", 1, a + "y"), 6: ("RESOLVED", 0, a + "y")}
    # time passes
    assert run([(7, a + "y", at(61))]) == {7: ("RESOLVED", 0, a + "y"), 2: ("TIMEOUT", 0, None)}


def test_pages_settle(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "visit_id long, event_id long, ts timestamp, kind string, url string"
    found = []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        s = r.settled_pages(spark.readStream.schema(schema).parquet(path), 3000, "1 second")
        key = "spark.sql.streaming.noDataMicroBatches.enabled"
        spark.conf.set(key, "false")
        s.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
        spark.conf.set(key, "true")

    run([(1, 1, at(0), r.NAVIGATE, "a"), (1, 2, at(1), r.ANSWERED, None), (1, 3, at(6), r.READ, None), (2, 4, at(0), r.NAVIGATE, "b"), (2, 5, at(9), r.READ, None)])
    assert found == []  # the quiet before the HTML was read doesn't count, and b was never answered
    run([(1, 6, at(9), "other", None), (1, 7, at(10), r.NAVIGATE, "c"), (2, 8, at(11), r.ANSWERED, None)])
    assert [(x[0], x[3], x[4]) for x in found] == [(1, "a", 3)] and found[0][2] == at(9)
    found.clear()
    run([(1, 9, at(11), r.ANSWERED, None), (3, 10, at(60), "other", None)])
    run([(3, 11, at(61), "other", None)])  # the watermark is past the quiet of visit 2 now
    assert (2, "b", 3) in [(x[0], x[3], x[4]) for x in found] and not any(x[0] in (1, 3) for x in found)
    assert pd.Timestamp(next(x[2] for x in found if x[0] == 2)) == pd.Timestamp(at(14))


def test_links_without_cookies_are_led_by_doubling(spark):
    """Without cookies a batch takes no join a hop, and gives what hops does for links that end, wait, loop or stand amid their chain."""
    from pyspark.sql import functions as F

    from linkhop.operators import chains as c

    at = lambda i: f"http://a.test/{i}"
    step = "request_key string, kind string, target string, method string, status string, error string, http_status int, cookie string, elapsed_ms long"
    rows = [(at(i), "follow", at(i + 1), "http", None, None, 302, "", 1) for i in range(30)] + [(at(40), "follow", at(41), "http", None, None, 302, "", 1), (at(41), "follow", at(40), "http", None, None, 302, "", 1)]
    rows += [(at(50), "arrived", None, None, "RESOLVED", None, 200, "", 1), (at(51), "follow", at(50), "http", None, None, 302, "", 1), (at(52), "follow", at(60), "http", None, None, 302, "", 1), (at(60), "arrived", None, None, "RESOLVED", None, 200, "", 1), (at(60), "failed", None, None, "BLOCKED", "no", None, None, None)]
    steps = c.steps_by_key(spark.createDataFrame(rows, step))
    links = spark.createDataFrame([(i, at(i) + ("#f" if i % 2 else "")) for i in (0, 15, 25, 40, 50, 51, 52, 99)], "link_id long, href string")
    # a link that has gone four hops before
    far = c.setting_out(links.where("link_id = 0")).withColumn("link_id", F.lit(1000).cast("long"))
    amid = c.hops(far, steps.withColumn("set_cookies", F.lit(None).cast(c.SET_COOKIES)).where("regexp_extract(request_key, '[0-9]+$', 0) < 4"), 6, 10_000, True)[1]
    active = c.setting_out(links).unionByName(amid.select("link_id", "href", "s", "jar"))
    told = lambda done, waits: {r.link_id: (r.s.status, r.s.error, tuple(r.s.chain), tuple(r.s.seen), r.s.method, r.s.http_status, r.s.elapsed_ms) for r in done.select("link_id", "s").unionByName(waits.select("link_id", "s")).collect()}
    got = told(*c.walked(active, steps, 6, 10_000))
    assert got == told(*c.hops(active, steps.withColumn("set_cookies", F.lit(None).cast(c.SET_COOKIES)), 6, 10_000, True))
    assert {k: v[0] for k, v in got.items()} == {0: "UNRESOLVED", 15: "UNRESOLVED", 25: None, 40: "REDIRECT_LOOP", 50: "RESOLVED", 51: "RESOLVED", 52: "BLOCKED", 99: None, 1000: "UNRESOLVED"}
