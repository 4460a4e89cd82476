"""The request log as a stream: rate limits, settled pages, deadlines, repeated requests, the result cache, resolving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkhop.functions.urls import without_fragment
from linkhop.operators.chains import DEADLINE_MS, LATE_ERROR, MAX_REDIRECTS, STATE, STEP, as_results, hops, inputs, records, setting_out, steps_by_key, typed, walked
from linkhop.operators.cookies import JAR, SET_COOKIES
from linkhop.operators.hops import edges_of, latest_answers, refused_urls
from linkhop.sources.tables import new_path, written


def offsets(spark: SparkSession) -> str:
    """A new folder for a stream's offsets, in the shared folder."""
    return new_path(spark, "offsets")


def run_available(stream: DataFrame, mode: str = "append", flush: bool = False) -> DataFrame:
    """Runs a stream over what there is now, to a table in the shared folder, and reads it.

    flush: whether a batch without data follows, which gives what the last watermark ends.
    """
    found: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        if mode == "complete":
            found.clear()
        found.append(written(batch, "stream"))

    spark = stream.sparkSession
    # state with timeouts would ask for empty batches without end
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(flush).lower())
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", offsets(spark)).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = found[0] if found else spark.createDataFrame([], stream.schema)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def rate_limit(requests: DataFrame, limit: int = 30, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(client, start, requests, refused) by client and clock-aligned minute, of a stream or a table (client, ts)."""
    counts = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "client").agg(F.count("*").alias("requests"))
    return counts.select("client", F.col("window.start").alias("start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


SETTLED = "visit_id long, start timestamp, end timestamp, url string, events long"
#: What happens to a page in a visit: a navigation is asked for, answered, its HTML is read, or anything else.
NAVIGATE, ANSWERED, READ = "navigate", "answered", "read"


def settled_pages(events: DataFrame, gap_ms: int = 3000, late: str = "1 minute", forget_ms: int = 3_600_000) -> DataFrame:
    """(visit_id, start, end, url, events) of events (visit_id, event_id, ts, kind, url): where pages of each visit arrived.

    A page has arrived once no navigation is under way, its HTML has been read and nothing has
    happened for gap_ms.  `navigate` puts one under way to url, `answered` ends that, `read`
    says that the HTML was read; any event ends the quiet.  A page is told with the first
    event after its quiet, or when the watermark passes it; start and events are of its time
    since the one before arrived.  Events that the watermark passed are dropped, and a visit
    without events for forget_ms is forgotten, so state ends.
    """
    ordered = events.withWatermark("ts", late).select("visit_id", "event_id", "ts", "kind", "url")
    gap = pd.Timedelta(milliseconds=gap_ms)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, pending, ready, url, n = state.get if state.exists else (None, None, False, False, None, 0)
        out = []

        def arrive() -> None:
            nonlocal start, n
            out.append((key[0], pd.Timestamp(start, unit="us"), pd.Timestamp(last, unit="us") + gap, url, n))
            start, n = None, 0

        settles = lambda: start is not None and not pending and ready
        columns = SETTLED.replace(",", "").split()[::2]
        if state.hasTimedOut:
            if settles():
                arrive()
                # the page stays open: what comes next belongs to a new stay on it
                state.update((None, last, pending, ready, url, 0))
                state.setTimeoutTimestamp(max(last // 1000 + forget_ms, state.getCurrentWatermarkMs() + 1))
                yield pd.DataFrame(out, columns=columns)
            else:
                state.remove()
            return
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            at = e.ts.value // 1000
            if settles() and at - last >= gap_ms * 1000:
                arrive()
            start = at if start is None else start
            last, n = at, n + 1
            if e.kind == NAVIGATE:
                pending, ready, url = True, False, e.url
            elif e.kind == ANSWERED:
                pending = False
            elif e.kind == READ:
                ready = True
        state.update((start, last, pending, ready, url, n))
        state.setTimeoutTimestamp(max(last // 1000 + (gap_ms if settles() else forget_ms), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=columns)

    held = "start long, last long, pending boolean, ready boolean, url string, n long"
    return ordered.groupBy("visit_id").applyInPandasWithState(watch, SETTLED, held, "append", GroupStateTimeout.EventTimeTimeout)


def deadline_join(links: DataFrame, answers: DataFrame, within: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """links (link_id, ts, ...) with the answers (a_link_id, a_ts, ...) that come within the deadline of their start, one for the whole chain.

    A link without one is a TIMEOUT row: of tables at once, of two streams as soon as both
    watermarks have passed its deadline, so no answer that comes later counts.  Both sides
    are held as state no longer than that.
    """
    a = answers.withWatermark("a_ts", late)
    near = F.expr(f"link_id = a_link_id AND a_ts >= ts AND a_ts <= ts + interval {within}")
    joined = links.withWatermark("ts", late).join(a, near, "left_outer")
    return joined.withColumn("status", F.when(F.col("a_ts").isNull(), "TIMEOUT"))


def dedup_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each request key once per link."""
    keyed = requests.withColumn("request_key", without_fragment(F.col("url"))).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["link_id", "request_key"]) if requests.isStreaming else keyed.dropDuplicates(["link_id", "request_key"])


WAITING = f"link_id bigint, ts timestamp, href string, own_removed boolean, s struct<{typed(STATE)}>, jar {JAR}"
ANSWERS = f"request_key string, cookie string, step struct<{typed(STEP)}>, set_cookies {SET_COOKIES}, at timestamp"


def resolve_stream(
    links: DataFrame, responses: DataFrame, sink, state: str | None = None, dns: DataFrame | None = None, rules: DataFrame | None = None, wait: str = "10 minutes", keep: str | None = None,
    max_redirects: int = MAX_REDIRECTS, deadline_ms: int = DEADLINE_MS, cookies: bool = False,
) -> DataStreamWriter:
    """Streams of raw links (link_id, raw_url, ts) and of answers (RESPONSES), resolved as both arrive, in any order.

    A link goes on as far as answers have come; at a URL without one it waits as it stands,
    with its chain and jar, and goes on with the batch that brings the answer.  One that has
    waited since `wait` before the newest time seen ends as a timeout.  Every batch judges
    its own answers once; of several to one request the latest that has come counts.
    sink(results, batch_id) takes the records of links that ended in a batch.

    Answers and waiting links are tables in the folder `state`, one part a batch, so a batch
    that is run again after a failure reads what the one before it left and writes the same
    parts again; the folder belongs to one checkpoint.  Answers older than `keep` before the
    newest time are no longer read (null: all are).
    """
    spark = links.sparkSession
    root = state or new_path(spark, "stream")
    for name, schema in (("answers", ANSWERS), ("waiting", WAITING), ("clock", "now timestamp")):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}/batch=-1")
    no = lambda df: F.lit(None).cast(df.schema.simpleString())
    own = links.select("link_id", "raw_url", F.col("ts").cast("timestamp").alias("ts"))
    both = own.select(F.struct("*").alias("link"), no(responses).alias("answer")).unionByName(responses.select(no(own).alias("link"), F.struct("*").alias("answer")))

    def part(name: str, schema: str, where: str) -> DataFrame:
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").where(where)

    def put(df: DataFrame, name: str, i: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={i}")
        return spark.read.schema(schema).parquet(f"{root}/{name}/batch={i}")

    def batch(df: DataFrame, i: int) -> None:
        got = written(df, "batch")
        new, bad = inputs(got.where("link is not null").select("link.*"))
        came = got.where("answer is not null").select("answer.*")
        times = got.select(F.greatest("link.ts", F.col("answer.fetched_at").cast("timestamp")).alias("t")).unionByName(part("clock", "now timestamp", f"batch < {i}").select(F.col("now").alias("t")))
        now = put(times.agg(F.max("t").alias("now")), "clock", i, "now timestamp").head()[0]
        edges = written(edges_of(came, rules, True).where("true" if cookies else "cookie = ''"), "judged")
        refused = refused_urls(edges, dns, new)
        steps = steps_by_key(edges.unionByName(refused, allowMissingColumns=True))
        # a refused URL stays refused, so its time doesn't matter
        seen = edges.select(F.col("request_key").alias("_k"), F.col("cookie").alias("_c")).join(latest_answers(came, True).select(F.col("_key").alias("_k"), F.col("_cookie").alias("_c"), "_at"), ["_k", "_c"]).groupBy("_k", "_c").agg(F.max("_at").cast("timestamp").alias("at"))
        timed = steps.join(seen, (F.col("request_key") == F.col("_k")) & (F.col("cookie") == F.col("_c")), "left")
        put(timed.select(*(f.split()[0] for f in ANSWERS.split(", ") if f.split()[0] in timed.columns)), "answers", i, ANSWERS)
        every = part("answers", ANSWERS, f"batch <= {i}")
        if keep is not None and now is not None:
            every = every.where(F.col("at").isNull() | (F.col("at") >= F.lit(now) - F.expr(f"interval {keep}")))
        latest = every.groupBy("request_key", "cookie").agg(F.max_by(F.struct("step", "set_cookies"), F.struct("at", "batch")).alias("r")).select("request_key", "cookie", "r.*")
        names = [f.split()[0] for f in WAITING.split(", ") if f.split()[0] in ("link_id", "ts", "href", "own_removed", "s", "jar")]
        before = part("waiting", WAITING, f"batch = {i - 1}").select(*names)
        active = setting_out(new).select(*names).unionByName(before)
        # without cookies an answer doesn't depend on what came before, so links needn't be led hop by hop
        done, waiting = hops(active, latest, max_redirects, deadline_ms, True) if cookies else walked(active, written(latest, "latest"), max_redirects, deadline_ms)
        waiting = written(waiting, "waiting")
        over = (F.col("ts") + F.expr(f"interval {wait}") < F.lit(now).cast("timestamp")) if now is not None else F.lit(False)
        put(waiting.where(~over).select(*names), "waiting", i, WAITING)
        late = waiting.where(over).withColumn("s", F.col("s").withField("status", F.lit("TIMEOUT")).withField("error", F.lit(LATE_ERROR))).drop("jar")
        sink(records(as_results(done.unionByName(late))).unionByName(bad), i)

    return both.writeStream.foreachBatch(batch)


CACHED = "url string, request_id long, ts timestamp, hit boolean"
MAX_CACHED_BYTES = 16384


def cache_stream(requests: DataFrame, ttl_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """(url, request_id, ts, hit) of requests (url, request_id, ts, status, credentials_removed, result).

    Keeps the time of one stored result a URL: only RESOLVED, without credentials, of at
    most MAX_CACHED_BYTES of JSON; it counts for ttl_seconds of event time, after which the
    watermark ends the state.  Requests of a URL are taken in order of time within a batch;
    of each only time, id and whether it may be stored are held.
    """
    keep = (F.col("status") == "RESOLVED") & ~F.col("credentials_removed") & (F.octet_length(F.coalesce("result", F.lit(""))) <= MAX_CACHED_BYTES)
    slim = requests.withWatermark("ts", late).select("url", "request_id", "ts", F.coalesce(keep, F.lit(False)).alias("keep"))
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        every = pd.concat([b[["request_id", "ts", "keep"]] for b in batches]).sort_values(["ts", "request_id"])
        hits = []
        for r in every.itertuples():
            hit = at is not None and at + ttl > r.ts
            hits.append(hit)
            if not hit and r.keep:
                at = r.ts
        if at is not None:
            ends = (at + ttl).value // 1_000_000
            if ends > state.getCurrentWatermarkMs():
                state.update((at.value // 1000,))
                state.setTimeoutTimestamp(ends)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"url": key[0], "request_id": every["request_id"].to_numpy(), "ts": every["ts"].to_numpy(), "hit": hits})

    return slim.groupBy("url").applyInPandasWithState(serve, CACHED, "at long", "append", GroupStateTimeout.EventTimeTimeout)
