"""The result cache over a request log: as-of lookups, eviction, and how many links run at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.sources.tables import broadcast_if_small, written


def sliced(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows, written in stretches of the order, with _slice, which rises along it; equal ones apart, a stretch is a share of the rows, whatever keys they have."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()), label)


def carried(rows: DataFrame, keys: list[str], value: Column, over: Callable[[Column], Column]) -> DataFrame:
    """(keys, _slice, _before) of sliced rows: over(value) of all slices before each one, value being an aggregate of one; a row for each key of a slice."""
    sums = written(rows.groupBy(*keys, "_slice").agg(value.alias("_v")), "carry")
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return written(sums.select(*keys, "_slice", over(F.col("_v")).over(ahead).alias("_before")), "carry")


def with_carried(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Sliced rows with the _before of their slice and key; null keys are keys."""
    other = before.select(F.col("_slice").alias("_s"), *(F.col(k).alias(f"_{k}") for k in keys), "_before")
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(broadcast_if_small(other), same).drop("_s", *(f"_{k}" for k in keys))


def asof_cache(requests: DataFrame, cache: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """requests (request_id, url, ts) with the latest stored_at of the URL at or before ts, and whether it is a hit.

    A result that is exactly ttl old is no hit.  Both logs are laid out by URL and time in
    even slices; each carries the last result of the URL from those before it, so a URL of
    any share of the log is the work of many tasks.
    """
    both = requests.select("request_id", "url", "ts", F.lit(None).cast(cache.schema["stored_at"].dataType).alias("stored_at"), F.lit(1).alias("o")).unionByName(
        cache.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "url", F.col("stored_at").alias("ts"), "stored_at", F.lit(0).alias("o"))
    )
    rows = sliced(both, ["url", "ts", "o", "request_id"], "asof")
    before = carried(rows, ["url"], F.max("stored_at"), F.max)
    within = Window.partitionBy("_slice", "url").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_own", F.last("stored_at", ignorenulls=True).over(within)).where("o = 1").drop("stored_at")
    found = with_carried(told, before, ["url"]).withColumn("stored_at", F.coalesce("_own", "_before"))
    hit = F.coalesce(F.col("stored_at") + F.expr(f"interval {ttl}") > F.col("ts"), F.lit(False))
    return found.select("request_id", "url", "ts", F.when(hit, F.col("stored_at")).alias("stored_at"), hit.alias("hit"))


def cache_evict(cache: DataFrame, n: int) -> DataFrame:
    """The n most recently stored rows; ties by URL."""
    return cache.orderBy(F.col("stored_at").desc(), "url").limit(n)


def _most(moments: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The most links at once, by `by`, from moments (keys, at, o, d): d is added at each, in order of keys, at and o."""
    rows = sliced(moments.withColumn("_tie", F.xxhash64(*moments.columns)), [*keys, "at", "o", "_tie"], "moments")
    before = carried(rows, keys, F.sum("d"), F.sum)
    within = Window.partitionBy("_slice", *keys).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_n", F.sum("d").over(within))
    joined = with_carried(told, before, keys)
    return joined.groupBy(by).agg(F.max(F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias("most"))


def concurrency(requests: DataFrame, client_col: str = "client") -> DataFrame:
    """(client, most): the most links of each client that run at once, from (client, ts, end_ts); an end frees its place first.

    Sums run within even slices of the log, after what those before them leave running.
    """
    change = lambda at, d: requests.select(F.col(client_col).alias("client"), F.col(at).alias("at"), F.lit(d).alias("o"), F.lit(d).alias("d"))
    return _most(change("ts", 1).unionByName(change("end_ts", -1)), ["client"], F.col("client"))


def concurrency_overall(requests: DataFrame, bucket: str = "day") -> DataFrame:
    """(bucket, most): the most links at once in each stretch of time, over all clients, after all changes of a moment; no task holds the whole log."""
    change = lambda at, d: requests.select(F.col(at).alias("at"), F.lit(d).alias("d"))
    net = change("ts", 1).unionByName(change("end_ts", -1)).groupBy("at").agg(F.sum("d").alias("d"), F.lit(0).alias("o"))
    return _most(net, [], F.date_trunc(bucket, "at").cast("timestamp_ntz").alias("bucket"))
