"""What the corpus operators share: the shared folder, batch limits, ragged gathers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows and bytes of one Arrow batch; texts may be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 4_000_000
#: Characters that a task's numpy helpers take at once.
BATCH_CHARS = 500_000
#: A table of at most so many rows of fixed width is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: A key with more than a HOT_KEYS-th of all rows is hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, as texts may be long; the session keeps these limits, as results are computed after the call."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        # a size may bear a unit, as in 64MB
        if not 0 < (int(now) if (now := spark.conf.get(key)).lstrip("-").isdigit() else 1 << 62) <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        global _own
        _own = _own or tempfile.mkdtemp(prefix="linkhop-")
        found = _own
    return found.rstrip("/")


_own = ""


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/linkhop/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], times: str, n: int, most: int = HOT_KEYS) -> DataFrame:
    """rows joined with keys, a written table which holds each key once and in its column `times` how many rows bear it; n is the number of rows.

    At most `most` keys are broadcast.  Of more, the hot ones, fewer than HOT_KEYS whatever
    the input, are broadcast, so their rows stay where they are; of the others none has more
    than a HOT_KEYS-th of the rows, and they are shuffled.
    """
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), on)
    hot = F.col(times) > n // HOT_KEYS
    more = [c for c in keys.columns if c not in on]
    held = F.broadcast(keys.where(hot).select(*on, F.struct(F.lit(True).alias("_hot"), *more).alias("_own")))
    marked = rows.join(held, on, "left")
    here = marked.where("_own is not null").select(*rows.columns, *(F.col(f"_own.{c}").alias(c) for c in more))
    return here.unionByName(marked.where("_own is null").drop("_own").join(keys.where(~hot), on))


def one_of_equal(rows: DataFrame, keys: DataFrame, n: int, most: int = HOT_KEYS) -> DataFrame:
    """rows (k1, k2, ...) joined with keys, a written table (k1, k2, times, ...) as in with_keys, with one row for each key.

    Rows of one key are equal.  Where a key has several, each task keeps one of its own
    before the shuffle, so that a row with any number of copies costs one a task.
    """
    met = with_keys(rows, keys, ["k1", "k2"], "times", n, most)
    if keys.where("times > 1").isEmpty():
        return met.drop("times")
    several = met.where("times > 1")
    first = several.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in several.columns if c not in ("k1", "k2", "times")))
    return met.where("times = 1").drop("times").unionByName(first)


def numbered(rows: DataFrame, groups: list[str], order: list[Column], label: str) -> DataFrame:
    """rows, a written table, with `position`: gapless from 0 in each group (non-null keys), by `order`, in which no two rows of a group may be equal.

    Rows are dealt out in stretches of the order and each stretch numbers its own, after
    how many the stretches before it hold; these sums are a row for each group of a stretch.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *map(F.col, groups), *order).withColumn("_part", F.spark_partition_id()), label)
    counts = written(dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n")), label)
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order))
    told = dealt.withColumn("_place", place).join(sized(before, counts.count()), [*groups, "_part"])
    return told.withColumn("position", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def frugal(task: Callable) -> Callable:
    """A task over Arrow batches that gives what its arrays held back to the machine, as Python workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def tidy(docs: DataFrame, *keys: str) -> DataFrame:
    """docs with names that differ in more than case: the columns `keys` keep theirs, others that clash get _2, _3 and so on."""
    names = docs.columns
    at = {}
    for key in keys:
        fits = [i for i, c in enumerate(names) if c == key] or [i for i, c in enumerate(names) if c.lower() == key.lower()]
        if fits:  # else the select that names the column says that it is missing
            at[fits[0]] = names[fits[0]]
    out, taken = [], {c.lower() for c in at.values()}
    for i, c in enumerate(names):
        n = 2
        name = c
        while i not in at and name.lower() in taken:
            name, n = f"{c}_{n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return docs if out == names else docs.toDF(*out)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no others, so that further columns can't clash."""
    kept = tidy(docs, *columns)
    return kept.select(*(kept[c] for c in columns))


def groups_of(texts, most: int = BATCH_CHARS):
    """(first, end) of runs of texts with at most that many characters, or one text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[s:s + n] of all (s, n), one after another."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return values[at]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64).copy()
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E6C63D0876A9A47)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(32)
    return x
