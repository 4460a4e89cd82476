"""Lempel-Ziv phrase fingerprints.

A text is parsed once from left to right into the phrases of a growing dictionary: a
phrase is the longest one known so far and one more code point.  Phrases are hashed as
they are added, and the least hashes of the set are the fingerprint.  The likeness of
two fingerprints estimates the Jaccard likeness of the phrase sets, which is high
where one text helps to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import documents, frugal, mixed, prepare, tidy

#: Hashes of a fingerprint, each of 32 bits.
HASHES = 64
_POINT = 1 << 21  # above all code points
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
REPORT = [
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
]


def _parse(text: str, phrases: dict[int, int], node: int) -> int:
    """Parses on from the phrase `node`; phrases maps a phrase and a code point to the longer phrase, numbered in steps of _POINT."""
    get = phrases.get
    free = (len(phrases) + 1) * _POINT
    for c in text.encode() if text.isascii() else memoryview(text.encode("utf-32-le")).cast("I"):
        key = node + c
        node = get(key)
        if node is None:
            phrases[key] = free
            free += _POINT
            node = 0
    return node


def _least(phrases: dict[int, int]) -> np.ndarray:
    """The least hashes of a phrase set, ascending.

    The hash of a phrase is a polynomial of its code points: a value and a factor for what
    stands before them; both are doubled along the phrases that each phrase was made from.
    """
    keys = np.fromiter(phrases, np.int64, len(phrases))
    before = np.append(0, keys >> 21)
    with np.errstate(over="ignore"):
        value = np.append(0, (keys & (_POINT - 1)) + 1).astype(np.uint64)
        factor = np.full(len(before), _ODD)
        factor[0] = 1
        while before.any():
            value = value + factor * value[before]
            factor = factor * factor[before]
            before = before[before]
    hashes = (mixed(value[1:]) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * HASHES:
        hashes = np.partition(hashes, 3 * HASHES)[: 3 * HASHES]
    return np.unique(hashes)[:HASHES]


def signature(text: str) -> np.ndarray:
    phrases: dict[int, int] = {}
    _parse(text, phrases, 0)
    return _least(phrases)


def signatures_of_edit(text: str, kept: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of text and of text[:kept] + tail; the shared start is parsed once."""
    phrases: dict[int, int] = {}
    node = _parse(text[:kept], phrases, 0)
    shared = len(phrases)
    _parse(text[kept:], phrases, node)
    own = _least(phrases)
    while len(phrases) > shared:
        phrases.popitem()
    _parse(tail, phrases, node)
    return own, _least(phrases)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the least hashes of both sets together that both hold; 1 for two empty texts."""
    union = np.union1d(a, b)[:HASHES]
    return float(np.isin(union, a).sum() + np.isin(union, b).sum() - len(union)) / len(union) if len(union) else 1.0


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def from_text(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint or ""), ">u4").astype(np.uint32)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of each text (null: an empty text): '' for an empty text, equal for equal texts."""

    @F.pandas_udf(T.StringType())
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([to_text(signature(t or "")) for t in rows], dtype=object)

    return fingerprint(text)


def likeness_column(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(from_text(x), from_text(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return like(a, b)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with each text's fingerprint as column out_col, which replaces one of that name."""
    prepare(docs.sparkSession)
    docs = tidy(docs, text_col)
    return docs.withColumn(out_col, fingerprint_column(docs[text_col]))


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """The first (doc_id, tie) of each of at most `parts` stretches of rows in the order of (doc_id nulls last, tie), found by range partitioning of these two columns alone."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tie")).alias("f")
    dealt = rows.select("doc_id", "tie").repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "tie")
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(first).collect()  # one row a stretch
    return sorted((r["f"]["null"], r["f"]["doc_id"] or 0, r["f"]["tie"]) for r in found)


def _stretch(doc_id: Column, tie: Column, bounds: list[tuple]) -> Column:
    """The number of the stretch that a row falls into, by binary search over the bounds."""
    some = [b for b in bounds if not b[0]]
    ids, ties = (np.array([b[i] for b in some], np.int64) for i in (1, 2))
    null_ties = np.array([b[2] for b in bounds if b[0]], np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(rows: pd.Series, tie: pd.Series, null: pd.Series) -> pd.Series:
        x, t, none = rows.to_numpy(np.int64), tie.to_numpy(np.int64), null.to_numpy(bool)
        out = np.searchsorted(ids, x, side="left")
        end = np.searchsorted(ids, x, side="right")
        for i in np.unique(out[(end > out) & ~none]).tolist():  # an id that bounds begin with
            at = np.flatnonzero((out == i) & (end > i))
            out[at] = i + np.searchsorted(ties[i : end[at[0]]], t[at], side="right")
        out[none] = len(ids) + np.searchsorted(null_ties, t[none], side="right")
        return pd.Series(np.maximum(out - 1, 0).astype(np.int32))

    return find(F.coalesce(doc_id.cast("long"), F.lit(0)), tie, doc_id.isNull())


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and the next document, by ascending id.

    One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The edited text is the text with its last
    floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document; after the last comes the first, so a table's only row is next to itself.

    A null text counts as empty; null ids come last; rows with one id, or with null ids,
    follow each other by a hash of the text, so a hot id is dealt out like others (rows equal
    in id and text share a task, which holds one of them at a time).  Further columns are
    left out; an empty table gives an empty result.  Ids are compared as longs.  Texts are
    shuffled once, into stretches of ids; the first row of a stretch is also sent to the
    stretch before, so no row waits for another task.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *REPORT])
    bounds = _bounds(rows, parts)
    if not bounds:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("part", _stretch(F.col("doc_id"), F.col("tie"), bounds))
    before = [(None if null else doc_id, tie, (i or len(bounds)) - 1) for i, (null, doc_id, tie) in enumerate(bounds)]
    ahead = F.broadcast(spark.createDataFrame(before, f"a_id {kind}, a_tie long, a_part int"))  # one row a stretch
    tagged = rows.join(ahead, rows.doc_id.eqNullSafe(ahead.a_id) & (rows.tie == ahead.a_tie), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("a_part").alias("part"), F.lit(True).alias("ahead"))
    sent = tagged.select("doc_id", "tie", "text", F.explode(F.when(F.col("a_part").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to")).select("to.part", "to.ahead", "doc_id", "tie", "text")
    dealt = sent.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "tie")

    return dealt.mapInArrow(_reporter(schema), schema)


def _reporter(schema: T.StructType):
    names = schema.names

    @frugal
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list | None = None  # the row before, whose next row is the one at hand
        done: list[list] = []
        part_now = None
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for part, is_ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
                if part != part_now:
                    waiting, part_now = None, part
                if waiting is not None:
                    # the row before can be edited now; its likeness to this one needs this one's signature
                    w_id, w_text = waiting
                    n = len(w_text)
                    kept, tail = n - n // 4, text[: n // 4]
                    own, edited = signatures_of_edit(w_text, kept, tail)
                    digest = hashlib.sha256((w_text[:kept] + tail).encode()).hexdigest()
                    if done and done[-1][-1] is None:
                        done[-1][-1] = likeness(done[-1][-2], own)
                    done.append([w_id, n, digest, to_text(own), to_text(edited), likeness(own, edited), own, None])
                if is_ahead:
                    if done and done[-1][-1] is None:
                        done[-1][-1] = likeness(done[-1][-2], signature(text))
                    waiting = part_now = None
                else:
                    waiting = (doc_id, text)
            ready = [d for d in done if d[-1] is not None]
            done = done[len(ready) :]
            if ready:
                columns = list(zip(*((*d[:6], d[7]) for d in ready), strict=True))
                types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return report
