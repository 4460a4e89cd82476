"""Exact top-k search by no-random-access aggregation.

A block of vectors keeps one sorted list per component.  For a query, list d is read
from the end that the sign of its component favours, all lists equally deep.  What has
been read of a vector gives its score a lower and an upper bound: an unread component
lies between the last value read of its list and the list's far end.  Vectors whose
upper bound stays under the k-th best lower bound, of the block or of the blocks before
it, go; reading goes on in small steps for the rest, until no outsider can qualify.
Then the scores of the few that are left are resolved.

The depth from which the bounds of few vectors are left open depends on the data, so
each task begins where its last block got there, or a step before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.llm.common import documents, prepare

#: Vectors of a block, queries of a block, and blocks that a task holds at once, about.
BLOCK, QUERIES, HELD = 2048, 256, 8
#: Lists are read in steps of a STEPS-th of their length; bounds are found pair by pair once one pair in FEW is left.
STEPS, FEW = 32, 32
#: Integers that float64 holds exactly.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component as array<long>; null where the vector is null or holds a null or non-finite component.

    What leaves the range of a long is held at its ends.
    """
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # 2 ** 63 - 1024 is the last double under the end of a long
    held = lambda x: F.greatest(F.least(x.cast("double") * 256, F.lit(float(MOST - 1023))), F.lit(float(LEAST)))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(held(x)).cast("long")))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """rows (vec_id, v) as blocks: ids and a matrix of `dims` columns, shorter vectors filled up with 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []

        def full() -> pa.RecordBatch:
            dims = max(map(len, vectors))
            x = np.zeros((len(ids), dims), np.int64)
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.tobytes()]), pa.array([dims], pa.int32())], ["ids", "x", "dims"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += [v.values.to_numpy() if v.values is not None else np.zeros(0, np.int64) for v in batch.column("v")]
            while len(ids) >= block:
                rest_ids, rest = ids[block:], vectors[block:]
                ids, vectors = ids[:block], vectors[:block]
                yield full()
                ids, vectors = rest_ids, rest
        if ids:
            yield full()

    return rows.mapInArrow(pack, "ids binary, x binary, dims int").withColumn("block", F.monotonically_increasing_id())


class Lists:
    """The sorted lists of a block and each vector's place in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        self.whole = x  # as integers
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, order, 0)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], 0)
        self.reach = np.abs(self.x).max(0, initial=0)

    def ends(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What unread components lie between after `depth` entries: for lists read from the top (least, most), from the bottom (least, most)."""
        n = len(self.ids)
        return self.sorted[0], self.sorted[n - depth], self.sorted[depth - 1], self.sorted[-1]

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of q's scores with all vectors, after `depth` entries of each list."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        both = np.hstack([up, down]).T
        low_top, high_top, low_bottom, high_bottom = self.ends(depth)
        from_top, from_bottom = self.place >= len(self.ids) - depth, self.place < depth
        least = np.hstack([np.where(from_top, self.x, low_top), np.where(from_bottom, self.x, high_bottom)]) @ both
        most = np.hstack([np.where(from_top, self.x, high_top), np.where(from_bottom, self.x, low_bottom)]) @ both
        return least.T, most.T

    def bounds_of(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs of a query i and a vector j."""
        low_top, high_top, low_bottom, high_bottom = self.ends(depth)
        qi, xj, place = q[i], self.x[j], self.place[j]
        top = qi > 0
        read = np.where(top, place >= len(self.ids) - depth, place < depth)
        least = np.einsum("ij,ij->i", qi, np.where(read, xj, np.where(top, low_top, high_bottom)))
        most = np.einsum("ij,ij->i", qi, np.where(read, xj, np.where(top, high_top, low_bottom)))
        return least, most

    def resolved(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, held at the ends of a long."""
        if (np.abs(q).max(0, initial=0).astype(np.float64) * self.reach).sum() < EXACT:
            return np.einsum("ij,ij->i", q[i].astype(np.float64), self.x[j]).astype(np.int64)
        scores = (sum(a * b for a, b in zip(q[m].tolist(), self.whole[n].tolist(), strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True))
        return np.array([min(max(s, LEAST), MOST) for s in scores], np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    return np.partition(scores, n - k, 1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def _limit(scores: np.ndarray) -> np.ndarray:
    """Scores to reach, as they compare once held at the ends of a long."""
    return np.where(scores <= LEAST, -np.inf, np.minimum(scores, float(MOST)))


def search_block(own: Lists, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of all that can be among a query's k best, entries read a query, and the step to begin with next time.

    floor: scores that k vectors of other blocks reach already (-inf: none).
    """
    n = len(own.ids)
    entries = lambda step: max(1, -(-n * step // STEPS))
    f = q.astype(np.float64)
    size = float((np.abs(f).max(0, initial=0) * own.reach).sum())
    # bounds that float64 rounds are widened by what rounding can take away
    slack = 0.0 if size < EXACT else size * (q.shape[1] + 2) * 2.0**-50
    same = own.ids[None, :] == q_ids[:, None]
    limit = floor.copy()
    step = first
    # while many are left, the bounds of all are found at once
    while True:
        least, most = own.bounds(f, entries(step))
        least[same] = -np.inf
        limit = np.maximum(limit, _limit(_kth(least, k) - slack))
        may = (most + slack >= limit[:, None]) & ~same
        if step == STEPS or may.sum() * FEW <= may.size:
            break
        step += max(1, (STEPS - step) // 3)
    begin = max(1, step - 1) if step == first else step
    i, j = np.nonzero(may)
    left = np.bincount(i, minlength=len(q))
    lists = (q != 0).sum(1)
    read = lists * entries(step)
    # then those of the pairs that are left, for queries with more of them than they ask for
    while step < STEPS and (left > k).any():
        step += 1
        on = left[i] > k
        a, b = i[on], j[on]
        low, high = own.bounds_of(f, a, b, entries(step))
        order = np.lexsort((-low, a))
        open_ = np.flatnonzero(left > k)
        kth = low[order][np.searchsorted(a[order], open_) + k - 1]
        limit[open_] = np.maximum(limit[open_], _limit(kth - slack))
        read[open_] = lists[open_] * entries(step)
        keep = high + slack >= limit[a]
        i, j = np.concatenate([i[~on], a[keep]]), np.concatenate([j[~on], b[keep]])
        left = np.bincount(i, minlength=len(q))
    return i, j, own.resolved(q, i, j), read, begin


def _kept(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, ~s, i))  # ~s falls as s rises, at the ends of a long too
    i, ids, s = i[order], ids[order], s[order]
    begins = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
    return i[rank < k], ids[rank < k], s[rank < k]


def _matrix(x: bytes, rows: int, dims: int, width: int) -> np.ndarray:
    """The packed matrix with `width` columns, those it lacks being 0."""
    out = np.zeros((rows, width), np.int64)
    out[:, :dims] = np.frombuffer(x, np.int64).reshape(rows, dims)
    return out


FOUND = "q_block long, q_row int, query_id long, vec_id long, score long, read long, entries long"


def _search(k: int):
    """Rows (g, q_block, block, ids, x, dims), a group's vectors first (q_block null), to each query's k best of the group.

    A row without vec_id tells how many of a group's list entries a query has had read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        first = STEPS // 4
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                if row["g"] != group:
                    group, held = row["g"], []
                if row["q_block"] is None:
                    held.append(Lists(ids, _matrix(row["x"], len(ids), row["dims"], row["dims"])))
                    continue
                best = (np.zeros(0, np.int64),) * 3
                floor = np.full(len(ids), -np.inf)
                read = np.zeros(len(ids), np.int64)
                entries = 0
                for own in held:
                    dims = own.x.shape[1]
                    q = _matrix(row["x"], len(ids), row["dims"], max(dims, row["dims"]))[:, :dims]  # components that the other side lacks count as 0
                    i, j, s, more, first = search_block(own, ids, q, floor, k, first)
                    read += more
                    entries += own.x.size
                    best = _kept(*(np.concatenate(c) for c in zip(best, (i, own.ids[j], s), strict=True)), k)
                    at, counts = np.unique(best[0], return_counts=True)
                    ends = np.cumsum(counts) - 1
                    # a float64 that is no greater than the score
                    floor[at[counts >= k]] = np.nextafter(best[2][ends[counts >= k]].astype(np.float64), -np.inf)
                i, found, s = best
                none = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(i) + none, row["q_block"], np.int64)), pa.array(np.concatenate([i, np.arange(none)]).astype(np.int32)), pa.array(np.concatenate([ids[i], ids])),
                        pa.array([*found.tolist(), *[None] * none], pa.int64()), pa.array([*s.tolist(), *[None] * none], pa.int64()),
                        pa.array([*[None] * len(i), *read.tolist()], pa.int64()), pa.array([*[None] * len(i), *[entries] * none], pa.int64()),
                    ],
                    [c.split()[0] for c in FOUND.split(", ")],
                )

    return search


def _searched(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, partitions: int | None) -> DataFrame:
    spark = prepare(vectors.sparkSession)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-vectors.count() // (BLOCK * HELD)))
    of = lambda df: documents(df, id_col, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    none = F.lit(None).cast("long")
    blocks = packed(of(vectors), BLOCK).select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), none.alias("q_block"), "ids", "x", "dims")
    asked = packed(of(queries), QUERIES).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("block").alias("q_block"), "ids", "x", "dims")
    dealt = blocks.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", F.col("q_block").asc_nulls_first())
    return dealt.mapInArrow(_search(k), FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """The k vectors with the highest inner product of quantised components for each row of queries.

    Both tables have id_col and vector_col.  Returns query_id, rank (from 1), vec_id,
    score (long); fewer than k rows where there are fewer vectors; ties go to smaller ids.
    Rows of vectors that bear the query's own id are no candidates.  Vectors that are null,
    or hold null or non-finite components, and null ids take no part on either side; a
    shorter vector counts as filled up with 0.  Scores are integer sums; a component or a
    score that leaves the range of a long is held at its end, where it ties.  A query row
    that occurs twice gets its results twice.  Further columns are ignored; empty tables
    give an empty result.

    Vectors are dealt into groups of about HELD blocks; a task holds one group and takes
    the queries block by block, so that its memory depends on neither table.  Queries are
    sent once a group.
    """
    found = _searched(vectors, queries, k, id_col, vector_col, partitions).where("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row", "query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def entries_read(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """(query_id, read, entries): how many list entries top_k reads for each row of queries, and how many there are."""
    found = _searched(vectors, queries, k, id_col, vector_col, partitions).where("vec_id is null")
    return found.groupBy("q_block", "q_row", "query_id").agg(F.sum("read").alias("read"), F.sum("entries").alias("entries")).select("query_id", "read", "entries")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, 1 + len(q.v))])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
