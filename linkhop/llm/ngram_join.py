"""Jaccard join of word n-grams with adaptive multi-match prefixes.

Texts with one shingle set are one class, and only classes are joined.  All shingles of
all texts are counted, and the most common ones are known to every task by a table of a
fixed size; the others count as equally rare.  Shingles are ordered by these counts.  Two
sets of Jaccard likeness t or more share at least l shingles of their l-prefixes, the first
n - ceil(t * n) + l shingles; a class takes the l that makes its estimated cost least:
the postings under its prefix, and the candidates that share l of them.

Candidates are found in two ways.  First each class is held against the best of its
postings' hubs, so that a group of near copies becomes a component without being
paired.  Then every pair of classes in different components that shares enough of both
prefixes is verified, which makes the components whole.

All links then lie inside components.  A component of two classes has one; the classes of
a larger one are dealt into tiles, and each pair of tiles is one group of a task, which
counts what all of its sets share at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from linkhop.llm.common import documents, frugal, groups_of, mixed, one_of_equal, prepare, ragged, sized, tidy, with_keys, written
from linkhop.llm.components import components

#: Words of a shingle, and the threshold in hundredths.
WORDS, PERCENT = 5, 75
#: Cells of the table of common shingles (one byte each), and the most shingles that it is filled with.
CELLS, COMMON = 1 << 24, 2_000_000
#: A cell's byte is SCALE times the binary logarithm of its count and 1.
SCALE = 7
#: Shingles that a task sorts and counts at once.
COUNTED = 2_000_000
#: Bytes of text for each range of hashes that is counted in one task: about five million shingles.
RANGE_BYTES = 30_000_000
#: Postings of shingles that seem to be seen more often than this are aggregated row by row.
FULL = 255
#: The longest l, and the cost of verifying a candidate in postings.
MOST_L, VERIFY = 4, 20
#: Pairs left for each posting up to which no further round of hubs is made, the share of pairs that a round may leave for
#: another to follow, and the most rounds; hubs of a shingle from the second round on.
PAIRS_LEFT, KEPT, HUB_ROUNDS, HUBS = 16, 0.9, 8, 8
#: Candidates that meet one set in a task.
CHUNK = 64
MOST_BROADCAST = 400_000
#: Classes and shingles of a tile, about.
TILE, TILE_SHINGLES = 512, 500_000
#: Pairs of set members counted at once, and columns of a block of a matrix product.
PAIRS, COLUMNS = 500_000, 1024

_BASE = np.uint64(0x2545F4914F6CDD1D)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the base; as many as the longest word met has bytes."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 64), _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending within it, one text after another, and their numbers."""
    n_texts = len(texts)
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    stop = np.flatnonzero(space & np.append(False, ~space[:-1]))
    text = np.searchsorted(begins, first, side="right") - 1
    size = stop - first
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        values = (data[~space].astype(np.uint64) + np.uint64(1)) * powers(int(size.max(initial=0)))[within]
        word = mixed((np.add.reduceat(values, begin) if len(begin) else values) + size.astype(np.uint64))
        words = np.bincount(text, minlength=n_texts)
        ends = np.cumsum(words)
        # a shingle begins at a word with WORDS - 1 more after it, or at the first word of a shorter text
        at = np.arange(len(word))
        short = words[text] < WORDS
        starts = np.flatnonzero(np.where(short, at == (ends - words)[text], at + WORDS <= ends[text]))
        size = np.minimum(words[text[starts]], WORDS)
        shingle = size.astype(np.uint64) * _FACTORS[0]
        padded = np.append(word, np.zeros(WORDS, np.uint64))
        for j in range(WORDS):
            shingle += np.where(j < size, padded[starts + j] * _FACTORS[j] ^ padded[starts + j] >> np.uint64(j + 1), np.uint64(0))
            shingle = mixed(shingle)
    owner = text[starts]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])) if len(shingle) else np.zeros(0, bool)
    return shingle[new], np.bincount(owner[new], minlength=n_texts)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, numbers) of parts of a batch with a column text."""
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    for a, b in groups_of(texts):
        yield a, b, *shingle_sets(texts[a:b])


def _arrow(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], [c.split()[0] for c in schema.split(", ")])


MEASURED = "doc_id, k1 long, k2 long, n long, s1 long, s2 long, block int, cells binary"


def _counted_blocks(shingles: list[np.ndarray], ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, number, values and counts) of the distinct shingles, values being 32 bits of a shingle, ascending."""
    every = np.concatenate(shingles)
    low, high = every & np.uint64(0xFFFFFFFF), every >> np.uint64(32)
    keys, counts = np.unique((high % np.uint64(ranges)) << np.uint64(32) | low, return_counts=True)
    edges = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
    for r in np.flatnonzero(np.diff(edges)).tolist():
        values = keys[edges[r] : edges[r + 1]] & np.uint64(0xFFFFFFFF)
        # steps and counts byte by byte, as high bytes are mostly 0
        both = np.concatenate([np.diff(values, prepend=np.uint64(0)), counts[edges[r] : edges[r + 1]].astype(np.uint64)]).astype("<u4")
        yield r, len(values), pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _block_counts(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def _measure(ranges: int):
    """Rows to their set sizes and set hashes, and counts of shingles in blocks by range."""

    @frugal
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kind = pa.null()

        def counts() -> Iterator[pa.RecordBatch]:
            for r, n, data in _counted_blocks(held, ranges):
                yield _arrow(MEASURED, pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(2)), pa.array([n]), *(pa.nulls(1, pa.int64()) for _ in range(2)), pa.array([r], pa.int32()), pa.array([data]))
            held.clear()

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, b, shingles, n in _sets(batch):
                held.append(shingles)
                ends = np.cumsum(n)
                raw = shingles.tobytes()
                digest = b"".join(xxhash.xxh3_128_digest(raw[8 * (e - m) : 8 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True))
                s = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield _arrow(MEASURED, batch.column("doc_id").slice(a, b - a), k1[a:b], k2[a:b], n, np.ascontiguousarray(s[:, 0]), np.ascontiguousarray(s[:, 1]), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()))
                if sum(map(len, held)) > COUNTED:
                    yield from counts()
        if held:
            yield from counts()

    return measure


def _common(most: int):
    """Blocks of counts, those of a range in one task, to the range's most common shingles: at most `most`, each seen twice or more."""

    @frugal
    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(r: int) -> None:
            parts = ([sums[r]] if r in sums else []) + waiting.pop(r, [])
            sums[r] = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        for batch in batches:
            for r, n, data in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("cells"), strict=True):
                waiting.setdefault(r, []).append(_block_counts(n, data.as_py()))
                if sum(len(v) for v, _ in waiting[r]) > max(COUNTED, len(sums[r][0]) if r in sums else 0):
                    add(r)
        for r in [*waiting]:
            add(r)
        for values, counts in sums.values():
            least = 2 if len(counts) <= most else max(2, int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]) + 1)
            values, counts = values[counts >= least], counts[counts >= least]
            logs = np.minimum(np.rint(SCALE * np.log2(counts + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([(values & np.uint64(CELLS - 1)).astype("<u4").tobytes()]), pa.array([logs.tobytes()])], ["cells", "logs"])

    return common


def common_table(blocks: DataFrame, ranges: int) -> np.ndarray:
    """CELLS bytes, whatever the input: 0, or the logarithm of the count of a common shingle that falls into the cell."""
    out = np.zeros(CELLS, np.uint8)
    for row in blocks.repartition(ranges, "block").mapInArrow(_common(COMMON // ranges), "cells binary, logs binary").collect():  # COMMON shingles at most
        np.maximum.at(out, np.frombuffer(row["cells"], "<u4"), np.frombuffer(row["logs"], np.uint8))
    return out


#: A posting: the shingle's place in its class's order from 1, the l that the class has taken, and how common its prefix is.
POSTING = np.dtype([("token", "<u8"), ("c", "<i8"), ("n", "<i4"), ("place", "<i4"), ("l", "u1"), ("common", "u1")])
FIELDS = ["token", "c", "n", "place", "l", "common"]
LIVE = "token long, c long, n int, place int, l int, common int"
DEALT = f"part int, blob binary, {LIVE}"


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set that it links with."""
    return -(-n * PERCENT // 100)


def prefixes(shingles: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sets one after another: (shingle, set, place, l, count, mean count of the prefix) of the adaptive prefixes.

    counts: how often each shingle is seen, 0 for those that count as rare.
    """
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((shingles, counts, owner))
    shingles, counts = shingles[order], counts[order]
    place = np.arange(len(shingles)) - np.repeat(np.cumsum(n) - n, n) + 1
    overlap = least_overlap(n)
    base = n - overlap
    cost = np.append(0.0, np.cumsum(np.maximum(counts, 0.1)))
    begin = np.cumsum(n) - n
    # what a set of the same size asks for, as most candidates are near it in size
    alike = n - -(-2 * n * PERCENT // (100 + PERCENT))
    best, l = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, MOST_L + 1):
        postings = cost[begin + np.minimum(alike + k, n)] - cost[begin]
        total = np.where(k <= overlap, postings * (1 + VERIFY / k), np.inf)
        l[total < best] = k
        best = np.minimum(best, total)
    keep = place <= (base + l)[owner]
    owner, counts = owner[keep], counts[keep]
    common = np.bincount(owner, weights=counts, minlength=len(n)) / np.maximum(np.bincount(owner, minlength=len(n)), 1)
    return shingles[keep], owner, place[keep], l[owner], counts, common[owner]


def _postings(sketch, parts: int):
    """Rows (c, text) to postings: packed by part, those of full shingles row by row."""

    @frugal
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, np.uint8)
        seen = np.rint(2 ** (np.arange(256) / SCALE) - 1).astype(np.int64)
        for batch in batches:
            ids = batch.column("c").to_numpy()
            for a, _, shingles, n in _sets(batch):
                counts = seen[cells[shingles & np.uint64(CELLS - 1)]]
                token, owner, place, l, count, common = prefixes(shingles, n, counts)
                rows = np.empty(len(token), POSTING)
                for name, column in zip(FIELDS, (token, ids[a:][owner], n[owner], place, l, np.minimum(common, FULL)), strict=True):
                    rows[name] = column
                full = count > FULL
                hot, rows = rows[full], rows[~full]
                if len(hot):
                    part = (hot["c"] % parts).astype(np.int32)
                    yield _arrow(DEALT, part, pa.nulls(len(hot), pa.binary()), *_columns(hot))
                part = (rows["token"] >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                rows, part = rows[order], part[order]
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edges))
                blobs = [rows[edges[i] : edges[i + 1]].tobytes() for i in some.tolist()]
                m = len(some)
                if m:
                    yield _arrow(DEALT, some.astype(np.int32), pa.array(blobs, pa.binary()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), *[pa.int32()] * 4)))

    return post


@frugal
def _shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed postings of a part whose shingle has another posting, and all of full shingles."""
    blobs = []
    for batch in batches:
        packed = batch.column("blob").is_valid()
        blobs += batch.column("blob").filter(packed).to_pylist()
        loose = batch.filter(pc.invert(packed))
        if loose.num_rows:
            yield loose.select(FIELDS)
    rows = np.frombuffer(b"".join(blobs), POSTING)
    if not len(rows):
        return
    rows = rows[np.argsort(rows["token"], kind="stable")]
    same = rows["token"][1:] == rows["token"][:-1]
    rows = rows[np.append(same, False) | np.append(False, same)]
    for i in range(0, len(rows), 100_000):
        yield _arrow(LIVE, *_columns(rows[i : i + 100_000]))


def _columns(rows: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(rows["token"]).view(np.int64), np.ascontiguousarray(rows["c"]), *(rows[f].astype(np.int32) for f in FIELDS[2:])]


#: A class's set, and for each of PARTS parts of the hash range whether it holds an odd number of its shingles.
PARTS = 512
PARITY = [f"p{i}" for i in range(PARTS // 64)]
SETS = "c long, set binary, " + ", ".join(f"{p} long" for p in PARITY)


@frugal
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.column("c").to_numpy()
        for a, b, shingles, n in _sets(batch):
            raw, ends = shingles.tobytes(), np.cumsum(n)
            sets = [raw[8 * (e - m) : 8 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            owner = np.repeat(np.arange(b - a), n)
            part = (shingles >> np.uint64(32)).astype(np.int64) % PARTS
            odd = np.bincount(owner * PARTS + part, minlength=PARTS * (b - a)) & 1
            parity = np.packbits(odd.astype(np.uint8).reshape(-1, PARTS), axis=1).view(np.int64)
            yield _arrow(SETS, c[a:b], pa.array(sets, pa.binary()), *(np.ascontiguousarray(parity[:, i]) for i in range(len(PARITY))))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    both = len(a) + len(b)
    # sets of one size and the same members are one class, so any pair here differs
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= PERCENT * (both - shared)


@frugal
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, own, c, set) in this order, a's own set first, to links."""
    key, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            x = np.frombuffer(r["set"], np.uint64)
            if not r["other"]:
                key, own = (r["a"], r["chunk"]), x
            elif key == (r["a"], r["chunk"]) and linked(own, x):
                found.append((r["a"], r["c"]))
        if found:
            yield _arrow("a, b", *(np.array(c, np.int64) for c in zip(*found, strict=True)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  b's set goes to a's; what meets one a is dealt out in chunks."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = pairs.count()
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = pairs.join(sized(degree, n, MOST_BROADCAST), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / CHUNK)).cast("int").alias("chunk"))
    dealt = written(dealt, "pairs")
    heads = dealt.select("a", "chunk").distinct()
    first = sets.join(sized(heads.withColumnRenamed("a", "c"), n, MOST_BROADCAST), "c").select(F.col("c").alias("a"), "chunk", F.lit(False).alias("other"), "c", "set")
    others = sets.join(sized(dealt.withColumnRenamed("b", "c"), n, MOST_BROADCAST), "c").select("a", "chunk", F.lit(True).alias("other"), "c", "set")
    together = first.unionByName(others).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", "other")
    return written(together.mapInArrow(_verify, "a long, b long"), "verified")


def _meets(a: str = "", b: str = "2"):
    """Whether two postings of one shingle, with columns ...a and ...b, count for their pair.

    Sets of n and m shingles that link share o = ceil((n + m) * t / (1 + t)) or more, so at
    least l of the first n - o + l and of the first m - o + l; l is the smaller of both.
    """
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    o = F.floor(((n + m) * PERCENT + 99 + PERCENT) / (100 + PERCENT))
    l = F.least(f"l{a}", f"l{b}")
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & (F.col(f"place{a}") <= n - o + l) & (F.col(f"place{b}") <= m - o + l)


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Postings of shingles that are in more than one component, with the component."""
    named = written(_labelled(rows, label), "labelled")
    several = named.groupBy("token").agg(F.min("component").alias("m"), F.max("component").alias("x")).where("m <> x").select("token")
    return written(named.join(several, "token"), "open")


def spanning_links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of classes, not all of them; their components are those of all links.

    Each round of hubs names one class a shingle, and holds every class against the hub of
    another component that it shares most with, so that stragglers join large components by
    one verified pair.  Rounds end once few pairs are left or a round leaves most of them.
    """
    found: DataFrame | None = None
    # in the first round each class is a component of its own
    rows, before, more = live.withColumn("component", F.col("c")), 0.0, []
    for turn in range(HUB_ROUNDS):
        # hubs of a shingle are of its largest component; the first is the class whose prefix is most common, as a text is that others were made from
        carried = [F.col(x).alias(f"{x}2") for x in ("c", "n", "place", "l", "component", *more)]
        own = F.max(F.struct(F.lit(0) if turn else F.col("common"), F.xxhash64("c", F.lit(turn)), *carried)).alias("own")
        dealt = rows.groupBy("token", "component", F.pmod(F.xxhash64("c", F.lit(-turn)), F.lit(HUBS if turn else 1)).alias("slot")).agg(F.count("*").alias("k"), own)
        parts = dealt.groupBy("token", "component").agg(F.sum("k").alias("k"), F.collect_list("own").alias("owns"))
        hub = parts.groupBy("token").agg(F.max(F.struct("k", "owns")).alias("r")).select("token", F.explode("r.owns").alias("own"))
        hub = hub.select("token", *(f"own.{x}2" for x in ("c", "n", "place", "l", "component", *more)))
        differ = _differ() if more else F.lit(0)
        met = rows.join(hub, "token").where((F.col("component") != F.col("component2")) & _meets() & (_near() if more else F.lit(True)))
        best = met.groupBy("c", F.col("c2").alias("hub")).agg(F.min(differ).alias("differ"), F.count("*").alias("shared")).groupBy("c").agg(F.max(F.struct(-F.col("differ"), "shared", F.col("hub"))).alias("b"))
        pairs = written(best.select(F.col("b.hub").alias("a"), F.col("c").alias("b")), "hub-pairs")
        links = verified(pairs, sets)
        found = links if found is None else found.unionByName(links)
        # a shingle that is in one component stays so
        rows = _open(rows.drop("component"), components(found))
        if not more:
            more = PARITY
            rows = written(rows.join(sets.select("c", *PARITY), "c"), "open")
        # pairs that the last join would meet: those of other components than a shingle's main one with all
        counts = rows.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.max("k").alias("main"))
        left, n = counts.agg(F.coalesce(F.sum(F.col("all").cast("double") * (F.col("all") - F.col("main"))), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).head()
        if turn and (left <= PAIRS_LEFT * n or left > KEPT * before):
            break
        before = left
    # all pairs of classes that are in different components by now
    main = rows.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("b")).select("token", F.col("b.component").alias("main"))
    rows = written(rows.join(main, "token"), "open")
    few = rows.where("component <> main").select("token", *(F.col(x).alias(f"{x}2") for x in ("c", "n", "place", "l", "component", *PARITY)))
    pairs = rows.join(few, "token").where((F.col("component") != F.col("component2")) & ((F.col("component") == F.col("main")) | (F.col("c") < F.col("c2"))) & _meets() & _near())
    enough = pairs.groupBy("c", "c2").agg(F.count("*").alias("shared"), F.min(F.least("l", "l2")).alias("l")).where("shared >= l")
    last = verified(written(enough.select(F.col("c").alias("a"), F.col("c2").alias("b")), "last-pairs"), sets)
    return found.unionByName(last)


def _differ(a: str = "", b: str = "2"):
    """In how many parts of the hash range the parities of two sets, with columns ...a and ...b, differ: no more than they differ in members."""
    return sum((F.bit_count(F.col(f"{p}{a}").bitwiseXOR(F.col(f"{p}{b}"))) for p in PARITY), F.lit(0))


def _near(a: str = "", b: str = "2"):
    """Whether the parities of two sets leave them a way to link."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    o = F.floor(((n + m) * PERCENT + 99 + PERCENT) / (100 + PERCENT))
    return _differ(a, b) <= n + m - 2 * o


def _labelled(live: DataFrame, label: DataFrame) -> DataFrame:
    own = live.join(sized(label.select(F.col("node").alias("c"), "component"), label.count(), MOST_BROADCAST), "c", "left")
    return own.withColumn("component", F.coalesce("component", "c"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b."""
    na, nb = len(a), len(b)
    rows, columns = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    kinds, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    at_a, at_b = at[: len(rows)], at[len(rows) :]
    df_a, df_b = np.bincount(at_a, minlength=len(kinds)), np.bincount(at_b, minlength=len(kinds))
    # members of few sets are paired one by one, those of many are columns of matrices
    met = df_a * df_b
    many = 100 * met > na * nb
    out = np.zeros(na * nb, np.int64)
    order = np.argsort(at_b, kind="stable")
    begin = np.cumsum(df_b) - df_b
    few = np.flatnonzero(~many[at_a] & (met[at_a] > 0))
    ends = np.cumsum(df_b[at_a[few]])
    first = 0
    while first < len(few):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        part = few[first:end]
        lens = df_b[at_a[part]]
        out += np.bincount(np.repeat(rows[part], lens) * nb + columns[ragged(order, begin[at_a[part]], lens)], minlength=na * nb)
        first = end
    out = out.reshape(na, nb)
    place = np.cumsum(many) - 1
    of_a, of_b = np.flatnonzero(many[at_a]), np.flatnonzero(many[at_b])
    of_a, of_b = of_a[np.argsort(at_a[of_a], kind="stable")], of_b[np.argsort(at_b[of_b], kind="stable")]
    col_a, col_b = place[at_a[of_a]], place[at_b[of_b]]
    for c in range(0, int(many.sum()), COLUMNS):
        sides = []
        for n, owner, of, col in ((na, rows, of_a, col_a), (nb, columns, of_b, col_b)):
            some = slice(*np.searchsorted(col, (c, c + COLUMNS)))
            side = np.zeros((n, min(COLUMNS, int(many.sum()) - c)), np.float32)
            side[owner[of[some]], col[some] - c] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _links_of(one: list[tuple], two: list[tuple], same: bool, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (c, copies, set) of two tiles, or of one and itself: links (a, b), or (c, links) with copies."""
    if not one or not (two or same):
        return
    (ca, wa, a), (cb, wb, b) = ((np.array([r[0] for r in x]), np.array([r[1] for r in x]), [r[2] for r in x]) for x in (one, one if same else two))
    shared = overlaps(a, b)
    both = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
    link = 100 * shared >= PERCENT * (both - shared)
    if same:
        np.fill_diagonal(link, False)
    if pairs:
        i, j = np.nonzero(np.triu(link) if same else link)
        for k in range(0, len(i), 100_000):
            x, y = ca[i[k : k + 100_000]], cb[j[k : k + 100_000]]
            yield _arrow("a, b", np.minimum(x, y), np.maximum(x, y))
        return
    yield _arrow("c, links", ca, link @ wb)
    if not same:
        yield _arrow("c, links", cb, wa @ link)


def _tile_links(pairs: bool):
    """Rows (component, t, u, second, c, copies, set), those of a pair of tiles together, to what _links_of gives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = (None, 0, 0), ([], [])
        for batch in batches:
            for r in batch.to_pylist():
                new = (r["component"], r["t"], r["u"])
                if new != key:
                    yield from _links_of(*sides, key[1] == key[2], pairs)
                    key, sides = new, ([], [])
                sides[r["second"]].append((r["c"], r["copies"], np.frombuffer(r["set"], np.uint64)))
        yield from _links_of(*sides, key[1] == key[2], pairs)

    return read


def tiled(own: DataFrame, sizes: DataFrame, sets: DataFrame, n: int, pairs: bool) -> DataFrame:
    """All links (a, b) inside components of three classes or more, or per class c the rows it links with.

    A component of k classes has k / TILE tiles, so its sets are dealt out so many times.
    """
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = F.greatest(F.ceil(F.col("k") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    members = own.join(sized(sizes.where("k > 2"), n, MOST_BROADCAST), "component").select("component", "c", "copies", tiles.alias("tiles"))
    members = written(members, "members").withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("component", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), (F.col("tile") > F.col("other")).cast("int").alias("second"), "c", "copies")
    dealt = sets.join(sized(met, n, MOST_BROADCAST), "c").select("component", "t", "u", "second", "c", "copies", "set")
    together = dealt.repartition(parts, "component", "t", "u").sortWithinPartitions("component", "t", "u")
    return written(together.mapInArrow(_tile_links(pairs), "a long, b long" if pairs else "c long, links long"), "tiled")


def _sizes(own: DataFrame) -> DataFrame:
    """(component, k, shingles, rows, a, b) of components of two classes or more; a and b are the least and greatest."""
    grouped = own.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"), F.sum("copies").alias("rows"), F.min("c").alias("a"), F.max("c").alias("b"))
    return written(grouped.where("k > 1"), "sizes")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (doc_id, k1, k2, n, s1, s2), classes (c, s1, s2, copies, first, n, component), sets of classes that may link, number of classes.

    A class is known by the 128 bits (s1, s2) of its set, and by a number c of its own within a run.
    """
    spark = prepare(docs.sparkSession)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = documents(docs, id_col, text_col).toDF("doc_id", "text")
    keyed = kept.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    ranges = int(min(max(64, shuffles, size // RANGE_BYTES), COMMON // 16))
    measured = written(keyed.mapInArrow(_measure(ranges), MEASURED.replace("doc_id", f"doc_id {kind}", 1)), "measured")
    rows = measured.where("block is null").select("doc_id", "k1", "k2", "n", "s1", "s2")
    sketch = spark.sparkContext.broadcast(common_table(measured.where("block is not null").select("block", "n", "cells"), ranges).tobytes())
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    n_rows = rows.count()
    # rows that are equal first, as a class is read from one row
    texts = rows.where("n > 0").groupBy("s1", "s2", "k1", "k2").agg(F.count("*").alias("times"), F.min("doc_id").alias("first"), F.max("n").alias("n"))
    grouped = texts.groupBy("s1", "s2").agg(F.sum("times").alias("copies"), F.min("first").alias("first"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "times")).alias("r"))
    classes = written(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    # postings of one text a class: all texts but the other copies
    chosen = classes.select("r.k1", "r.k2", "r.times", "c")
    n_classes = classes.count()
    one = one_of_equal(keyed.select("k1", "k2", "text"), chosen, n_rows, MOST_BROADCAST).select("c", "text")
    parts = max(shuffles, 64, shingles // 5_000_000)
    live = written(one.mapInArrow(_postings(sketch, parts), DEALT).repartitionById(parts, F.col("part")).mapInArrow(_shared_postings, LIVE), "live")
    wanted = written(live.select("c").distinct(), "wanted")
    few = sized(wanted, wanted.count(), MOST_BROADCAST)
    reread = written(chosen.join(few, "c"), "reread")
    sets = written(one_of_equal(keyed.select("k1", "k2", "text"), reread, n_rows, MOST_BROADCAST).select("c", "text").mapInArrow(_set_rows, SETS), "sets")
    joined = written(components(spanning_links(live, sets)), "components")
    n_joined = joined.count()
    sketch.destroy()
    own = classes.join(sized(joined.withColumnRenamed("node", "c"), n_joined, MOST_BROADCAST), "c", "left").withColumn("component", F.coalesce("component", "c"))
    return rows, written(own.select("c", "s1", "s2", "copies", "first", "n", "component"), "own"), sets, n_classes


def _class_id() -> Column:
    """The 128 bits of a shingle set in hex."""
    return F.concat(*(F.lpad(F.hex(s), 16, "0") for s in ("s1", "s2")))


def joined_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2 (its key), n, component_id, class_id, copies, component (null without shingles), n_links (null unless links)."""
    rows, own, sets, n_classes = _classes(docs, id_col, text_col)
    names = own.groupBy("component").agg(F.min("first").alias("component_id"))
    table = own.join(sized(names, n_classes, MOST_BROADCAST), "component")
    if links:
        sizes = _sizes(own)
        n = sizes.count()
        more = tiled(own, sizes, sets, n_classes, False).groupBy("c").agg(F.sum("links").alias("links"))
        table = table.join(sized(sizes.select("component", "k", "rows"), n, MOST_BROADCAST), "component", "left").join(sized(more, n_classes, MOST_BROADCAST), "c", "left")
        others = F.when(F.col("k") == 2, F.col("rows") - F.col("copies")).otherwise(F.coalesce("links", F.lit(0)))
        table = table.withColumn("n_links", F.col("copies") - 1 + others)
    else:
        table = table.withColumn("n_links", F.lit(None).cast("long"))
    table = written(table.select("s1", "s2", "copies", "component_id", "component", "n_links"), "named")
    out = with_keys(rows.where("n > 0"), table, ["s1", "s2"], "copies", rows.count())
    none = lambda kind: F.lit(None).cast(kind)
    some = out.select("doc_id", "k1", "k2", "n", "component_id", _class_id().alias("class_id"), "copies", "component", "n_links")
    bare = rows.where("n = 0").select("doc_id", "k1", "k2", "n", F.col("doc_id").alias("component_id"), none("string").alias("class_id"), none("long").alias("copies"), none("long").alias("component"), F.lit(0 if links else None).cast("long").alias("n_links"))
    return some.unionByName(bare)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id, copies, n_links.

    component_id is the smallest doc_id that links reach from the row, itself included; a
    row with the same shingle set as another links with it.  A null text, an empty one and
    one without words have no shingles and link with nothing.  Null ids take part, but no
    component is named after one unless it has no other.  class_id names the shingle set
    and copies counts its rows (both null without shingles).  n_links counts the other rows
    that the row links with, those of its own class included.  Further columns are left out;
    an empty table gives an empty result.
    """
    return joined_rows(docs, id_col, text_col, True).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "copies", "n_links")


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All links (class_id, class_id2) between different shingle sets, each once with the smaller id first.

    ngram_components tells which rows are of a class; all of them link with each other and
    with all rows of a class that theirs links with.
    """
    _, own, sets, n_classes = _classes(docs, id_col, text_col)
    sizes = _sizes(own)
    links = sizes.where("k = 2").select("a", "b").unionByName(tiled(own, sizes, sets, n_classes, True))
    names = own.select("c", _class_id().alias("class_id"))
    first = links.join(sized(names.toDF("a", "class_id"), n_classes, MOST_BROADCAST), "a")
    return first.join(sized(names.toDF("b", "class_id2"), n_classes, MOST_BROADCAST), "b").select(F.least("class_id", "class_id2").alias("class_id"), F.greatest("class_id", "class_id2").alias("class_id2"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component, with the columns of docs.

    The row with the smallest id stays (null ids last); rows without shingles all stay.
    Texts are only shuffled where the keys of the rows that go are too many to broadcast.
    """
    rows = written(joined_rows(docs, id_col, text_col).select("doc_id", "k1", "k2", "component"), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")
    best = rows.where("component is not null").groupBy("component").agg(F.min(place).alias("b")).select("b.k1", "b.k2", F.lit(True).alias("stays"))
    keys = rows.where("component is not null").groupBy("k1", "k2").agg(F.count("*").alias("times"))
    going = written(keys.join(best, ["k1", "k2"], "left").where("stays is null or times > 1").select("k1", "k2", F.col("stays").isNotNull().alias("once")), "going")
    n = going.count()
    names, docs = docs.columns, tidy(docs, id_col, text_col)
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(F.lit(1), docs[id_col], docs[text_col]).alias("k1"), F.xxhash64(F.lit(2), docs[text_col], docs[id_col]).alias("k2"))
    marked = keyed.join(sized(going, n, MOST_BROADCAST), ["k1", "k2"], "left")
    single = marked.where("once is null").select("row.*")
    # of rows that are equal in id and text, one
    repeated = marked.where("once").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated).toDF(*names)
