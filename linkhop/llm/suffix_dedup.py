"""Removal of long repeated byte strings with a sparse, distributed suffix sort.

Every window of LENGTH bytes is filed under its anchor, the least hash of the K-byte
strings in it, so equal windows meet at equal anchors.  Windows of one anchor lie next
to each other; their bytes together are a passage.

1. Passages with equal bytes are one class.  A class of two or more is a repeat whole.
2. An anchor string with one class needs no more work.  For the others, one passage a
   class is read, and all passages of an anchor string meet: the suffixes from the anchor
   and the reversed prefixes before it are ordered by deep-shallow sorting, and their
   common prefixes give every stretch that two passages share.
3. An anchor string with more than GROUP classes is not gathered.  Its windows are halved
   by where the anchor lies in them; halves whose common bytes differ part, equal ones are
   counted as in 1, and what is left goes to 2 or is halved again, down to single windows,
   which are only counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from linkhop.llm.common import ARROW_ROWS, documents, frugal, mixed, one_of_equal, prepare, with_keys, written
from linkhop.llm.deep_shallow import shared_stretches

#: Bytes of a repeat, of an anchor string, and classes of an anchor string that are sorted in one task.
LENGTH, K, GROUP = 400, 64, 128
#: Keys of texts, 16 bytes each, up to which they are broadcast, so that only texts that are read or cut are shuffled.
MOST_BROADCAST = 400_000
#: Windows that are looked at together; a longer text is cut, its passages at the cuts too.
SEGMENT = 1_000_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POSITION = np.uint64((1 << 22) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window start (the leftmost least of its k-byte strings), and the hash of each k-byte string."""
    n = len(data) - k + 1
    if not _tables or len(_tables[0]) < len(data):
        size = max(len(data), SEGMENT + 2 * length)
        _tables[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables[1][: len(data)], dtype=np.uint64)])
        hashes = mixed((sums[k:] - sums[:-k]) * _tables[0][:n])
    # the low bits are the place, so that the leftmost of equal ones is the least
    keys = (hashes & ~_POSITION) | np.arange(n, dtype=np.uint64)
    w = length - k + 1
    starts = n - w + 1
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    return (least & _POSITION).astype(np.int64), hashes


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of about SEGMENT windows with (row, offset in the text, offset in the buffer) of their pieces."""
    held, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if held and size + len(piece) > SEGMENT + length:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
            pieces.append((row, at, size))
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held), pieces


PASSAGES = "k1 long, k2 long, start long, n int, anchor int, kh long, c1 long, c2 long"


def _passages(length: int, k: int):
    """Rows (k1, k2, text) to their passages: first window, number of windows, the anchor's offset, hashes of anchor string and bytes."""

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for data, pieces in _segments(texts, length):
                raw = np.frombuffer(data, np.uint8)
                anchor, hashes = anchors(raw, length, k)
                begins = np.array([p[2] for p in pieces])
                ends = np.append(begins[1:], len(raw))
                edge = np.zeros(len(anchor) + 1, bool)
                edge[1:-1] = anchor[1:] != anchor[:-1]
                edge[0] = edge[-1] = True
                edge[begins] = True
                last = np.minimum(ends - length + 1, len(anchor))  # windows may not leave their text
                edge[last] = True
                runs = np.flatnonzero(edge)
                first, stop = runs[:-1], runs[1:]
                piece = np.searchsorted(begins, first, side="right") - 1
                keep = first < last[piece]
                first, stop, piece = first[keep], stop[keep], piece[keep]
                row, offset = (np.array([p[i] for p in pieces])[piece] for i in (0, 1))
                digests = b"".join(xxhash.xxh3_128_digest(data[a : b + length - 1]) for a, b in zip(first.tolist(), stop.tolist(), strict=True))
                c = np.frombuffer(digests, np.int64).reshape(-1, 2)
                at = anchor[first]
                columns = [k1[row], k2[row], offset + first - begins[piece], (stop - first).astype(np.int32), (at - first).astype(np.int32), hashes[at].view(np.int64), c[:, 0], c[:, 1]]
                for i in range(0, len(first), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 50_000])) for x in columns], ["k1", "k2", "start", "n", "anchor", "kh", "c1", "c2"])

    return find


def _read(length: int):
    """Rows (text, wanted) to the bytes of the wanted passages."""

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["k1", "k2", "text", "wanted"]).to_pylist():
                out = [[row["k1"], row["k2"], w["start"], w["n"], w["anchor"], w["kh"], w["copies"], row["text"][w["start"] : w["start"] + w["n"] + length - 1]] for w in row["wanted"]]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                for i in range(0, len(out), ARROW_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + ARROW_ROWS], strict=True), types, strict=True)], ["k1", "k2", "start", "n", "anchor", "key", "copies", "data"])

    return read


#: A passage in hand: from where it is, with how many windows, where its anchor is, under which key it meets others, and how often it occurs.
ITEM = "k1 long, k2 long, start long, n int, anchor int, key long, copies long, data binary"
SPAN = "k1 long, k2 long, from long, to long"


def _sorted_groups(length: int):
    """Items that are grouped by key to the stretches that they share; only for items that occur once."""

    @frugal
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    found += _shared(group, length)
                    key, group = row["key"], []
                group.append(row)
            if found:
                yield _spans(found)
        if found := _shared(group, length):
            yield _spans(found)

    return resolve


def _shared(group: list[dict], length: int) -> list[tuple]:
    if len(group) < 2:
        return []
    stretches = shared_stretches([(r["data"], r["anchor"]) for r in group], length)
    return [(r["k1"], r["k2"], r["start"] + a, r["start"] + b) for r, s in zip(group, stretches, strict=True) if r["copies"] == 1 for a, b in _merged(s)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k1", "k2", "from", "to"])


def _halves(length: int, k: int, width: int):
    """Items to their windows whose anchor lies `width` or fewer apart, each under the hash of the bytes that all such windows hold."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # a window that starts o bytes before the anchor, o from anchor - n + 1 to anchor
                low, high = r["anchor"] - r["n"] + 1, r["anchor"]
                for d in range(low // width, high // width + 1):
                    o0, o1 = max(low, d * width), min(high, d * width + width - 1)
                    start = r["anchor"] - o1  # in data
                    data = r["data"][start : r["anchor"] - o0 + length]
                    # bytes that every window of this stretch of offsets has, around the anchor
                    core = r["data"][r["anchor"] - d * width : r["anchor"] + max(k, length - d * width - width + 1)]
                    key = xxhash.xxh3_64_intdigest(core, seed=d) - (1 << 63)
                    c = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist()
                    out.append([r["k1"], r["k2"], r["start"] + start, o1 - o0 + 1, o1, key, r["copies"], data, *c])
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["k1", "k2", "start", "n", "anchor", "key", "copies", "data", "c1", "c2"])

    return halve


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """Spans [from, to) of all bytes under repeated strings, by text key, for docs (k1, k2, text binary)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = written(docs.mapInArrow(_passages(length, k), PASSAGES), "passages")
    n = every.count()
    strings = written(every.groupBy("kh").agg(F.count("*").alias("rows"), (F.min("c1") != F.max("c1")).alias("several")).where("rows > 1").select("kh", "rows", "several"), "anchors")
    met = written(with_keys(every, strings, ["kh"], "rows", n).drop("rows"), "met")
    classes = written(
        met.groupBy("kh", "c1", "c2", "several").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start", "n", "anchor")).alias("r")).select("kh", "c1", "c2", "several", "copies", "r.*"), "classes"
    )
    # 1. whole classes; equal bytes have one anchor string
    whole = with_keys(met.drop("several"), classes.where("copies > 1").select("kh", "c1", "c2", "copies"), ["kh", "c1", "c2"], "copies", n)
    found = [whole.select("k1", "k2", F.col("start").alias("from"), (F.col("start") + F.col("n") + length - 1).alias("to"))]
    # 2. one passage of each class whose anchor string has several
    item = F.struct("start", "n", "anchor", "kh", "copies")
    wanted = written(classes.where("several").groupBy("k1", "k2").agg(F.collect_list(item).alias("wanted")), "wanted")
    # equal rows are read once; their passages stand in `copies`
    texts = written(docs.groupBy("k1", "k2").agg(F.count("*").alias("times")), "texts")
    n_texts = texts.agg(F.coalesce(F.sum("times"), F.lit(0))).head()[0]
    keys = written(texts.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi"), "keys")
    # texts that nothing is read from stay where they are
    readable = one_of_equal(docs, keys, n_texts, MOST_BROADCAST).join(wanted, ["k1", "k2"])
    items = written(readable.mapInArrow(_read(length), ITEM), "items")
    width = 1 << (length - k).bit_length()
    names = [c.split()[0] for c in ITEM.split(", ")]
    while True:
        n = items.count()
        keys = written(items.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1"), "keys")
        told = with_keys(items, keys, ["key"], "classes", n)
        rest = told.where(F.col("classes") <= group).select(*names)
        found.append(written(rest.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length), SPAN), "shared"))
        if keys.where(F.col("classes") > group).isEmpty():
            break
        # 3. halve the windows of the others
        width //= 2
        halves = written(told.where(F.col("classes") > group).select(*names).mapInArrow(_halves(length, k, width), ITEM + ", c1 long, c2 long"), "halves")
        n = halves.count()
        same = written(halves.groupBy("key", "c1", "c2").agg(F.sum("copies").alias("all"), F.count("*").alias("items"), F.min(F.struct("k1", "k2", "start")).alias("r")), "same")
        again = with_keys(halves.where("copies = 1"), same.where("items > 1").select("key", "c1", "c2", "items"), ["key", "c1", "c2"], "items", n)
        found.append(written(again.select("k1", "k2", F.col("start").alias("from"), (F.col("start") + F.col("n") + length - 1).alias("to")), "shared"))
        if width == 1:
            break
        several = written(same.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
        one = with_keys(same, several, ["key"], "kinds", n).select("key", "c1", "c2", F.col("all").alias("copies"), "r.*")
        items = written(halves.drop("copies").join(one, ["key", "c1", "c2", "k1", "k2", "start"]).select(*names), "items")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def _cut(schema: T.StructType):
    """Rows (doc_id, text, spans) to what is left of the text."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            out = []
            for text, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                merged = _merged([(s["from"], s["to"]) for s in spans or ()])
                if merged:
                    edges = [0, *(e for s in merged for e in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    kept = text
                out.append((len(text), len(text) - len(kept), len(merged), kept))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], schema.names)

    return cut


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the
    same text or another, overlaps included; strings are those of the input and don't
    cross texts.  A null text counts as empty; texts shorter than `length` stay whole; a
    repeated row is a second copy, so both lose what they share.  Null ids are ids like
    others.  Further columns are left out; an empty table gives an empty result.

    Hashes of passages, about one for every 170 bytes, are grouped; texts are shuffled
    twice by key, to read passages and to cut.  Copies are counted, not paired.
    """
    prepare(docs.sparkSession)
    kept = documents(docs, id_col, text_col).toDF("doc_id", "text")
    keyed = kept.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"))
    spans = repeated_spans(keyed.select("k1", "k2", "text"), length)
    by_text = written(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans")
    schema = T.StructType([keyed.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    keys = written(by_text.select("k1", "k2", F.lit(True).alias("_cut")), "cut")
    if keys.count() <= MOST_BROADCAST:
        # texts that keep all their bytes aren't shuffled
        marked = keyed.join(F.broadcast(keys), ["k1", "k2"], "left")
        whole = marked.where("_cut is null").select("doc_id", "text", F.lit(None).cast(by_text.schema["spans"].dataType).alias("spans"))
        joined = whole.unionByName(marked.where("_cut").join(by_text, ["k1", "k2"]).select("doc_id", "text", "spans"))
    else:
        joined = keyed.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(schema), schema)


def repeats_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """without_repeats with kept_sha256, the digest of the bytes that stay, in place of them."""
    rows = without_repeats(docs, length, id_col, text_col)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
