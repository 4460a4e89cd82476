"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash into buckets that fit in memory, one
bucket a task.  Pass two brings a bucket into a canonical order, shuffles it by
Fisher-Yates with a generator seeded by the bucket, and writes it.  The buckets one
after another are a uniform random order of all rows; shards are equal stretches of
it, so their counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from linkhop.llm.common import ARROW_ROWS, documents, frugal, new_path, prepare, sized, tidy, written

#: Bytes of text of a bucket, whatever the input.
BUCKET_BYTES = 16_000_000
#: Buckets whose counts are summed up in one task.
BLOCK = 4096
#: Equal rows with more than a SHARE-th of a bucket's bytes are dealt out one by one, CHUNK copies in a row.
SHARE, CHUNK = 8, 256


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform random order of n things; Generator.permutation is a Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def offsets_of(counts: DataFrame) -> DataFrame:
    """(bucket, offset): how many rows the buckets before each one of (bucket, n) hold, summed by block of buckets and then within each."""
    blocks = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("m"))
    sums = written(sums, "shard-blocks")  # one row for BLOCK buckets
    before = sums.select("block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("within", within).join(sized(before, sums.count()), "block").select("bucket", (F.col("before") + F.col("within")).alias("offset"))


def numbered_copies(rows: DataFrame, counted: bool = False) -> DataFrame:
    """Equal rows, each with an _order of its own that a rerun gives again; of counted rows there is one for m of them.

    Equal rows are counted, a task's own before the shuffle, and written out again from the
    counts, CHUNK by CHUNK, so no task holds or makes all copies of a row.
    """
    names = [c for c in rows.columns if c != "m"]
    counts = rows if counted else rows.groupBy(*names).agg(F.count("*").alias("m"))
    whole = F.struct(*names).alias("_row")
    chunks = counts.select(whole, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))).alias("_chunk"))
    dealt = chunks.repartition(F.col("_row._order"), F.col("_chunk"))
    first = F.col("_chunk") * CHUNK
    each = dealt.select("_row.*", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("m")) - 1)).alias("_copy"))
    return each.withColumn("_order", F.xxhash64("_order", "_copy")).drop("_copy")


def shard_rows(docs: DataFrame, path: str, shards: int = 24, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs in random order into `shards` Parquet folders under path and returns the table read back.

    Adds shard (int), slot (long, gapless from 0 in each shard) and bucket; columns of
    docs with these names (in any case) are left out, and of names that differ in case only
    the later ones get a number.  Nulls are rows like others.  A rerun gives the same order.
    An empty table gives an empty one.  Scattering is by the whole row, so neither a hot id
    nor a group of equal texts meets in one bucket; rows that are equal in all columns are
    interchangeable, and where they make more than a SHARE-th of a bucket they are counted
    and dealt out again one by one.  A bucket holds about bucket_bytes of text at every size;
    a table of many terabytes asks for larger ones where its executors have the memory.
    """
    spark = prepare(docs.sparkSession)
    own = {"shard", "slot", "bucket", "_order", "_offset"}
    docs = tidy(docs, id_col, text_col)
    rows = docs.select(*(docs[c] for c in docs.columns if c.lower() not in own))
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 8
    # maps have no hash of their own
    hashed = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema if f.name.lower() not in own]
    order = F.xxhash64(F.lit(seed), *hashed).alias("_order")
    alike = written(docs.select(order, size.cast("long").alias("size")).groupBy("_order").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")), "shard-alike")
    total = alike.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64("_order"), F.lit(buckets)).cast("int").alias("bucket")
    hot = written(alike.where((F.col("bytes") > bucket_bytes // SHARE) & (F.col("m") > 1)).select("_order"), "shard-hot")
    n_hot = hot.count()
    scattered = rows.withColumn("_order", order)
    if n_hot:
        held = sized(hot, n_hot).select("_order", F.lit(True).alias("_hot"))
        marked = scattered.join(held, "_order", "left")
        again = numbered_copies(marked.where("_hot").drop("_hot"))
        scattered = marked.where("_hot is null").select(*scattered.columns).unionByName(again.select(*scattered.columns))
        few = alike.join(held, "_order", "left")
        orders = few.where("_hot is null").select("_order", "m").unionByName(numbered_copies(few.where("_hot").select("_order", "m"), True).select("_order", F.lit(1).cast("long").alias("m")))
    else:
        orders = alike.select("_order", "m")
    counts = written(orders.groupBy(bucket).agg(F.sum("m").alias("n")), "shard-counts")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])

    @frugal
    def write_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # one row of each bucket says where it begins
        heads = table["_offset"].to_pandas()
        offsets = {int(b): int(at) for b, at in zip(table["bucket"].to_numpy(), heads, strict=True) if at == at}
        table = table.filter(pa.array(heads.isna().to_numpy())).drop_columns(["_offset"])
        all_buckets = table["bucket"].to_numpy()
        for b in np.unique(all_buckets).tolist():  # one, as buckets are dealt by their number
            at = np.flatnonzero(all_buckets == b)
            at = at[np.argsort(table["_order"].to_numpy()[at], kind="stable")]
            at = at[fisher_yates(len(at), seed, b)]
            for i in range(0, len(at), ARROW_ROWS):
                part = table.take(pa.array(at[i : i + ARROW_ROWS])).drop_columns(["_order"])
                position = offsets[b] + i + np.arange(part.num_rows)
                shard = position * shards // n
                first = -(-shard * n // shards)  # the first position whose shard this is
                part = part.append_column("slot", pa.array(position - first)).append_column("shard", pa.array(shard.astype(np.int32)))
                yield from part.combine_chunks().to_batches()

    heads = offsets_of(counts).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.lit(None).cast("long").alias("_order"), "bucket", F.col("offset").cast("long").alias("_offset"))
    dealt = scattered.select("*", bucket, F.lit(None).cast("long").alias("_offset")).unionByName(heads).repartitionById(buckets, F.col("bucket"))
    dealt.mapInArrow(write_order, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard_report(docs: DataFrame, shards: int = 24, seed: int = 7, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards docs and returns doc_id, size, text_crc32, law, shard, slot, grown_shard, bucket of each written row.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that
    of an empty one; the law is `rows`, so grown_shard is null.
    """
    kept = documents(docs, id_col, text_col).toDF("doc_id", "text")
    rows = shard_rows(kept, path or new_path(docs.sparkSession, "shards"), shards, seed)
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket",
    )
