"""Mixing sources to target weights with hash-threshold histograms.

Every row has a fixed hash.  A source's target is whole copies of all its rows and one
more copy of the rows whose hash lies under a threshold, so budgets are nested: a
larger one keeps what a smaller one took.  The threshold comes from sums of words by
source and hash bucket; only the bucket that the budget ends in is refined, until it
holds one hash value.  Nothing is sorted and rows are filtered in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.llm.common import documents, sized, tidy, written

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and of one histogram level.
BITS, LEVEL = 60, 10


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text; rows equal in both share their fate."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) with weight and target: shares of the total by weight, none above `most` times
    its source's size; what is above goes to the others by weight.

    That is the level l at which the sum of min(most * size, l * weight) meets the total,
    found from running sums over the sources by cap per weight.  One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    run = capped.select(
        "*",
        (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("cap_before"),
        (F.sum("weight").over(every) - F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")).alias("weight_left"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    # the first source whose own cap isn't below its level sets it; from there on levels fall
    run = run.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(every))
    return run.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """goals with copies (of every row) and bound: rows with hash <= bound get one more copy.

    rows: source, size, hash.  Each level sums words by source and the next LEVEL bits
    of the hash in the bucket that the level before ended in.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = written(
        goals.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * size)
        .withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(1 << BITS).cast("long"), "below": F.lit(0).cast("long"), "last": F.lit(0).cast("long"), "open": F.col("budget") > 0}),
        "mix-state",
    )
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        if state.where("open").isEmpty():
            break
        s = sized(state.where("open").select(F.col("source").alias("s"), "lo", "hi"), n_sources)
        inside = rows.join(s, rows.source.eqNullSafe(s.s) & (rows.hash >= s.lo) & (rows.hash < s.hi))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("final")
        )
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("cum", F.sum("words").over(up_to)).select(F.col("source").alias("s"), "bucket", "words", "cum", "first", "final")
        joined = state.join(sized(run, n_sources << LEVEL), state.source.eqNullSafe(F.col("s")) & F.col("open") & (F.col("below") + F.col("cum") >= F.col("budget")), "left")
        found = joined.groupBy(*state.columns).agg(F.min(F.struct("bucket", "words", "cum", "first", "final")).alias("b"))
        one = F.col("b.first") == F.col("b.final")
        under = F.col("below") + F.col("b.cum") - F.col("b.words")
        # a bucket with one hash value is taken whole if that ends nearer to the budget
        nearer = F.col("budget") - under > under + F.col("b.words") - F.col("budget")
        state = written(
            found.select(
                "source", "source_size", "weight", "target", "copies", "budget",
                F.when(F.col("open"), F.when(one, F.when(nearer, F.col("b.first")).otherwise(F.col("b.first") - 1)).otherwise(F.shiftleft(F.col("b.bucket"), shift))).otherwise(F.col("lo")).alias("lo"),
                F.when(F.col("open"), F.shiftleft(F.col("b.bucket") + 1, shift)).otherwise(F.col("hi")).alias("hi"),
                F.when(F.col("open"), under).otherwise(F.col("below")).alias("below"),
                F.lit(0).cast("long").alias("last"),
                (F.col("open") & ~one).alias("open"),
            ),
            "mix-state",
        )
    bound = F.when(F.col("budget") > 0, F.col("lo")).otherwise(-1)
    return state.select("source", "source_size", "target", "copies", bound.alias("bound"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, int]:
    """The table of thresholds by source for rows (source, size, hash), and how many sources there are."""
    sizes = written(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sizes")
    n = sizes.count()
    return thresholds(rows, targets(sizes, weights, most), n), n


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return documents(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")
    )


def _times(plan: DataFrame) -> Column:
    return plan["copies"] + (F.col("hash") <= plan["bound"]).cast("long")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (size times its copies), source.

    A null text has size 0; a null source is a source of its own, last in order; null and
    repeated ids are kept; rows equal in id and text are taken alike.  Sources may hold any
    share of the rows: only sums by source and bucket are shuffled.  An empty table gives
    an empty result; further columns are left out.
    """
    rows = written(_measured(docs, id_col, text_col, source_col), "mix-rows")
    plan, n = mix_plan(rows, weights, most)
    p = sized(plan.withColumnRenamed("source", "s"), n)
    return rows.join(p, rows.source.eqNullSafe(p.s)).select("doc_id", "size", "source_size", "target", (F.col("size") * _times(p)).alias("taken"), "source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs.

    Rows without words are taken like others of their source; rows equal in id and text share their fate.
    """
    names, docs = docs.columns, tidy(docs, id_col, text_col, source_col)
    rows = written(_measured(docs, id_col, text_col, source_col).drop("doc_id"), "mix-rows")
    plan, n = mix_plan(rows, weights, most)
    p = sized(plan.select(F.col("source").alias("s"), "copies", "bound"), n)
    kept = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_hash(docs[id_col], docs[text_col]).alias("hash"))
    joined = kept.join(p, F.col("row")[source_col].eqNullSafe(p.s)).withColumn("times", _times(p).cast("int"))
    return joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*").toDF(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':', coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
c AS (SELECT *, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left,
             sum(source_size) OVER () AS total
      FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - cap_before)::DOUBLE / weight_left::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM l WHERE level <= ratio)) AS target FROM l),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
k AS (SELECT g.source, g.h, words, sum(words) OVER (PARTITION BY g.source ORDER BY g.h ROWS UNBOUNDED PRECEDING) AS cum FROM g),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
x AS (SELECT k.source, k.h, copies, target - copies * source_size AS budget, cum, words
      FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, h, budget > 0 AND (cum < budget OR (cum - words < budget AND budget - (cum - words) > cum - budget)) AS more FROM x)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.copies + e.more::BIGINT))::BIGINT AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
