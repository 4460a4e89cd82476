"""Importance resampling towards a target distribution with position-table n-grams.

posexplode lays every text out as one row a word; lead() over the positions of a text puts
the words that follow beside each one, so that a row has the run of every order that begins
at its word.  Runs are hashed into buckets, buckets counted in the documents and in the
target texts, and each bucket's gain, the logarithm of how much likelier it is in the
target, is joined back to the runs.  A text's weight is the mean of its gains; texts are
drawn without replacement by weight and a Gumbel noise fixed by seed and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.llm.common import documents, numbered, written

#: What counts as a word, and which letters are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest run, buckets, seed of the noise, least words of a text that may be drawn, and percent of these that are.
ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Fixed value: the gain and the noise are in thousandths.
SCALE = 1000


def positions(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a word of each text: pos and word beside the other columns; a text without words has one row with nulls."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    kept = [c for c in texts.columns if c != text_col]
    return texts.select(*kept, F.posexplode_outer(words).alias("pos", "word"))


def runs(words: DataFrame, keys: list[str], order: int) -> list[Column]:
    """For each order the run that begins at a word, null where the text ends before it does."""
    along = Window.partitionBy(*keys).orderBy("pos")
    found, text = [F.col("word")], F.col("word")
    for n in range(1, order):
        following = F.lead("word", n).over(along)
        text = F.concat(text, F.lit(" "), following)  # null if any is
        found.append(text)
    return found


def features(texts: DataFrame, keys: list[str], order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Rows (keys, pos, bucket) of all runs of 1 to `order` words; those of a text without words have null buckets.

    keys tell texts apart.  Runs of one word need no neighbours, so order 1 doesn't shuffle words.
    """
    words = positions(texts)
    bucket = lambda run: F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")
    if order == 1:
        return words.select(*keys, "pos", bucket(F.col("word")).alias("bucket"))
    grams = words.select(*keys, "pos", F.array(*runs(words, keys, order)).alias("runs"))
    each = grams.select(*keys, "pos", F.posexplode("runs").alias("n", "run")).where("n = 0 or run is not null")
    # only the run of one word stands for its position
    return each.select(*keys, F.when(F.col("n") == 0, F.col("pos")).alias("pos"), bucket(F.col("run")).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets that the features of docs fall into, from the features of both; `buckets` rows at most."""
    def counts(of: DataFrame, name: str) -> DataFrame:
        return of.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    both = written(counts(docs, "s").join(counts(target, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "gains")
    s_all, t_all = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).head()
    above = (F.col("t") + 1).cast("double") * F.lit(float(s_all + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets))
    return both.where("s > 0").select("bucket", F.floor(F.lit(float(SCALE)) * F.ln(above / below)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of the Gumbel noise of a document: from 32 bits of the digest of seed and id; a null id is `null`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank, and n_words.

    weight is the floored mean of the gains of the text's features, 0 without any; score adds
    the noise.  Of the N texts with least_words words or more the floor(percent * N / 100) of
    the highest scores are drawn, ties to the smaller id (null last), and get rank 1, 2, 3 ...;
    the rank of others is null.  A null text has no words; repeated rows are each a row, and
    each may be drawn; a null id has a noise of its own, the same for all.  An empty target
    gives gains against an even one; an empty table gives an empty result.  Further columns
    are left out.

    Words never meet by text but for orders above 1: counts go by bucket and by row, both
    summed before the shuffle, and gains are broadcast, `buckets` rows whatever the input.
    """
    kept = documents(docs, id_col, text_col).toDF("doc_id", "text")
    # the number tells equal rows apart, the rest tells which rows those are
    keys = ["row", "doc_id", "k1", "k2"]
    texts = kept.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), "text")
    wanted = documents(target, target_col).toDF("text").select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("k1"), "text")
    found = features(texts, keys, order, buckets)
    table = F.broadcast(gains(found, features(wanted, ["row", "k1"], order, buckets), buckets))
    rows = found.join(table, "bucket", "left").groupBy(*keys).agg(F.count("bucket").alias("n_features"), F.count("pos").alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.expr("(total - pmod(total, greatest(n_features, 1))) div greatest(n_features, 1)")  # the floor, in integers
    scored = rows.select("row", "doc_id", "n_features", "n_words", weight.alias("weight"))
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    quota = percent * scored.where(able).count() // 100
    ranked = numbered(scored.where(able), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()], "ranked")
    drawn = ranked.withColumn("rank", F.when(F.col("position") < quota, F.col("position") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return drawn.select(*columns).unionByName(rest.select(*columns))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS step FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM benchmark),
e AS (SELECT doc_id, unnest(words) AS word FROM d),
kinds AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM (SELECT word FROM e UNION ALL SELECT word FROM b))),
walk AS (
  SELECT word, x, 4294967295::BIGINT AS crc, 0 AS pos FROM kinds
  UNION ALL
  SELECT word, x, xor(crc >> 8, c[1 + xor(crc % 256, ('0x' || substr(x, 2 * pos + 1, 2))::BIGINT)]), pos + 1
  FROM walk, crc_table WHERE 2 * pos < len(x)),
buckets AS (SELECT word, xor(crc, 4294967295::BIGINT) % 10000 AS bucket FROM walk WHERE 2 * pos = len(x)),
s AS (SELECT bucket, count(*) AS s FROM e JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM e) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM e JOIN buckets USING (word) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN w ON d.doc_id IS NOT DISTINCT FROM w.doc_id),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) AS able FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank, n_features AS n_words FROM r
"""
