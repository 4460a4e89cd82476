"""A Merkle manifest of a table: one root for all rows, and a proof for each.

A row's digest is a leaf.  Leaves of a group are numbered by id and cut into aligned
blocks of ARITY ** HEIGHT; blocks reach tasks as Arrow tables, and there DuckDB builds all
levels of a block, by string_agg in order and sha256, and walks every leaf up to the
block's root, noting its siblings.  Block roots, one for thousands of rows, are combined
by Spark level by level to the root of the group, and those of groups likewise to the root
of all; the siblings met there are joined back to the leaves by block and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import ARROW_ROWS, documents, frugal, numbered, prepare, sized, written

#: Nodes that make one node of the next level, and levels of a block.
ARITY, HEIGHT = 2, 12
#: Leaves that DuckDB takes at once, whole blocks, and the memory it may have.
LEAVES, MEMORY = 16_384, "400MB"
#: The fields of a leaf in order, and what stands for a null.
FIELDS, NULL = ["doc_id", "source", "lang", "n_chars", "text"], "-"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The digest of values as text, each as its length in bytes, a colon and itself, a null as `-`."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit(NULL)) for v in values]
    return sha256(F.concat(*told))


#: One level of all blocks: what stands left and right of each node among those that become one node with it, ...
_SIDES = """
SELECT b, pos, pos // {k} AS above, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
       coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
FROM nodes WHERE levels > {level} WINDOW run AS (PARTITION BY b, pos // {k} ORDER BY pos)
"""
#: ... the leaves one level on, with what they have met, and what comes of leaf and told leaf, ...
_WALK = """
SELECT w.n, w.b, coalesce(s.above, w.pos) AS pos, CASE WHEN s.b IS NULL THEN w.proof ELSE concat(w.proof, s.l, s.r) END AS proof,
       CASE WHEN s.b IS NULL THEN w.fold ELSE sha256(concat(s.l, w.fold, s.r)) END AS fold
FROM walks w LEFT JOIN sides s ON w.b = s.b AND w.pos = s.pos
"""
#: ... and the nodes of the next level, with the roots of blocks that are done.
_NODES = """
SELECT b, pos // {k} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node, any_value(levels) AS levels FROM nodes WHERE levels > {level} GROUP BY b, pos // {k}
UNION ALL SELECT b, pos, node, levels FROM nodes WHERE levels <= {level}
"""


def block_levels(engine: duckdb.DuckDBPyConnection, table: pa.Table, arity: int) -> pa.Table:
    """Whole blocks, rows (at, levels, leaf, told) one block after another, with proof, fold and root beside them.

    at is the place in the block, levels how many levels the block is folded by; proof is
    all siblings from the leaf up, fold what told comes to with them, root the block's node.
    """
    at = table["at"].to_numpy()
    rows = pa.table({"n": pa.array(np.arange(len(at))), "b": pa.array(np.cumsum(at == 0)), "pos": at, "levels": table["levels"], "leaf": table["leaf"], "told": table["told"]})
    engine.register("rows", rows)
    engine.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT b, pos, leaf AS node, levels FROM rows")
    engine.execute("CREATE OR REPLACE TEMP TABLE walks AS SELECT n, b, pos, '' AS proof, told AS fold FROM rows")
    for level in range(max(rows["levels"].to_pylist(), default=0)):
        for name, query in (("sides", _SIDES), ("further", _WALK), ("above", _NODES)):
            engine.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {query.format(k=arity, level=level)}")
        engine.execute("CREATE OR REPLACE TEMP TABLE walks AS FROM further")
        engine.execute("CREATE OR REPLACE TEMP TABLE nodes AS FROM above")
    out = engine.sql("SELECT w.proof, w.fold, r.node FROM walks w JOIN nodes r USING (b) ORDER BY w.n").to_arrow_table()
    engine.unregister("rows")
    for name, column in zip(("proof", "fold", "root"), out.columns, strict=True):
        table = table.append_column(name, column)
    return table


def _blocks(arity: int, leaves: int = LEAVES):
    """Rows of whole blocks in order to block_levels of them."""

    @frugal
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        held: list[pa.RecordBatch] = []
        n = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from block_levels(engine, table, arity).combine_chunks().to_batches(max_chunksize=ARROW_ROWS)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > leaves:
                table = pa.Table.from_batches(held)
                begins = np.flatnonzero(table["at"].to_numpy() == 0)
                whole = int(begins[-1])  # the last block may go on
                yield from done(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                n -= whole
        if held:
            yield from done(pa.Table.from_batches(held))
        engine.close()

    return build


def levels_of(n: Column, arity: int, most: int) -> Column:
    """How many levels n nodes are folded by until one is left, at most `most`."""
    return sum((F.when(n > arity**level, 1).otherwise(0) for level in range(most)), F.lit(0)).cast("int")


PATH = "array<struct<l: string, r: string>>"


def tower(nodes: DataFrame, arity: int, label: str) -> DataFrame:
    """(g, at, path, root) for a table of nodes (g, at, node), gapless from 0 in each group g.

    path is what stands left and right of the node, level by level, when each `arity`
    nodes in a row become the digest of their digests, until one is left: the root.  Each
    level is one aggregation by (g, at div arity), so no group meets in a task.
    """
    count = nodes.groupBy("g").agg(F.count("*").alias("m"))
    base = written(nodes.join(sized(written(count, label), nodes.count()), "g").select("g", "at", "node", "m"), label)
    n = base.count()
    level, rows, runs = 0, base, []
    while not rows.where("m > 1").isEmpty():
        met = rows.where("m > 1").groupBy("g", F.expr(f"at div {arity}").alias("above"), "m").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("run"))
        met = written(met.select("g", "above", "run", F.ceil(F.col("m") / arity).alias("m"), sha256(F.array_join(F.col("run.node"), "")).alias("node")), label)
        runs.append(met.select("g", F.lit(level).alias("level"), "above", "run"))
        rows = met.select("g", F.col("above").alias("at"), "node", "m").unionByName(rows.where("m = 1"))
        level += 1
        rows = written(rows, label)
    roots = rows.select("g", F.col("node").alias("root"))
    found = base.join(sized(roots, n), "g")
    if not runs:
        return found.select("g", "at", F.lit(None).cast(PATH).alias("path"), "root").withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    every = written(every, label)
    # the node's own place at each level, and the run that it is in
    places = F.array(*(F.struct(F.lit(i).alias("level"), F.expr(f"at div {arity**i}").alias("own"), F.expr(f"at div {arity ** (i + 1)}").alias("above")) for i in range(level)))
    each = base.select("g", "at", F.explode(places).alias("p")).select("g", "at", "p.*").join(sized(every, every.count()), ["g", "level", "above"])
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
    each = each.select("g", "at", F.struct("level", side(lambda x: x["at"] < F.col("own")).alias("l"), side(lambda x: x["at"] > F.col("own")).alias("r")).alias("step"))
    steps = each.groupBy("g", "at").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    paths = steps.select("g", "at", F.transform("steps", lambda s: F.struct(s["l"].alias("l"), s["r"].alias("r"))).alias("path"))
    return written(found.join(sized(paths, n), ["g", "at"], "left").select("g", "at", F.coalesce("path", F.array().cast(PATH)).alias("path"), "root"), label)


def folded(node: Column, path: Column) -> Column:
    """What a node comes to along a path."""
    return F.aggregate(path, node, lambda own, step: sha256(F.concat(step["l"], own, step["r"])))


def manifest_of(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """leaves (row, group, doc_id, leaf, told) with subroot, root, proof_sha256 and folded_root.

    leaves is a written table; row tells its rows apart.  Within a group (text or null, null
    first, then by bytes) leaves go by doc_id, null last, equal ids by leaf.  told is the
    leaf that is folded with the siblings of leaf.
    """
    spark = prepare(leaves.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = arity**height
    keyed = leaves.withColumn("g", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))  # in the order of groups
    placed = numbered(keyed, ["g"], [F.col("doc_id").asc_nulls_last(), F.col("leaf").asc(), F.col("row").asc()], "leaves").drop("row")
    counts = written(keyed.groupBy("g").agg(F.count("*").alias("n")), "groups")
    n_groups = counts.count()
    levels = levels_of(F.col("n"), arity, height).alias("levels")
    dealt = placed.join(sized(counts, n_groups), "g").select("g", "doc_id", "leaf", "told", F.expr(f"position div {block}").alias("block"), F.expr(f"int(position % {block})").alias("at"), levels)
    together = dealt.repartition(parts, "g", "block").sortWithinPartitions("g", "block", "at")
    schema = T.StructType([*together.schema.fields, *(T.StructField(name, T.StringType()) for name in ("proof", "fold", "root"))])
    walks = written(together.mapInArrow(_blocks(arity), schema), "walks")
    blocks = tower(walks.where("at = 0").select("g", F.col("block").alias("at"), F.col("root").alias("node")), arity, "blocks")
    blocks = blocks.select("g", F.col("at").alias("block"), "path", F.col("root").alias("subroot"))
    heads = written(blocks.where("block = 0").select("g", F.col("subroot").alias("node"), F.lit("").alias("all")), "heads")
    order = numbered(heads, ["all"], [F.col("g").asc()], "heads")
    groups = tower(order.select(F.col("all").alias("g"), F.col("position").alias("at"), "node"), arity, "top")
    groups = order.select("g", F.col("position").alias("at")).join(sized(groups.select("at", F.col("path").alias("rest"), F.col("root").alias("top")), n_groups), "at").drop("at")
    n_blocks = blocks.count()
    joined = walks.join(sized(blocks, n_blocks), ["g", "block"]).join(sized(groups, n_groups), "g")
    path = F.concat("path", "rest")
    proof = F.concat("proof", F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))
    return joined.select("doc_id", "leaf", "subroot", F.col("top").alias("root"), sha256(proof).alias("proof_sha256"), folded(F.col("fold"), path).alias("folded_root"), F.when(F.col("g") != "", F.expr("substr(g, 2)")).alias("group"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root, verified, lang.

    folded_root is recomputed from the row as it is now and the siblings of its leaf, so
    verified says whether the row is what the manifest was made of.  Where `tampered` holds,
    the row now has one more in n_chars (a null stays null).  Any column may be null; a null
    lang is a group of its own, the first; null ids come last; repeated rows are leaves side
    by side.  An empty table gives an empty result; further columns are left out.

    Only digests are shuffled: twice to number and to build blocks, 4,096 leaves each, so a
    lang with any share of the rows is many blocks.  Block and group paths are broadcast
    where their counted rows are few.
    """
    kept = documents(docs, *FIELDS)
    now = F.when(tampered, (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string")) if tampered is not None else F.col("n_chars").cast("string")
    columns = {name: F.col(name) for name in FIELDS}
    leaves = kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("lang").cast("string").alias("group"), "doc_id",
        leaf_of(*columns.values()).alias("leaf"), leaf_of(*(columns | {"n_chars": now}).values()).alias("told"),
    )
    rows = manifest_of(written(leaves, "leaves"), arity, height)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("group").alias("lang"))


def every_seventh(doc_id: Column) -> Column:
    """Rows whose id has a crc32 that 7 divides; never a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS step FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE step = 8),
crcs AS (
  SELECT doc_id, doc_id::VARCHAR AS x, 4294967295::BIGINT AS crc, 1 AS pos FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, x, xor(crc >> 8, c[1 + xor(crc % 256, ascii(x[pos]))]), pos + 1 FROM crcs, crc_table WHERE pos <= len(x)),
d AS (SELECT *, coalesce(doc_id IN (SELECT doc_id FROM crcs WHERE pos > len(x) AND xor(crc, 4294967295::BIGINT) % 7 = 0), false) AS changed FROM documents),
f AS (SELECT doc_id, lang, concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-')) AS a,
             n_chars, CASE WHEN changed THEN n_chars + 1 ELSE n_chars END AS told, coalesce(concat(strlen(text), ':', text), '-') AS z FROM d),
leaves AS (SELECT doc_id, lang, sha256(concat(a, coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'), z)) AS leaf,
                  sha256(concat(a, coalesce(concat(strlen(told::VARCHAR), ':', told), '-'), z)) AS told FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM leaves),
tree AS (
  SELECT lang, 0 AS level, pos, m, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE m > 1 GROUP BY lang, level, pos // 2, m),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM tree WHERE m = 1),
top AS (
  SELECT 0 AS level, pos, m, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE m > 1 GROUP BY level, pos // 2, m),
walk AS (
  SELECT doc_id, lang, 0 AS level, pos, m, told AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.level + 1, w.pos // 2, (w.m + 1) // 2,
         sha256(CASE WHEN s.node IS NULL THEN w.fold WHEN w.pos % 2 = 0 THEN w.fold || s.node ELSE s.node || w.fold END), w.proof || coalesce(s.node, '')
  FROM walk w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = xor(w.pos, 1::BIGINT) WHERE w.m > 1),
up AS (
  SELECT w.doc_id, w.lang, 0 AS level, r.pos, r.m, w.fold, w.proof, r.subroot FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.m = 1
  UNION ALL
  SELECT w.doc_id, w.lang, w.level + 1, w.pos // 2, (w.m + 1) // 2,
         sha256(CASE WHEN s.node IS NULL THEN w.fold WHEN w.pos % 2 = 0 THEN w.fold || s.node ELSE s.node || w.fold END), w.proof || coalesce(s.node, ''), w.subroot
  FROM up w LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1::BIGINT) WHERE w.m > 1)
SELECT p.doc_id, p.leaf, u.subroot, t.node AS root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = t.node AS verified, p.lang
FROM placed p JOIN up u ON u.doc_id IS NOT DISTINCT FROM p.doc_id AND u.m = 1, top t WHERE t.m = 1
"""
