"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources, by code point with null last, weigh 5, 2, 1, repeating, and share ``budget`` times all sizes. No target exceeds
   ``cap`` times its source; the excess goes to the others by weight (a water level, found in closed form).
2. The rows of a source stand in a seeded permutation, copy after copy, on a line of words. Its target cuts that line, so
   a row is drawn 0, 1 or 2 times and the drawn words miss the target by half a row at most.
3. The drawn part of a line is cut into blocks. Block quotas of all sources start at the root of a binary tree over the output
   shards; each node deals its blocks at random, half to either side, so that the counts by source are a multivariate
   hypergeometric draw and every block ends in one shard. Blocks are disjoint; rows are then shuffled within their shard.

Prefix sums run over (source, cell) with cells dealt by hash, then over the cells of a source, so that a source with most
of the rows is spread over many tasks. The number of cells is about the square root of the number of rows. All decisions are
hashes of (seed, doc_id, text), so reruns agree, and rows without doc_id spread like others. Only DataFrame functions run.

A null text has size 0, null source is a source, an empty table gives an empty result; rows with equal doc_id are separate rows,
and other columns pass through ``mixed_rows`` whatever their names. Only rows equal in doc_id, source and text stay together.
Windows over sources, of which there is a row each, run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import keep
from tidewell.llm.words import word_count_of

WEIGHTS = (5, 2, 1)
#: Shards follow the number of rows, 2^3 to 2^14 of them; blocks are 16 per shard, 4,096 at least.
ROWS_PER_SHARD, LEAST_LEVELS, MOST_LEVELS = 8192, 3, 14
BLOCKS, BLOCKS_PER_SHARD = 4096, 16
LEAST_CELLS = 16


def _hash(seed: int, what: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), *cols)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source, so the ordered windows hold as many rows as there are sources."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    rows = by.select("source", "source_size", weight.alias("w")).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns({
        "nth": F.row_number().over(order),
        "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "open": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "all": budget * F.sum("source_size").over(whole),
    })
    level = (F.col("all") - F.col("full")) / F.col("open")
    # Sources below the level are full; the first that is not fixes the level for all after it.
    fits = F.when(level * F.col("w") <= F.col("most"), F.struct("nth", level.alias("level")))
    rows = rows.withColumn("level", F.min(fits).over(whole)["level"])
    return rows.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def block_shards(goals: DataFrame, seed: int, levels: int = LEAST_LEVELS, blocks: int = BLOCKS) -> DataFrame:
    """(source, shards): the shard of each block of a source. About ``blocks`` rows in all, 262,144 at most."""
    width = F.greatest(F.sum("target").over(Window.partitionBy()) / blocks, F.lit(1.0))
    quota = goals.select("source", "target", width.alias("width")).withColumn("quota", F.ceil(F.col("target") / F.col("width")))
    node = quota.select("source", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("quota"), F.lit(1)).cast("long"))).alias("block"))
    node = node.withColumn("shard", F.lit(0))
    for level in range(levels):
        here = Window.partitionBy("shard")
        place = F.row_number().over(here.orderBy(_hash(seed, f"level{level}", F.col("source"), F.col("block")), "source", "block"))
        right = (place > F.ceil(F.count(F.lit(1)).over(here) / 2)).cast("int")
        node = node.withColumn("shard", 2 * F.col("shard") + right)
    listed = F.array_sort(F.collect_list(F.struct("block", "shard")))
    return node.groupBy("source", "width").agg(F.transform(listed, lambda x: x["shard"]).alias("shards"))


def plan(docs: DataFrame, size: Column, seed: int = 0, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and the block and shard of each copy."""
    sizes = keep(docs.select("doc_id", "source", F.xxhash64("text").alias("version"), size.alias("size")), "mix-sizes")
    n = sizes.count()
    cells = max(LEAST_CELLS, 1 << (n.bit_length() + 1) // 2)
    levels = min(MOST_LEVELS, max(LEAST_LEVELS, (n // ROWS_PER_SHARD).bit_length()))
    blocks = max(BLOCKS, BLOCKS_PER_SHARD << levels)
    goals = targets(sizes, weights, budget, cap)
    goals = keep(goals.join(block_shards(goals, seed, levels, blocks).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-goals")
    rows = sizes.withColumns({"key": _hash(seed, "line", F.col("doc_id"), F.col("version")), "cell": F.pmod(_hash(seed, "cell", F.col("doc_id"), F.col("version")), F.lit(cells))})
    totals = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    starts = totals.select("source", "cell", (F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")).alias("cell_start"))
    inner = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id", "version", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    named = starts.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "cell_start")
    rows = rows.withColumn("inner", inner)
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c"))).drop("_s", "_c")
    goals = goals.withColumnRenamed("source", "_g")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    middle = F.col("cell_start") + F.col("inner") + F.col("size") / 2
    at = lambda k: middle + k * F.col("source_size")
    drawn = F.array(*[F.struct(F.lit(k).alias("copy"), F.floor(at(k) / F.col("width")).alias("block"), (at(k) <= F.col("target")).alias("in")) for k in range(2)])
    drawn = F.filter(drawn, lambda x: x["in"] & (F.col("size") > 0))
    shard = lambda b: F.get(F.col("shards"), F.least(b, F.size(F.col("shards")) - 1).cast("int"))
    drawn = F.transform(drawn, lambda x: F.struct(x["copy"].alias("copy"), x["block"].alias("block"), shard(x["block"]).alias("shard")))
    return rows.select("doc_id", "source", "version", "size", "source_size", "target", F.size(drawn).alias("copies"), drawn.alias("draws"))


def word_sizes() -> Column:
    return word_count_of(F.col("text"))


def mixed_rows(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy drawn, shuffled within its shard. Rows without words are not drawn.

    Copies are looked up by doc_id, source and text; where several rows share them, each takes the draws of its own place among them.
    """
    columns = docs.columns
    key, nth = _hash(seed, "row", F.col("doc_id"), F.col("source"), F.col("version")), F.row_number().over(Window.partitionBy("_k").orderBy("doc_id", "source", "size"))
    draws = plan(docs, word_sizes(), seed, **options).withColumn("_k", key).withColumn("_n", nth).where("copies > 0").select(F.col("_k").alias("_d"), "_n", "draws")
    # The row is carried whole, so that its columns cannot clash with those of the plan. Both sides are dealt by one key that is
    # never null, so that the window and the join share a shuffle; the place among equal keys is no join key of its own.
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("version"), word_sizes().alias("size"), F.struct(*columns).alias("_row"))
    rows = rows.select(key.alias("_k"), "doc_id", "source", "size", "_row").withColumn("_nth", nth)
    out = rows.join(draws, (F.col("_k") == F.col("_d")) & (F.col("_nth") - F.col("_n") == 0)).select("_row", F.explode("draws").alias("_draw"))
    order = _hash(seed, "shuffle", F.col("_row.doc_id"), F.col("_row.text"), F.col("_draw.copy"))
    return out.repartition("_draw.shard").sortWithinPartitions("_draw.shard", order).select("_row.*")


def digest(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards of every row."""
    rows = plan(docs, word_sizes(), seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", F.transform("draws", lambda x: x["shard"]).alias("shards"))
