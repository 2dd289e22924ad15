"""Mixing sources to target weights with exact block quotas, by a multivariate-hypergeometric splitting tree.

1. Every source gets a target number of words: its share of all words by weight, no more than MAX_REPEATS times its own
   words; the excess is shared again by weight among the others until none is above.
2. A source's documents are dealt into blocks by hash, each about equally large. Whole passes take every block; of the rest
   blocks are taken in a random order until the target. The one block on the border is filled by documents in hash order: a
   document that no longer fits is passed over, those behind it that fit go on, and what is then open is closed by the one
   document nearest to it in size, if that comes nearer than leaving it open.
3. The taken blocks (a block once per pass) are split among the output shards by a binary tree. A node knows only its quota
   per source. Its blocks are put in a random order and the first half goes left, so the left quotas are one draw of the
   multivariate hypergeometric distribution and the right ones the rest. After log2(shards) levels every shard has exact quotas.
4. Each source's blocks in a random order are cut by those quotas: disjoint blocks for each shard. Within a shard documents
   are ordered by a hash.

All random orders are hashes of seed, source, block and pass, so runs agree. Everything is DataFrame functions. The number of
blocks is bounded (MAX_BLOCKS plus one for each source), documents are dealt over all of them, so neither a large source nor
many rows meet in one task. The table of sources (one row each) is ordered in one task.

Defined cases: null text has size 0; documents of size 0 are never taken; a null source is a source, the last one; no words
give targets of 0; rows of equal id and text are told apart by nothing, so each is taken as often as its place says; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.session import cut_lineage

MAX_REPEATS = 3
MAX_BLOCKS = 16_384
SHARDS = 16  # a power of two
FILL_ROUNDS = 4  # over a border block
SEED = 11


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab..carriage return; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    blank = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size): weights repeat along the sources by code point, null last.

    With ratio = most * size / weight, sources are capped from the lowest ratio on; the level is what remains for each unit of
    weight once all sources below it are capped.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), place % len(weights)))
    table = table.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    table = table.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return table.withColumn("found", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def split_quotas(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shard, quota: a tree of halvings over (source, quota)."""
    quotas = units.select("source", F.lit(0).alias("node"), "quota")
    for level in range(shards.bit_length() - 1):
        drawn = quotas.select("source", "node", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("i"))
        order = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "node", "i"), F.col("source").asc_nulls_last(), "i")
        drawn = drawn.withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("node")))
        side = (F.col("at") > F.ceil(F.col("n") / 2)).cast("int")
        quotas = drawn.groupBy("source", (F.col("node") * 2 + side).alias("node")).agg(F.count("*").cast("int").alias("quota"))
    return quotas.withColumnRenamed("node", "shard")


def fill_border(rows: DataFrame, rounds: int = FILL_ROUNDS) -> DataFrame:
    """rows (source, block, h, id, size, part) of border blocks with `last`: whether the last pass takes the document.

    Every round goes over the documents that fit into what is open and takes them up to the first that no longer fits. All rounds share one order.
    """
    block = Window.partitionBy("source", "block")
    order = block.orderBy("h", "id")
    d = rows.withColumns({"last": F.lit(False), "open": F.col("part")})
    for _ in range(rounds):
        fits = ~F.col("last") & (F.col("size") <= F.col("open"))
        d = d.withColumn("fits", fits).withColumn("sum", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.withColumn("now", F.col("fits") & (F.col("sum") <= F.col("open")))
        d = d.withColumn("last", F.col("last") | F.col("now")).withColumn("open", F.col("open") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(block))
    off = F.abs(F.col("size") - F.col("open"))
    nearest = F.row_number().over(block.orderBy("last", off, "h", "id"))
    d = d.withColumn("nearest", nearest)
    return d.withColumn("last", F.col("last") | ((F.col("nearest") == 1) & (off < F.col("open")))).drop("open", "fits", "sum", "now", "nearest")


def mix_sources(docs: DataFrame, weights: Sequence[float], shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text: str = "text",
                source: str = "source", most: int = MAX_REPEATS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per document: id, key (xxhash64 of id, source and text), size, source_size, target, draws (array<struct<pass, shard, place>>, one for each time it is taken).

    Exploding draws gives the mixture: the rows of a shard ordered by place, pass and id.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    rows = cut_lineage(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
                                   F.xxhash64(F.lit(seed), f"`{id_column}`", f"`{text}`").alias("h"),
                                   F.xxhash64(f"`{id_column}`", f"`{source}`", f"`{text}`").alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = targets(sizes.select("source", "source_size"), weights, most)
    plan = wanted.withColumnRenamed("source", "s").join(sizes.select("source", "n"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    # About n / total of the blocks, but no fewer documents in a block than a few dozen.
    plan = plan.withColumn("blocks", F.least(F.ceil(F.lit(max_blocks) * F.col("n") / total), F.ceil(F.col("n") / 64)).cast("int"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int"))
    plan = cut_lineage(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    dealt = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.id", "r.key", "r.source", "r.size", "r.h", "p.source_size", "p.target", F.pmod(F.col("r.h"), F.col("p.blocks")).cast("int").alias("block"))

    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    blocks = blocks.withColumn("turn", F.row_number().over(order)).withColumn("until", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.*", "p.passes", "p.rest")
    # What the last pass takes of the block: all, nothing, or words up to `part`.
    part = F.greatest(F.lit(0.0), F.col("rest") - (F.col("until") - F.col("words")))
    blocks = blocks.withColumn("part", F.least(F.col("words").cast("double"), part)).withColumn("times", F.col("passes") + (F.col("part") > 0).cast("int"))
    blocks = cut_lineage(blocks)

    quotas = split_quotas(blocks.groupBy("source").agg(F.sum("times").cast("int").alias("quota")).filter("quota > 0"), shards, seed + 2)
    ends = quotas.withColumn("end", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")))
    slots = ends.select("source", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("slot"))
    units = blocks.filter("times > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass"))
    shuffled = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "source", "block", "pass"), "block", "pass")
    units = units.withColumn("slot", F.row_number().over(shuffled).cast("long"))
    placed = units.alias("u").join(slots.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")) & (F.col("u.slot") == F.col("s.slot"))).select("u.source", "u.block", "u.pass", "s.shard")
    homes = placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))
    homes = blocks.alias("b").join(homes.alias("h"), F.col("b.source").eqNullSafe(F.col("h.source")) & (F.col("b.block") == F.col("h.block"))).select("b.source", "b.block", "b.passes", "b.part", "b.words", "h.homes")

    taken = dealt.alias("d").join(homes.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.block") == F.col("h.block")), "left").select("d.*", "h.passes", "h.part", "h.words", "h.homes")
    taken = taken.withColumn("border", F.coalesce((F.col("part") > 0) & (F.col("part") < F.col("words")), F.lit(False)))
    # A source has one border block at most, so only its rows are sorted.
    taken = taken.filter("NOT border").withColumn("last", F.col("part") > 0).unionByName(fill_border(taken.filter("border")))
    homes_ = F.filter("homes", lambda x: (x["pass"] <= F.col("passes")) | F.col("last"))
    draws = F.when((F.col("size") > 0) & F.col("homes").isNotNull(), F.transform(homes_, lambda x: F.struct(
        x["pass"].alias("pass"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 4), x["shard"], x["pass"], F.col("h")).alias("place")))).otherwise(
        F.array().cast("array<struct<pass:int,shard:int,place:bigint>>"))
    return taken.select("id", "key", "size", "source_size", "target", draws.alias("draws"))


def mixture(drawn: DataFrame) -> DataFrame:
    """The mixture itself: one row for each time a document is taken."""
    return drawn.select("id", "size", F.explode("draws").alias("draw")).select("id", "size", F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"), F.col("draw.pass").alias("pass"))


def mixing_digests(drawn: DataFrame) -> DataFrame:
    """`draws` lists pass:shard:place of each time the document is taken, by pass."""
    places = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["pass"], x["shard"], x["place"])), ",")
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").cast("long").alias("copies"), places.alias("draws"))
