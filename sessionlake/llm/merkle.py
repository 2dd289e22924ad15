"""A Merkle tree over a table: leaves in order within their source, runs of three to a parent, subroots of the sources to one root.

Siblings come from windows: at level i a node stands in its first leaf's row, so its siblings are 3^i and 2 * 3^i rows before or after it,
masked by its slot and the length of its run. Windows cover blocks of 3^SPAN leaves, never a whole source; a run never crosses a block.
Each block leaves one node, and the nodes of all blocks go through the same step, until every source has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.session import cut_lineage

FAN = 3
SPAN = 7  # levels of a block: 2,187 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Of the fields one after another, each `-` if null, else its UTF-8 length, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos` (from 0 in its group, by `order`) and `n` (rows of the group), without a task that holds a group.

    Rows are dealt by ranges; a row's place is its place in its range, and the number of rows of its group in the ranges before."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt.withColumn("_range", F.shiftright("_at", 33)))
    counts = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_group).alias("n"))
    return dealt.join(starts, [group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _block_levels(nodes: DataFrame) -> DataFrame:
    """nodes with `block`, `top` (digest of the block's node, in its first row) and `own` (array of left and right siblings of the levels within the block)."""
    place = Window.partitionBy("g", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN ** SPAN)).withColumn("_d", F.col("digest"))
    for level in range(SPAN):
        step = FAN ** level
        index, count = F.floor(F.col("pos") / step), F.ceil(F.col("n") / step)
        slot = index % FAN
        run = F.least(F.lit(FAN), count - (index - slot))
        here, many = F.col("pos") % step == 0, count > 1
        rows = rows.withColumns({"_b2": F.lag("_d", 2 * step).over(place), "_b1": F.lag("_d", step).over(place), "_a1": F.lead("_d", step).over(place), "_a2": F.lead("_d", 2 * step).over(place)})
        none = F.lit("")
        after1, after2 = (F.when(run > 1 + slot, F.col("_a1")).otherwise(none), F.when(run > 2 + slot, F.col("_a2")).otherwise(none))
        left = F.when(slot == 0, none).when(slot == 1, F.col("_b1")).otherwise(F.concat("_b2", "_b1"))
        rows = rows.withColumns({f"_l{level}": F.when(here & many, left), f"_r{level}": F.when(here & many, F.concat(after1, after2))})
        up = F.when(here & (slot == 0), F.when(many, digest(F.col("_d"), F.col(f"_r{level}"))).otherwise(F.col("_d")))
        rows = rows.withColumn("_d", up).drop("_b2", "_b1", "_a1", "_a2")
    down = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [(F.last(f"_l{i}", ignorenulls=True).over(down), F.last(f"_r{i}", ignorenulls=True).over(down)) for i in range(SPAN)]
    names = {f"_{s}{i}": side for i, pair in enumerate(sides) for s, side in zip("lr", pair)}
    rows = rows.withColumns(names)
    steps = F.array(*(F.when(F.col(f"_l{i}").isNotNull(), F.struct(F.col(f"_l{i}").alias("left"), F.col(f"_r{i}").alias("right"))) for i in range(SPAN)))
    return rows.withColumn("own", F.array_compact(steps)).withColumnRenamed("_d", "top").drop(*names)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (g, pos, n, digest, and what else they carry) with `block` and `own`, the siblings within the block; and for every block (g, block)
    `root` of its group and `steps`, the siblings from the block's node to it. A group of one node is its own root, without steps."""
    rows = cut_lineage(_block_levels(nodes))
    blocks = rows.filter(F.col("pos") % FAN ** SPAN == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / FAN ** SPAN).alias("n"), F.col("top").alias("digest"))
    rows = rows.drop("top")
    if (blocks.agg(F.max("n")).first()[0] or 0) > 1:
        upper, above = climb(blocks)
        return rows, join_steps(upper, above).select("g", F.col("pos").alias("block"), "root", "steps")
    return rows, blocks.select("g", F.col("pos").alias("block"), F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))


def join_steps(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with what their block knows; a block has 3^SPAN rows at most, so no key is large."""
    return rows.join(blocks, ["g", "block"]).withColumn("steps", F.concat("own", "steps")).drop("own", "block")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda so_far, step: digest(step["left"], so_far, step["right"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(leaves: DataFrame, source: str, order: list[str]) -> DataFrame:
    """leaves (source, order, leaf, and what else they carry) with subroot, root and steps (the leaf's siblings, level by level, via its source's subroot to the root).

    Leaves stand by `order` in their source, rows that tie there by leaf digest; sources stand bytewise, null first. Rows that tie in both are equal and may trade
    places. Repeated rows are leaves of their own. An empty table gives an empty manifest."""
    ready = cut_lineage(leaves.withColumn("g", F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))).withColumnRenamed("leaf", "digest"))
    rows, blocks = climb(in_order(ready, "g", [*order, "digest"]))
    tops = cut_lineage(blocks.filter("block = 0").select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")))
    sources = join_steps(*climb(in_order(tops, "g", ["name"]))).select(F.col("name").alias("g"), F.col("root").alias("_root"), F.col("steps").alias("_above"))
    blocks = (blocks.join(sources, "g").withColumn("steps", F.concat("steps", "_above")).withColumnRenamed("root", "subroot").withColumnRenamed("_root", "root").drop("_above"))
    return join_steps(rows, blocks).withColumnRenamed("digest", "leaf").drop("g", "pos", "n")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every document.

    Documents whose doc_id has an even crc32 are tampered with: their text loses its line feeds, and the root folded from the changed leaf tells. A null doc_id is
    not tampered with and comes first in its source; a null text stays null. Texts of any length are hashed whole; columns besides the five fields play no part."""
    fields = [F.col(name) for name in FIELDS]
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), leaf_digest([*fields[:-1], text]).alias("found"))
    folded = manifest(leaves, "source", ["doc_id"]).withColumn("folded_root", fold(F.col("found"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
