"""Texts and batches that outside judges are given: sample anchors, hub batches, node batches, candidate clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import names
from edgewright.runtime import Stage


def _cut(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def sample_anchors(e: DataFrame) -> DataFrame:
    """``node, anchor``: of each endpoint the source of the first anchor of its first edge that has anchors, at most 140
    characters; nodes without such an edge are left out."""
    held = e.where(F.size("anchor_list") > 0).select("rel_id", F.col("anchor_list")[0]["source"].alias("source"), F.explode(F.array("subject", "object")).alias("node"))
    return held.where("node <> ''").groupBy("node").agg(_cut(F.min_by("source", F.struct("rel_id")), 140).alias("anchor"))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``no``: the place of each row in the order of ``by``, from 0, equal values in any order.

    Rows are sorted in ranges and counted per range; only the counts of the ranges are summed in one task.
    """
    stage = Stage(df.sparkSession, "numbered")
    low = stage.write(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = low.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = low.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row per range
    return placed.withColumn("no", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, "no")


def node_batches(nodes: DataFrame, e: DataFrame, size: int = 20) -> DataFrame:
    """``batch_no, no, line``: every node of ``nodes(name, degree)`` by name, in batches, as a judge reads it."""
    told = numbered(nodes.select("name", "degree"), "name").join(sample_anchors(e).withColumnRenamed("node", "name"), "name", "left")
    line = F.concat(F.lit("  ["), F.col("no"), F.lit("] "), F.col("name"), F.lit("    (degree="), F.col("degree"), F.lit(", sample_anchor="), F.coalesce("anchor", F.lit("(none)")), F.lit(")"))
    return told.select(F.floor(F.col("no") / size).alias("batch_no"), "no", line.alias("line"))


def hub_texts(batches: DataFrame, e: DataFrame) -> DataFrame:
    """``hub, role, batch_no, text`` of ``batches(hub, role, rel_id, batch_no)``: the edges of a batch, by anchors and
    ordinal, under local numbers, sources cut to 120 and descriptions to 160 characters."""
    full = batches.join(e.select("rel_id", "subject", "relation", "object", "description", F.size(F.coalesce("anchor_list", F.array())).alias("n"), F.get("anchor_list", F.lit(0))["source"].alias("source")), "rel_id")
    rank = F.row_number().over(Window.partitionBy("hub", "role", "batch_no").orderBy(F.desc("n"), "rel_id")) - 1
    arrow = F.concat(F.lit("--["), F.col("relation"), F.lit("]-->"))
    link = F.when(F.col("role") == "subject", F.concat(arrow, F.lit(" "), F.col("object"))).otherwise(F.concat(F.col("subject"), F.lit(" "), arrow))
    source, told = _cut(F.col("source"), 120), _cut(F.col("description"), 160)
    line = F.concat(
        F.lit("  ["), F.lpad(F.col("i").cast("string"), 3, " "), F.lit("] "), link, F.lit("   anchors="), F.col("n"), F.when(source != "", F.concat(F.lit("  src="), source)).otherwise(""),
        F.when(told != "", F.concat(F.lit("\n           desc: "), told)).otherwise(""),
    )
    lines = full.withColumn("i", rank).withColumn("line", line).groupBy("hub", "role", "batch_no").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    head = F.concat(F.lit("HUB ("), F.col("role"), F.lit("-side): "), F.col("hub"), F.lit("\n\nEdges ("), F.size("l"), F.lit("):\n"))
    return lines.select("hub", "role", "batch_no", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def lex_blocks(nodes: DataFrame, most: int = 6) -> DataFrame:
    """``lex, block_no, name``: names of one collapsed form as candidate clusters of at most ``most``, by degree, then name;
    of more names each block holds the first one and the next ``most - 1``."""
    x = nodes.select("name", "degree", names.lex_collapse(F.col("name")).alias("lex")).where("lex <> ''")
    several = x.groupBy("lex").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("lex").orderBy(F.desc("degree"), "name"))
    r = x.join(several, "lex").withColumn("r", rank)
    last = F.when(F.col("n") <= most, 0).otherwise(F.ceil((F.col("n") - 1) / (most - 1)) - 1).cast("int")
    own = F.when(F.col("n") <= most, 0).otherwise(F.floor((F.col("r") - 2) / (most - 1))).cast("int")
    return r.select("lex", F.explode(F.when(F.col("r") == 1, F.sequence(F.lit(0), last)).otherwise(F.array(own))).alias("block_no"), "name")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """``size, n_blocks``."""
    return blocks.groupBy("lex", "block_no").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_blocks"))
