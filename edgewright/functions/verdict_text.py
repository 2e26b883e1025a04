"""Judgement texts to rows: drop lists, cluster verdicts, keep/drop lines, JSON within prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_lines(texts: DataFrame) -> DataFrame:
    """``batch, id, tag, reason`` of lines ``DROP id :: TAG :: reason`` in ``texts(batch, ids, text)``; ids that
    aren't in the batch are left out."""
    line = texts.select("batch", "ids", F.explode(F.split("text", "\n")).alias("line"))
    got = F.regexp_extract
    pattern = r"^\s*DROP\s+(\d+)\s*::\s*([A-Za-z_]+)\s*(?:::\s*(.*?))?\s*$"
    return line.where(F.col("line").rlike(pattern)).select("batch", "ids", got("line", pattern, 1).cast("int").alias("id"), F.upper(got("line", pattern, 2)).alias("tag"), got("line", pattern, 3).alias("reason")).where(F.array_contains("ids", F.col("id"))).drop("ids").dropDuplicates(["batch", "id"])


def cluster_verdict(text: Column) -> Column:
    """ALL_SAME, PARTIAL, ALL_DISTINCT or UNPARSED by the first line."""
    first = F.upper(F.trim(F.substring_index(F.ltrim(text), "\n", 1)))
    return F.when(first.startswith("ALL_SAME"), "ALL_SAME").when(first.startswith("PARTIAL"), "PARTIAL").when(first.startswith("ALL_DISTINCT"), "ALL_DISTINCT").otherwise("UNPARSED")


def keep_lines(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, decision`` of ``nodes(id)``: the last KEEP or DROP line of an id holds, KEEP without one."""
    pattern = r"^\s*(KEEP|DROP)\s+(\d+)"
    line = texts.select("batch", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(pattern))
    said = line.select("batch", "n", F.regexp_extract("line", pattern, 2).cast("int").alias("id"), F.regexp_extract("line", pattern, 1).alias("said"))
    last = said.groupBy("id").agg(F.max(F.struct("batch", "n", "said")).alias("m"))
    return nodes.join(last, "id", "left").select("id", F.coalesce("m.said", F.lit("KEEP")).alias("decision"))


def first_json(text: Column) -> Column:
    """The JSON object from the first ``{`` to the last ``}``, null if it is none."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)
