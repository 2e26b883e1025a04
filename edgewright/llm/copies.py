"""Collapse rows that differ in formatting only, and count the copies.

Method: recursive radix partitioning on canonical bytes.  Rows are combined per Arrow batch into
states (key, first id, rows), so a key that holds a third of all rows sends one state per batch, not
its rows.  The states are spread by the first bytes of their keys; a bucket above ``bucket_rows``
states is split by further bytes until it fits or its bytes are used up, and each task counts its
buckets in a trie over the key bytes with counters at the terminals.

The oversized prefixes, at most depth * states / bucket_rows, are a staged table: the prefixes of several
lengths are counted in one pass, and the next pass looks below the oversized ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.llm import canon
from edgewright.operators.skew import meet
from edgewright.runtime import Stage, small

SEP = "\u001f"
BUCKET_ROWS = 50_000
STEP = 4
#: Lengths of prefixes counted in one pass.
PASS_LEVELS = 4
#: Most oversized prefixes that are broadcast.
PREFIX_ROWS = 200_000
CHUNK = 8

_STATES = "key string, first_id string, n long"


def edge_rows(relations: DataFrame) -> DataFrame:
    """``rel_id, key`` of each row with a subject and an object.

    A null or blank endpoint is none, and its row is left out, as is a row of null rel_id; endpoints
    of punctuation only are alike; a null relation equals a null relation only.  Rows delivered
    twice under one rel_id stay twice here.
    """
    named = stated(relations).select("rel_id", "relation", canon.prepared(F.col("subject")).alias("s"), canon.prepared(F.col("object")).alias("o"))
    keyed = named.select("rel_id", "relation", canon.canonical(F.col("s")).alias("s"), canon.canonical(F.col("o")).alias("o"))
    return keyed.select(F.col("rel_id").cast("string").alias("rel_id"), F.concat_ws(SEP, "s", "o", label(F.col("relation"))).alias("key"))


def stated(relations: DataFrame) -> DataFrame:
    """Rows with a rel_id, a subject and an object."""
    return relations.where("rel_id is not null and subject rlike '(?U)\\\\S' and object rlike '(?U)\\\\S'")


def label(relation: Column) -> Column:
    """The relation as part of a key; null has a value of its own."""
    return F.coalesce(relation, F.lit("\u0001"))


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        states: dict[str, list] = {}
        for key, rid in zip(b["key"].tolist(), b["rel_id"].tolist()):
            s = states.get(key)
            if s is None:
                states[key] = [rid, 1]
            else:
                s[1] += 1
                if rid < s[0]:
                    s[0] = rid
        yield pd.DataFrame({"key": list(states), "first_id": [s[0] for s in states.values()], "n": [s[1] for s in states.values()]})


class Trie:
    """Path-compressed trie over byte strings: an entry is a leaf (rest, first, n, key) until a
    second key with the same chunk comes, which bursts it into a node."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, first: str, n: int) -> None:
        b, node, i = key.encode(), self.root, 0
        while True:
            chunk = b[i : i + CHUNK]
            i += CHUNK
            entry = node.get(chunk)
            if entry is None:
                node[chunk] = [b[i:], first, n, key]
                return
            if type(entry) is list:
                if entry[0] == b[i:]:
                    entry[2] += n
                    if first < entry[1]:
                        entry[1] = first
                    return
                rest = entry[0]
                entry[0] = rest[CHUNK:]
                node[chunk] = entry = {rest[:CHUNK]: entry}
            node = entry

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for entry in stack.pop().values():
                if type(entry) is list:
                    yield entry
                else:
                    stack.append(entry)


def _count_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for b in batches:
        for key, first, n in zip(b["key"].tolist(), b["first_id"].tolist(), b["n"].tolist()):
            trie.add(key, first, n)
    block: list = []
    for t in trie.terminals():
        block.append((t[3], t[1], t[2]))
        if len(block) == 20_000:
            yield pd.DataFrame(block, columns=["key", "first_id", "n"])
            block = []
    yield pd.DataFrame(block, columns=["key", "first_id", "n"])


def oversized(stage: Stage, states: DataFrame, bucket_rows: int) -> tuple[list[DataFrame], int]:
    """``(tables, levels)``: staged ``level, p, c`` of the prefixes of ``STEP * level`` letters that more than
    ``bucket_rows`` longer keys share, and the deepest such level."""
    tables: list[DataFrame] = []
    part, base = states.select("key"), 0
    while True:
        levels = F.explode(F.transform(F.sequence(F.lit(base + 1), F.lit(base + PASS_LEVELS)), lambda i: F.struct(i.alias("level"), F.substring("key", F.lit(1), i * STEP).alias("p"), (F.length("key") > i * STEP).alias("more"))))
        seen = part.select(levels.alias("s")).select("s.*").where(F.col("more"))
        big = seen.groupBy("level", "p").agg(F.count("*").alias("c")).where(F.col("c") > bucket_rows).select("level", "p", "c")
        big = stage.write(big, "oversized")
        deepest = big.agg(F.max("level")).first()[0]
        if deepest is None:
            return tables, base
        tables.append(big)
        if deepest < base + PASS_LEVELS:
            return tables, deepest
        base += PASS_LEVELS
        below = big.where(F.col("level") == base).select("p", "c")
        part = meet(states.select("key", F.substring("key", 1, STEP * base).alias("p")), below, ["p"], "c", states.count()).select("key")


def with_radix(stage: Stage, states: DataFrame, tables: list[DataFrame], levels: int) -> DataFrame:
    """``states`` with ``radix``: the shortest prefix (in steps) of the key that is no oversized bucket.

    Level by level the prefix is looked up in the staged table, which is broadcast if it has at most
    ``PREFIX_ROWS`` rows and otherwise met in a shuffle with its hot prefixes split off, staged per level.
    """
    out = states.withColumn("radix", F.substring("key", 1, STEP)).withColumn("open", F.lit(True))
    if not tables:
        return out.drop("open")
    big = tables[0]
    for t in tables[1:]:
        big = big.unionByName(t)
    few, total = small(big, PREFIX_ROWS), None if not levels else states.count()
    for level in range(1, levels + 1):
        at = big.where(F.col("level") == level).select(F.col("p").alias("radix"), "c", F.lit(True).alias("split"))
        out = out.join(F.broadcast(at.drop("c")), "radix", "left") if few else stage.write(meet(out, at, ["radix"], "c", total, "left"), "radix")
        further = F.col("open") & F.col("split").isNotNull()
        out = out.withColumn("radix", F.when(further, F.substring("key", 1, STEP * (level + 1))).otherwise(F.col("radix"))).withColumn("open", further).drop("split")
    return out.drop("open")


def radix_count(stage: Stage, rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``key, first_id, n`` of ``rows(rel_id, key)``: one row per key, with its smallest id and the
    number of its rows.  An empty input gives no row."""
    states = stage.write(rows.select("key", "rel_id").mapInPandas(_combine, _STATES), "states")
    total = states.count()
    tables, levels = oversized(stage, states, bucket_rows) if total > bucket_rows else ([], 0)
    tasks = max(1, -(-2 * total // bucket_rows))
    spread = with_radix(stage, states, tables, levels).repartition(tasks, "radix").drop("radix")
    return spread.mapInPandas(_count_bucket, _STATES)


def _ids(key: str = "key") -> list[Column]:
    """A 128-bit fingerprint of the key, in place of the long text in joins."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("edge"), F.col(key)).alias("h2")]


def first_of_each(stage: Stage, relations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(groups, members)`` of the copies among ``relations``.

    groups: ``key, first_id, n``; members: ``first_id, rel_id`` of each row but the first of its
    group, without repeats.

    Groups of more than 1/1000 of all rows, of which there are at most 1000, are broadcast to their
    rows; the others meet them in a shuffle on the fingerprint.  So no task gets all rows of a hot
    group.
    """
    rows = stage.write(edge_rows(relations), "rows")
    groups = stage.write(radix_count(stage, rows, bucket_rows), "groups")
    total = rows.count()
    several = stage.write(groups.where("n > 1").select(*_ids(), "first_id", "n"), "several")
    met = meet(rows.select("rel_id", *_ids()), several, ["h1", "h2"], "n", total)
    members = met.where("rel_id <> first_id").groupBy("rel_id").agg(F.min("first_id").alias("first_id")).select("first_id", "rel_id")
    return groups, members


def found(relations: DataFrame) -> DataFrame:
    """``rel_a, rel_b``: smallest rel_id of each group of copies, and each other one."""
    _, members = first_of_each(Stage(relations.sparkSession, "copies"), relations)
    return members.select(F.col("first_id").alias("rel_a"), F.col("rel_id").alias("rel_b"))


def collapsed(relations: DataFrame) -> DataFrame:
    """``rel_id, subject, object, relation, copies``: one row per edge, in canonical writing, with
    the number of distinct rel_id that state it."""
    stage = Stage(relations.sparkSession, "copies")
    groups, members = first_of_each(stage, relations)
    others = members.groupBy("first_id").agg(F.count("*").alias("others"))
    cut = F.split("key", SEP)
    return groups.join(others, "first_id", "left").select(
        F.col("first_id").alias("rel_id"), F.replace(cut[0], F.lit(canon.POINT), F.lit(".")).alias("subject"), F.replace(cut[1], F.lit(canon.POINT), F.lit(".")).alias("object"), F.nullif(cut[2], F.lit("\u0001")).alias("relation"), (F.coalesce("others", F.lit(0)) + 1).alias("copies")
    )
