"""Graph operators over edges (subject, relation, object): reachability, components, expansion, views.

Every loop writes its frontier to a staged table, so plans stay short and no executor loss repeats
more than one round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.skew import meet
from edgewright.runtime import Stage

#: Relations that lead upstream, and expansion weights.
UPSTREAM = ("trained_on", "used_for_ablation", "generated_by", "filtered_by", "transformed_by", "embedded_by", "trained_from", "merged_from", "quantized_from", "inspired_by", "decontaminated_against")
WEIGHTS = {
    "trained_from": 8, "trained_on": 7, "generated_by": 6, "merged_from": 6, "transformed_by": 5, "filtered_by": 5, "composed_from": 5, "tokenized_by": 3, "deduplicated_by": 3,
    "decontaminated_by": 3, "released_with": 2, "inspired_by": 0, "used_for_ablation": -2, "used_for_evaluation": -4, "cited_as_baseline": -4,
}


def ancestors(e: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``seed, node, depth``: everything each of ``seeds(seed)`` reaches along upstream relations, the seed
    itself at depth 0.  A seed that is no node gives only itself; cycles end by the nodes seen.
    With ``max_depth``, nodes farther away are an error."""
    stage = Stage(e.sparkSession, "ancestors")
    arcs = stage.write(e.where(F.col("relation").isin(*UPSTREAM)).select("subject", "object").distinct(), "arcs")
    seen = front = stage.write(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).where("seed is not null").distinct(), "front")
    for depth in count(1):
        step = front.join(arcs, front.node == arcs.subject).select("seed", F.col("object").alias("node")).distinct()
        front = stage.write(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"ancestors farther than {max_depth} edges")
        seen = seen.unionByName(front)


def components(e: DataFrame) -> DataFrame:
    """``node, component``: the smallest node name of its undirected component.

    Contraction: each node points to its smallest neighbour if that is smaller, pointers jump until they
    reach a node that points nowhere, and the links between those make the next, smaller graph; at the end
    the maps of the rounds are composed.  Lookups go by one row per key with its number of rows, so hubs and
    giant components are split off.  Rows of a null end count for the other end only.
    """
    stage = Stage(e.sparkSession, "components")
    both = e.select(F.col("subject").alias("a"), F.col("object").alias("b")).where("a <> b")
    links = stage.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    nodes = e.select(F.explode(F.array("subject", "object")).alias("node")).where("node is not null").distinct()
    maps: list[DataFrame] = []
    n = links.count()
    while n:
        own = stage.write(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")).select("a", F.least("a", "m").alias("p"), "w"), "own")
        roots = _rooted(stage, own.select("a", "p"))
        maps.append(roots)
        ends = stage.write(roots.join(own.select("a", "w"), "a"), "ends")
        near = stage.write(meet(links, ends.select("a", F.col("p").alias("x"), "w"), ["a"], "w", n).select("b", "x"), "near")
        far = meet(near, ends.select(F.col("a").alias("b"), F.col("p").alias("y"), "w"), ["b"], "w", n)
        smaller = stage.write(far.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        stage.drop(links, own, ends, near)
        links, n = smaller, smaller.count()
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        told = m.groupBy("p").agg(F.count("*").alias("w")).join(whole.select(F.col("a").alias("p"), F.col("p").alias("top")), "p")
        whole = stage.write(meet(m, stage.write(told, "told"), ["p"], "w", m.count(), "left").select("a", F.coalesce("top", "p").alias("p")), "whole")
    return nodes.join(whole.select(F.col("a").alias("node"), "p"), "node", "left").select("node", F.coalesce("p", "node").alias("component"))


def _rooted(stage: Stage, pointers: DataFrame) -> DataFrame:
    """``a, p`` with every pointer at a node that points to itself; jumps double the distance."""
    p = stage.write(pointers, "pointers")
    n = p.count()
    while True:
        up = p.groupBy("p").agg(F.count("*").alias("w")).join(p.select(F.col("a").alias("p"), F.col("p").alias("far")), "p").where("far < p")
        up = stage.write(up.select("p", "far", "w"), "up")
        if up.isEmpty():
            return p
        new = stage.write(meet(p, up, ["p"], "w", n, "left").select("a", F.coalesce("far", "p").alias("p")), "pointers")
        stage.drop(p, up)
        p = new


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def resolve_seed(e: DataFrame, needle: str) -> DataFrame:
    """The node whose name holds ``needle`` (any case) with most edges, the greatest name on ties."""
    return degrees(e).where(F.lower("node").contains(needle.lower())).orderBy(F.desc("degree"), F.desc("node")).limit(1)


def edge_scores(e: DataFrame) -> DataFrame:
    """Edges with their expansion score: weight (1 if unknown), 2 more if direct, up to 3 for anchors."""
    weight = F.lit(1)
    for r, w in WEIGHTS.items():
        weight = F.when(F.col("relation") == r, w).otherwise(weight)
    n = F.coalesce(F.size("anchor_list"), F.lit(0))
    return e.withColumn("score", weight + F.when(F.col("dependency_kind") == "direct", 2).otherwise(0) + F.least(n, F.lit(3)))


def ego_expansion(e: DataFrame, seeds: DataFrame, rounds: int, budget: int) -> DataFrame:
    """``node, round, score``: the seed (``seeds(node)``, round 0) and what is admitted around it.

    In each round the neighbours of the last admitted nodes come in by best edge score, then degree in
    the input graph, then name, until ``budget`` nodes are kept.
    """
    stage = Stage(e.sparkSession, "ego")
    s = edge_scores(e)
    arcs = s.select(F.col("subject").alias("a"), F.col("object").alias("b"), "score").unionByName(s.select(F.col("object").alias("a"), F.col("subject").alias("b"), "score"))
    arcs = stage.write(arcs.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score")), "arcs")
    deg = stage.write(degrees(e), "degrees")
    kept = front = stage.write(seeds.select("node", F.lit(0).alias("round"), F.lit(None).cast("int").alias("score")).distinct(), "kept")
    n = kept.count()
    for r in range(1, max(1, rounds) + 1):
        if n >= budget or not n:
            break
        near = front.select(F.col("node").alias("a")).join(arcs, "a").groupBy(F.col("b").alias("node")).agg(F.max("score").alias("score"))
        new = near.join(kept.select("node"), "node", "left_anti").join(deg, "node", "left").orderBy(F.desc("score"), F.desc("degree"), "node").limit(budget - n)
        front = stage.write(new.select("node", F.lit(r).alias("round"), "score"), "front")
        added = front.count()
        if not added:
            break
        kept, n = kept.unionByName(front), n + added
    return kept


def pruned(e: DataFrame, min_degree: int, top: int | None = None) -> DataFrame:
    """Edges between nodes of at least ``min_degree`` edges, of the ``top`` by degree (ties by name)."""
    keep = degrees(e).where(F.col("degree") >= min_degree)
    if top is not None:
        keep = keep.orderBy(F.desc("degree"), "node").limit(top)
    k = keep.select("node")
    return e.join(k.withColumnRenamed("node", "subject"), "subject", "left_semi").join(k.withColumnRenamed("node", "object"), "object", "left_semi")


def visible_edges(e: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Edges of the main component (largest, smallest name on ties) of the given dependency kinds."""
    comp = components(e)
    main = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    nodes = comp.join(F.broadcast(main), "component", "left_semi").select("node")
    return e.where(F.lower("dependency_kind").isin(*kinds)).join(nodes.withColumnRenamed("node", "subject"), "subject", "left_semi")


def expansion_picks(e: DataFrame, expanded: DataFrame, strategy: str, top: int) -> DataFrame:
    """``node, votes``: what to expand next, the upstream nodes of ``expanded(node)`` not expanded yet by
    edges that lead to them: the first ``top`` for bfs, one for dfs; ties by name.  For beam see :func:`beam`."""
    up = e.where(F.col("relation").isin(*UPSTREAM)).join(expanded.select(F.col("node").alias("subject")), "subject", "left_semi")
    votes = up.groupBy(F.col("object").alias("node")).agg(F.count("*").alias("votes")).join(expanded.select("node"), "node", "left_anti")
    return votes.orderBy(F.desc("votes"), "node").limit(1 if strategy == "dfs" else top)


def beam(e: DataFrame, seeds: DataFrame, width: int, rounds: int) -> DataFrame:
    """``round, node, votes``: what a beam search expands in each round from ``seeds(node)``.

    A node gains a vote for each edge, of any relation, from a node expanded by then, in every round anew; votes add up over
    the rounds, and the ``width`` nodes of most votes not expanded yet are next (ties by name).
    """
    stage = Stage(e.sparkSession, "beam")
    arcs = stage.write(e.where("subject <> '' and object <> ''").groupBy("subject", "object").agg(F.count("*").alias("n")), "arcs")
    expanded = stage.write(seeds.select("node").distinct(), "expanded")
    history, out = None, None
    for r in range(1, rounds + 1):
        seen = arcs.join(expanded.withColumnRenamed("node", "subject"), "subject", "left_semi").groupBy(F.col("object").alias("node")).agg(F.sum("n").alias("votes"))
        seen = seen.join(expanded, "node", "left_anti")
        history = seen if history is None else history.unionByName(seen).groupBy("node").agg(F.sum("votes").alias("votes"))
        history = stage.write(history, "votes")
        picked = stage.write(history.join(expanded, "node", "left_anti").orderBy(F.desc("votes"), "node").limit(width).select(F.lit(r).alias("round"), "node", "votes"), "picked")
        out = picked if out is None else out.unionByName(picked)
        expanded = stage.write(expanded.unionByName(picked.select("node")), "expanded")
    return out


def ranked_hub_edges(e: DataFrame, hubs: DataFrame, cap: int = 200, batch: int = 40, side: str = "subject") -> DataFrame:
    """``hub, rel_id, batch_no``: the edges with a hub as ``side``, by anchors (most first), then ordinal, up to
    ``cap`` a hub, in batches."""
    n = F.coalesce(F.size("anchor_list"), F.lit(0))
    own = e.join(F.broadcast(hubs.select(F.col("node").alias(side))), side).select(F.col(side).alias("hub"), "rel_id", n.alias("n"))
    rank = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("n"), "rel_id"))
    return own.withColumn("r", rank).where(F.col("r") <= cap).select("hub", "rel_id", F.floor((F.col("r") - 1) / batch).cast("int").alias("batch_no"))


def audit_batches(e: DataFrame, out_hubs: DataFrame, in_hubs: DataFrame) -> DataFrame:
    """``hub, role, rel_id, batch_no``: batches of the hubs as subject and as object; a hub of both has both."""
    sides = [ranked_hub_edges(e, hubs, side=role).select("hub", F.lit(role).alias("role"), "rel_id", "batch_no") for role, hubs in (("subject", out_hubs), ("object", in_hubs))]
    return sides[0].unionByName(sides[1])
