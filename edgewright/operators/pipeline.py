"""Composite stages: reconcile, heuristic deduplication, release filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions import names
from edgewright.operators import dedup, edges, lattice
from edgewright.runtime import Stage


def reconciled(e: DataFrame, items: DataFrame) -> DataFrame:
    """Corroborated edges, each with the edge that subsumes it (the last more specific one), how many
    it subsumes, and in ``inherited`` the distinct anchors of those, sorted.  ``first_id`` is the edge's ordinal; edges off the lattice subsume nothing.

    Edges of equal identities form a class, known by its first edge, which stands for it in ``subsumed_by`` and the counts.
    """
    stage = Stage(e.sparkSession, "reconcile")
    merged = edges.corroborated(e)
    full = lattice.identified_edges(e, lattice.endpoint_identities(e, items))
    pairs = stage.write(lattice.edge_subsumption(full), "pairs")
    over = pairs.groupBy(F.col("general_id").alias("first_id")).agg(F.max("specific_id").alias("subsumed_by"))
    under = pairs.groupBy(F.col("specific_id").alias("first_id")).agg(F.count("*").alias("n_subsumes"))
    general = lattice.class_members(full).join(pairs.select(F.col("general_id").alias("class_id")).distinct(), "class_id", "left_semi")
    own = general.join(e.select("rel_id", F.explode(edges.anchors()).alias("a")), "rel_id").select("class_id", "a").distinct()
    passed = pairs.join(own, F.col("general_id") == F.col("class_id")).groupBy(F.col("specific_id").alias("first_id")).agg(F.array_sort(F.collect_set("a")).alias("inherited"))
    out = merged
    for more in (over, under, passed):
        out = out.join(more, "first_id", "left")
    none = F.array().cast(out.schema["anchor_list"].dataType)
    return out.select("first_id", "subject", "relation", "dependency_kind", "object", "description", "variants", "anchor_list", "loads", "corroboration", "subsumed_by", F.coalesce("n_subsumes", F.lit(0)).alias("n_subsumes"), F.coalesce("inherited", none).alias("inherited"))


def canonical_map(nodes: DataFrame) -> DataFrame:
    """``name, canonical`` by signature; names that name no artifact map to null.

    Names of one exact signature are a cluster.  A cluster without organisation joins, of those with one
    it can merge with, the one of greatest degree (ties: the smallest least name).
    """
    stage = Stage(nodes.sparkSession, "names")
    keys = list(dedup.signature_columns(F.col("name")))
    sig = nodes.select("name", "degree", names.categorical_drop(F.col("name")).alias("dropped"), *(c.alias(k) for k, c in dedup.signature_columns(F.col("name")).items()))
    sig = stage.write(sig, "signatures")
    kept = sig.where("not dropped").select("name", "degree", F.struct(*keys).alias("sig"))
    clusters = stage.write(kept.groupBy("sig").agg(F.sum("degree").alias("degree"), F.min("name").alias("least")), "clusters")
    bare = clusters.where("sig.org = ''").select(F.col("sig").alias("a"), F.col("sig.bare_collapsed").alias("form"))
    full = clusters.where("sig.org <> ''").select(F.col("sig").alias("b"), F.col("sig.bare_collapsed").alias("form"), "degree", "least")
    target = F.min_by("b", F.struct((-F.col("degree")).alias("d"), "least")).alias("target")
    folded = bare.join(full, "form").where(dedup.can_merge("a", "b")).groupBy(F.col("a").alias("sig")).agg(target)
    placed = stage.write(kept.join(folded, "sig", "left").select("name", "degree", F.xxhash64(F.coalesce("target", "sig")).alias("c1"), F.xxhash64(F.lit("sig"), F.coalesce("target", "sig")).alias("c2")), "placed")
    prefixed = F.col("name").contains("/") & ~F.col("name").startswith("/")
    best = F.max_by("name", F.struct(prefixed.alias("p"), "degree", F.length("name").alias("l"), "name"))
    named = placed.join(placed.groupBy("c1", "c2").agg(best.alias("canonical")), ["c1", "c2"]).select("name", "canonical")
    return named.unionByName(sig.where("dropped").select("name", F.lit(None).cast("string").alias("canonical")))


def heuristic_dedup(e: DataFrame, least_degree: int = 3) -> DataFrame:
    """Edges over canonical names, without concept-like names of fewer than ``least_degree`` edges."""
    stage = Stage(e.sparkSession, "dedup")
    canon = stage.write(canonical_map(dedup.node_table(e)), "canon")
    new = stage.write(edges.rewritten(e, canon).select("first_id", "subject", "relation", "object", "merged"), "edges")
    deg = new.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    concept = (F.col("node") != "") & ~F.col("node").rlike(r"[/\[(]") & (F.length("node") < 30) & F.col("node").rlike(r"^[A-Za-z][A-Za-z0-9\-\s_.]*$")
    low = deg.where(concept & (F.col("degree") < least_degree)).select("node")
    return new.join(low.withColumnRenamed("node", "subject"), "subject", "left_anti").join(low.withColumnRenamed("node", "object"), "object", "left_anti").select("first_id", "subject", "relation", "object", "merged")


def release_filter(e: DataFrame, decisions: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges after the nodes with decision DROP are taken out and chains through them rewired."""
    dropped = node_ids.join(decisions.where("decision = 'DROP'"), "id", "left_semi").select("node")
    return edges.rewired(e, dropped)
