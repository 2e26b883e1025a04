"""Records, filters and counts of the graph viewer: nodes of the lattice and off it, edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations the viewer knows.
KNOWN_RELATIONS = (
    "trained_on", "trained_from", "generated_by", "transformed_by", "filtered_by", "composed_from", "merged_from",
    "tokenized_by", "deduplicated_by", "decontaminated_by", "released_with", "inspired_by", "used_for_ablation", "used_for_evaluation",
)
#: Link kinds by rank; the first is shown.
LINK_RANK = ("hf_model", "hf_dataset", "vendor_docs", "paper", "github", "hf_collection", "blog")
#: Relations that are the backbone of a lineage, and those that only crowd it; others are context.
LINEAGE = ("trained_from", "trained_on", "generated_by", "transformed_by", "filtered_by", "merged_from", "composed_from", "tokenized_by", "deduplicated_by", "decontaminated_by")
NOISE = ("used_for_evaluation", "used_for_ablation", "cited_as_baseline")


def relation_class(c: Column) -> Column:
    return F.when(c.isin(*LINEAGE), "lineage").when(c.isin(*NOISE), "noise").otherwise("context")


def primary_link(links: Column) -> Column:
    """The link of the best ranked kind, the first of equals; kinds without rank are never chosen.  ``url, kind``."""
    ranks = F.array(*(F.lit(k) for k in LINK_RANK))
    placed = F.transform(links, lambda x, i: F.when(x.isNotNull() & (F.trim(x["url"]) != "") & x["kind"].isin(*LINK_RANK), F.struct(F.array_position(ranks, x["kind"]).alias("rank"), i.alias("i"), x["url"].alias("url"), x["kind"].alias("kind"))))
    best = F.array_min(F.filter(placed, lambda p: p.isNotNull()))
    return F.struct(F.coalesce(best["url"], F.lit("")).alias("url"), F.coalesce(best["kind"], F.lit("")).alias("kind"))


def lattice_nodes(lattice: DataFrame) -> DataFrame:
    """``id, kind, family, n_links, primary_url, primary_link_kind, description`` of each formal name; of several items the
    last one, by item_id, stands."""
    it = lattice.where("formal_name <> '' and item_id is not null").dropDuplicates(["item_id"])
    last = it.groupBy(F.col("formal_name").alias("id")).agg(F.max_by(F.struct("kind", "family", "links", "description"), "item_id").alias("i"))
    link = primary_link(F.col("i.links"))
    return last.select("id", "i.kind", F.coalesce("i.family", F.lit("")).alias("family"), F.coalesce(F.size("i.links"), F.lit(0)).alias("n_links"), link["url"].alias("primary_url"), link["kind"].alias("primary_link_kind"), F.coalesce("i.description", F.lit("")).alias("description"))


def edge_records(e: DataFrame, lattice: DataFrame) -> DataFrame:
    """``rel_id, subject_id, subject_in_lattice, object_id, object_in_lattice, relation, relation_class, known_relation,
    dependency_kind, n_anchors``: an end that is no formal name gets the id ``text::name``, a missing one ''."""
    names = lattice.where("formal_name <> ''").select(F.col("formal_name").alias("name")).distinct()
    side = lambda c: names.select(F.col("name").alias(c), F.lit(True).alias(f"{c}_in_lattice"))
    met = e.join(side("subject"), "subject", "left").join(side("object"), "object", "left")
    inside = lambda c: F.coalesce(f"{c}_in_lattice", F.lit(False))
    at = lambda c: F.when(inside(c), F.col(c)).when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise(F.concat(F.lit("text::"), c)).alias(f"{c}_id")
    known = F.coalesce(F.col("relation").isin(*KNOWN_RELATIONS), F.lit(False))
    return met.select(
        "rel_id", at("subject"), inside("subject").alias("subject_in_lattice"), at("object"), inside("object").alias("object_in_lattice"), "relation", relation_class(F.col("relation")).alias("relation_class"),
        known.alias("known_relation"), "dependency_kind", F.coalesce(F.size("anchor_list"), F.lit(0)).alias("n_anchors"),
    )


def node_records(records: DataFrame, lattice: DataFrame) -> DataFrame:
    """All nodes of :func:`edge_records` and the lattice with ``in_degree`` and ``out_degree``; an end off the lattice
    is a node of kind ``off_lattice``."""
    ends = records.select(F.explode(F.array(F.struct(F.col("subject_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*").where("id <> ''")
    degree = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    full = degree.join(lattice_nodes(lattice), "id", "full")
    off = F.col("kind").isNull() & F.col("family").isNull()
    text = F.expr("substring(id, 7)")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return full.select(
        "id", F.when(off, "off_lattice").otherwise(F.col("kind")).alias("kind"), F.when(off, "(off-lattice)").otherwise(F.col("family")).alias("family"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("primary_url", F.lit("")).alias("primary_url"), F.coalesce("primary_link_kind", F.lit("")).alias("primary_link_kind"), F.when(off, text).otherwise(F.col("description")).alias("description"), zero("in_degree"), zero("out_degree"),
    )


def stats(records: DataFrame, nodes: DataFrame, lattice: DataFrame) -> DataFrame:
    """``stat, name, n``: counts of nodes and edges, and the histograms of families, relations and dependency kinds."""
    one = lambda df, stat, c: df.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(stat).alias("stat"), "name", "n")
    items = lattice.where("item_id is not null").dropDuplicates(["item_id"])
    kinds = F.when(F.col("kind") == "off_lattice", "off_lattice_node").when(F.col("kind").isin("model", "dataset"), "lattice_node").otherwise("other_node")
    parts = [
        one(nodes, "nodes", kinds), one(records, "edges", F.when(F.col("known_relation"), "known_relation").otherwise("coined_relation")), one(items, "families", F.coalesce("family", F.lit(""))),
        one(records, "relations", F.coalesce("relation", F.lit(""))), one(records, "dependency_kinds", F.coalesce(F.nullif("dependency_kind", F.lit("")), F.lit("unknown"))), one(records, "relation_classes", F.col("relation_class")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def universe(nodes: DataFrame) -> DataFrame:
    """Nodes on the lattice that have a link."""
    return nodes.where("kind <> 'off_lattice' and n_links <> 0")


def view(records: DataFrame, nodes: DataFrame, node_kinds: tuple[str, ...], dependency_kinds: tuple[str, ...], relations: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(edges, nodes)`` shown under a filter: of the nodes on the lattice with a link, those of the given kinds and the
    nodes of other kinds next to one of them (bridges); the edges of the given kinds and relations (all, if none is given) between
    them; nodes without such an edge are left out."""
    start = universe(nodes)
    chosen = start.where(F.col("kind").isin(*node_kinds)).select("id")
    own = records.where(F.col("dependency_kind").isin(*dependency_kinds))
    own = own.where(F.col("relation").isin(*relations)) if relations else own
    near = records.join(chosen.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").select(F.col("object_id").alias("id"))
    near = near.unionByName(records.join(chosen.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(F.col("subject_id").alias("id")))
    shown = chosen.unionByName(start.select("id").join(near.distinct(), "id", "left_semi")).distinct()
    edges = own.join(shown.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(shown.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return edges, nodes.join(ends, "id", "left_semi")


def ego(records: DataFrame, centre: str) -> DataFrame:
    """Edges that touch one node."""
    return records.where((F.col("subject_id") == centre) | (F.col("object_id") == centre))


def evaluation_edges(e: DataFrame) -> DataFrame:
    """``rel_id, place, source, location, excerpt, explanation``: an edge's evidence as evaluation reads it, null parts as ''."""
    a = e.select("rel_id", F.posexplode("anchor_list").alias("place", "a")).where("a is not null")
    part = lambda c: F.coalesce(f"a.{c}", F.lit("")).alias
    return a.select("rel_id", "place", part("source")("source"), part("position")("location"), part("excerpt")("excerpt"), part("explanation")("explanation"))


def compact_rows(lattice: DataFrame) -> DataFrame:
    """``item_id, formal_name, family, kind, link, description``: the first link and at most 120 characters of text."""
    it = lattice.where("item_id is not null").dropDuplicates(["item_id"])
    return it.select("item_id", "formal_name", "family", "kind", F.get("links", F.lit(0))["url"].alias("link"), F.substring(F.coalesce("description", F.lit("")), 1, 120).alias("description"))


def relate_stats(e: DataFrame, lattice: DataFrame) -> DataFrame:
    """``edges, direct, indirect, coined, off_lattice_objects, subjects``: what a batch of relations consists of."""
    names = lattice.where("formal_name <> ''").select(F.col("formal_name").alias("object"), F.lit(True).alias("known")).distinct()
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    met = e.join(names, "object", "left")
    return met.agg(
        F.count("*").alias("edges"), n(F.col("dependency_kind") == "direct").alias("direct"), n(F.col("dependency_kind") == "indirect").alias("indirect"), n(~F.col("relation").isin(*KNOWN_RELATIONS)).alias("coined"),
        n(F.col("known").isNull() & (F.col("object") != "")).alias("off_lattice_objects"), F.countDistinct("subject").alias("subjects"),
    )
