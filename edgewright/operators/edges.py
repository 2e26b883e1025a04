"""Operators on provenance edges: statistics, audits, corroboration, merging, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import names

#: Role groups of the audit table.
AUDIT_ROLES = {
    "inputs": ("trained_on", "used_for_evaluation", "used_for_ablation"),
    "data_ops": ("generated_by", "filtered_by", "transformed_by", "embedded_by"),
    "weights": ("trained_from", "merged_from", "quantized_from"),
    "influence": ("inspired_by", "decontaminated_against"),
}
#: Relation pairs that a dropped middle node passes on, with the result.
REWIRE = (("trained_from", "trained_from", "trained_from"), ("trained_from", "merged_from", "trained_from"), ("merged_from", "trained_from", "trained_from"), ("trained_on", "trained_on", "trained_on"), ("filtered_by", "filtered_by", "filtered_by"))


def delivered_edges(relations: DataFrame) -> DataFrame:
    """One row per rel_id with a subject, relation and object; rel_id is the ordinal of all
    first-wins rules.  Rows of one rel_id are alike, whichever is taken."""
    cols = ["rel_id", "load_no", "subject", "relation", "dependency_kind", "object", "description", "anchor_list"]
    return relations.where("subject <> '' and object <> '' and relation <> ''").select(*cols).dropDuplicates(["rel_id"])


def stated_edges(relations: DataFrame) -> DataFrame:
    """One row per rel_id, whatever it has or lacks: what the audits count."""
    cols = ["rel_id", "load_no", "subject", "relation", "dependency_kind", "object", "description", "anchor_list"]
    return relations.where("rel_id is not null").select(*cols).dropDuplicates(["rel_id"])


def anchors() -> Column:
    """The anchors that are objects, in order; a null list has none."""
    return F.filter(F.coalesce("anchor_list", F.array()), lambda a: a.isNotNull())


def rendered(anchor_list: Column) -> Column:
    """An anchor list as one text, parts in ``~`` and anchors in ``|``; null parts are left out."""
    return F.array_join(F.transform(anchor_list, lambda a: F.concat_ws("~", a["source"], a["position"], a["excerpt"], a["explanation"])), "|")


def gathered(e: DataFrame, at: list[str]) -> DataFrame:
    """Edges of one key ``at`` merged, first wins, with all their evidence.

    ``first_id`` and ``dependency_kind`` and ``description`` of the first edge; ``texts``: the distinct descriptions in
    the order they first came; ``anchor_list``: all anchors in order, repeats kept; ``loads``: the loads that state it,
    in order; ``merged``: number of edges.  Edges are gathered per text before per key.
    """
    kinds = [] if "dependency_kind" in at else [F.min_by("dependency_kind", "rel_id").alias("dependency_kind")]
    rows = e.select("rel_id", "load_no", *at, *(["dependency_kind"] if kinds else []), F.nullif("description", F.lit("")).alias("text"), anchors().alias("own"))
    per_text = rows.groupBy(*at, "text").agg(F.min("rel_id").alias("ord"), F.count("*").alias("n"), F.collect_set("load_no").alias("loads"), *kinds, F.collect_list(F.when(F.size("own") > 0, F.struct("rel_id", "own"))).alias("evidence"))
    kinds = [F.min_by("dependency_kind", "ord").alias("dependency_kind")] if kinds else []
    merged = per_text.groupBy(*at).agg(
        F.min("ord").alias("first_id"), *kinds, F.min_by("text", "ord").alias("description"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))).alias("t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("loads")))).alias("loads"), F.array_sort(F.flatten(F.collect_list("evidence")), lambda x, y: F.when(x["rel_id"] < y["rel_id"], -1).when(x["rel_id"] > y["rel_id"], 1).otherwise(0)).alias("ev"), F.sum("n").alias("merged"),
    )
    return merged.select(*at, "first_id", *(["dependency_kind"] if kinds else []), "description", F.transform("t", lambda x: x["text"]).alias("texts"), F.flatten(F.transform("ev", lambda x: x["own"])).alias("anchor_list"), "loads", "merged")


def n_anchors() -> Column:
    """Anchors that are objects; a null list has none."""
    return F.coalesce(F.size(F.filter("anchor_list", lambda a: a.isNotNull())), F.lit(0))


def anchor_coverage(e: DataFrame) -> DataFrame:
    n = n_anchors()
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")
    return e.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_edges"), F.sum(n.cast("long")).alias("n_anchors"))


def hubs(e: DataFrame, side: str, k: int = 25) -> DataFrame:
    """The ``k`` nodes with most edges on ``side``; ties by name."""
    return e.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def relation_breakdown(e: DataFrame) -> DataFrame:
    n = n_anchors().cast("long")
    return e.groupBy("relation").agg(F.count("*").alias("n_edges"), F.sum((n == 0).cast("long")).alias("zero_anchor"), F.sum(n).alias("anchors"), F.round(F.avg(n), 9).alias("avg_anchors"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


def endpoint_degree(e: DataFrame) -> DataFrame:
    """``node, degree, first_ord``: edges at each node, and the first that names it."""
    ends = e.select(F.explode(F.array("subject", "object")).alias("node"), "rel_id")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.min("rel_id").alias("first_ord"))


def near_duplicate_names(e: DataFrame, k: int = 30) -> DataFrame:
    """Normal forms with several surfaces: the ``k`` with most, ties by form."""
    d = endpoint_degree(e).withColumn("form", names.lex_norm(F.col("node"))).where("form <> ''")
    return d.groupBy("form").agg(F.count("*").alias("surfaces"), F.sum("degree").alias("degree")).where("surfaces > 1").orderBy(F.desc("surfaces"), "form").limit(k)


def concept_edges(e: DataFrame) -> DataFrame:
    """Edges between two names that look like concepts."""
    return e.where(names.looks_like_concept(F.col("subject")) & names.looks_like_concept(F.col("object"))).select("rel_id", "subject", "relation", "object")


def weak_claims(e: DataFrame, common: int = 100) -> DataFrame:
    """Edges of a relation with ``common`` edges or more that have one anchor at most."""
    often = e.groupBy("relation").agg(F.count("*").alias("n")).where(F.col("n") >= common).select("relation")
    return e.where(n_anchors() <= 1).join(often, "relation", "left_semi").select("rel_id", "relation")


def multi_relation_pairs(e: DataFrame) -> DataFrame:
    return e.groupBy("subject", "object").agg(F.countDistinct("relation").alias("n_relations")).where("n_relations > 1")


def audit_roles(e: DataFrame) -> DataFrame:
    """Edges per audit role, dependency kind and relation with the share of all edges, totals by
    rollup (null role and kind); relations without a role count in the denominator only."""
    role = F.lit(None).cast("string")
    for r, labels in AUDIT_ROLES.items():
        role = F.when(F.col("relation").isin(*labels), r).otherwise(role)
    counted = e.withColumn("role", role).groupBy("role", F.lower("dependency_kind").alias("kind")).agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("all_edges"))
    rolled = counted.where("role is not null").rollup("role", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.sum("n").alias("n"))
    return rolled.join(F.broadcast(total), F.lit(True), "left").select("role", "kind", "n", "all_edges")


def source_types(e: DataFrame) -> DataFrame:
    """Edges per class of their anchors' sources: one class, ``multi``, or none (left out)."""
    kinds = F.array_distinct(F.filter(F.transform("anchor_list", lambda a: names.source_class(a["source"])), lambda k: k.isNotNull()))
    one = e.withColumn("kinds", kinds).where(F.size("kinds") > 0)
    return one.groupBy(F.when(F.size("kinds") > 1, "multi").otherwise(F.col("kinds")[0]).alias("source_type")).agg(F.count("*").alias("n_edges"))


def totals(e: DataFrame) -> DataFrame:
    nodes = e.select(F.explode(F.array("subject", "object")).alias("node")).where("node <> ''").distinct().agg(F.count("*").alias("n_nodes"))
    return e.agg(F.count("*").alias("n_edges"), F.sum(n_anchors().cast("long")).alias("n_anchors")).join(F.broadcast(nodes), F.lit(True), "left")


def corroborated(e: DataFrame) -> DataFrame:
    """Edges of one (subject, relation, kind, object): first description kept, later distinct ones
    as ``variants`` (none where the first has no description), anchors as a bag, loads that state it, number of statements."""
    at = ["subject", "relation", "dependency_kind", "object"]
    g = gathered(e.withColumn("dependency_kind", F.coalesce("dependency_kind", F.lit(""))), at)
    first = F.col("description")
    variants = F.when(first.isNotNull(), F.filter("texts", lambda t: t != first)).otherwise(F.array().cast("array<string>"))
    return g.select("first_id", *at, "description", variants.alias("variants"), "anchor_list", "loads", F.col("merged").alias("corroboration"))


def merged_relations(e: DataFrame) -> DataFrame:
    """Edges merged by (subject, relation, object); the first kind and description win; ``variants`` are all
    descriptions, the first included, where the first edge has one and another differs."""
    g = gathered(e, ["subject", "relation", "object"])
    variants = F.when(F.col("description").isNotNull() & (F.size("texts") > 1), F.col("texts")).otherwise(F.array().cast("array<string>"))
    return g.select("subject", "relation", "object", "first_id", "dependency_kind", "description", variants.alias("variants"), "anchor_list", "merged")


def description_conflicts(e: DataFrame) -> DataFrame:
    """One row per description of a merged edge that is new against those before it, with the variants by
    then (the first description is one of them); an edge whose first statement has no description has none."""
    m = merged_relations(e).where(F.size("variants") > 1)
    n = m.select("subject", "relation", "object", "variants", F.explode(F.sequence(F.lit(2), F.size("variants"))).alias("n_variants"))
    return n.select("subject", "relation", "object", F.slice("variants", 1, F.col("n_variants")).alias("variants"), "n_variants")


def _renamed(e: DataFrame, canon: DataFrame) -> DataFrame:
    c = canon.select("name", "canonical", F.lit(True).alias("known"))
    s = e.join(c.select(F.col("name").alias("subject"), F.col("canonical").alias("cs"), F.col("known").alias("ks")), "subject", "left")
    both = s.join(c.select(F.col("name").alias("object"), F.col("canonical").alias("co"), F.col("known").alias("ko")), "object", "left")
    pick = lambda name, mapped, known: F.when(F.col(known), F.col(mapped)).otherwise(F.col(name))
    return both.select("rel_id", "load_no", pick("subject", "cs", "ks").alias("subject"), "relation", pick("object", "co", "ko").alias("object"), "dependency_kind", "description", "anchor_list")


_NO_END = "subject is null or subject = '' or object is null or object = ''"


def rewritten(e: DataFrame, canon: DataFrame, cap_anchors: int | None = None) -> DataFrame:
    """Edges over canonical names: ``canon(name, canonical)`` is applied to both ends (unknown names
    stay, names mapped to null drop the edge), self-loops and edges without relation go, equal triples are merged: the first
    edge stays, anchors are appended and, where there are several edges, cut to ``cap_anchors`` if given."""
    new = _renamed(e, canon).where(f"not ({_NO_END}) and subject <> object and relation <> ''")
    g = gathered(new, ["subject", "relation", "object"])
    kept = F.col("anchor_list") if cap_anchors is None else F.when(F.col("merged") > 1, F.slice("anchor_list", 1, cap_anchors)).otherwise(F.col("anchor_list"))
    return g.select("subject", "relation", "object", "first_id", "dependency_kind", "description", kept.alias("anchor_list"), "merged")


def rewrite_losses(e: DataFrame, canon: DataFrame) -> DataFrame:
    """``dropped_endpoint, dropped_self``: edges :func:`rewritten` leaves out for an end that is missing or mapped
    to null, and as self-loops or for want of a relation."""
    lost = _renamed(e, canon).withColumn("no_end", F.expr(_NO_END))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return lost.agg(n(F.col("no_end"))("dropped_endpoint"), n(~F.col("no_end") & (F.coalesce("relation", F.lit("")).isin("") | (F.col("subject") == F.col("object"))))("dropped_self"))


#: Anchors a rewired edge takes over.
REWIRED_ANCHORS = 6


def rewired(e: DataFrame, dropped: DataFrame) -> DataFrame:
    """Edges after ``dropped(node)`` are taken out: those between kept nodes, equal triples merged with their anchors, and one for each pair
    in -> dropped -> out of compatible relations (one hop), unless an edge of its key is kept; it has the first
    ``REWIRED_ANCHORS`` anchors of its two edges.

    Of several paths with one key the first dropped node wins, then the first edges.
    """
    drop = dropped.select("node").distinct()
    kept = e.join(drop.withColumnRenamed("node", "subject"), "subject", "left_anti").join(drop.withColumnRenamed("node", "object"), "object", "left_anti")
    into = e.join(drop.withColumnRenamed("node", "object"), "object", "left_semi").join(drop.withColumnRenamed("node", "subject"), "subject", "left_anti")
    out = e.join(drop.withColumnRenamed("node", "subject"), "subject", "left_semi").join(drop.withColumnRenamed("node", "object"), "object", "left_anti")
    first = F.col("r1")
    result = F.lit(None).cast("string")
    for a, b, r in REWIRE:
        result = F.when((first == a) & (F.col("r2") == b), r).otherwise(result)
    start = F.slice(anchors(), 1, REWIRED_ANCHORS)
    paths = into.select(F.col("object").alias("via"), "subject", F.col("relation").alias("r1"), F.col("rel_id").alias("ord1"), start.alias("a1")).join(out.select(F.col("subject").alias("via"), "object", F.col("relation").alias("r2"), F.col("rel_id").alias("ord2"), start.alias("a2")), "via")
    order = F.struct("via", "ord1", "ord2")
    paths = paths.withColumn("relation", result).where("relation is not null").groupBy("subject", "relation", "object").agg(F.min("via").alias("via"), F.min_by(F.slice(F.concat("a1", "a2"), 1, REWIRED_ANCHORS), order).alias("anchor_list"))
    new = paths.join(kept.select("subject", "relation", "object").distinct(), ["subject", "relation", "object"], "left_anti")
    merged = gathered(kept, ["subject", "relation", "object"]).select("subject", "relation", "object", "dependency_kind", "description", "anchor_list", F.lit(None).cast("string").alias("via"))
    told = F.concat(F.lit("(rewired through "), F.col("via"), F.lit(")"))
    return merged.unionByName(new.select("subject", "relation", "object", F.lit("indirect").alias("dependency_kind"), told.alias("description"), "anchor_list", "via"))
