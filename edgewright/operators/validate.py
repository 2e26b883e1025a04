"""Rule checks as tables of violations; every broken rule of every row is reported, not the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPENDENCY_KINDS = ("direct", "indirect")
ERRORS = ("no_subject", "no_object", "bad_relation", "bad_dependency_kind", "no_anchor", "faulty_anchor")


def is_label(c: Column) -> Column:
    """A relation label: letters and digits once ``_`` and ``-`` are dropped, at most 64 characters."""
    return c.rlike("^[A-Za-z0-9_-]*[A-Za-z0-9][A-Za-z0-9_-]*$") & (F.length(c) <= 64)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def edge_violations(relations: DataFrame) -> DataFrame:
    """``rel_id, rule, severity``: errors on endpoints, label, dependency kind and anchors, warnings on a
    missing description and a self-loop.  Each delivered rel_id is judged once."""
    r = relations.dropDuplicates(["rel_id"])
    anchors = F.coalesce("anchor_list", F.array().cast(relations.schema["anchor_list"].dataType))
    rules = {
        "no_subject": _blank(F.col("subject")), "no_object": _blank(F.col("object")), "bad_relation": ~F.coalesce(is_label(F.col("relation")), F.lit(False)),
        "bad_dependency_kind": ~F.coalesce(F.col("dependency_kind").isin(*DEPENDENCY_KINDS), F.lit(False)), "no_anchor": F.size(anchors) == 0,
        "faulty_anchor": F.exists(anchors, lambda a: a.isNull() | _blank(a["source"]) | _blank(a["explanation"])), "no_description": _blank(F.col("description")), "self_loop": F.coalesce(F.col("subject") == F.col("object"), F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return r.select("rel_id", F.explode(broken).alias("rule")).withColumn("severity", F.when(F.col("rule").isin(*ERRORS), "error").otherwise("warning"))


def names_commit(mentions: DataFrame) -> DataFrame:
    """``outcome, n`` of committing ``mentions(ord, kind, name)``: accepted once per (kind, name), else why not
    (blank_name, bad_kind, duplicate)."""
    m = mentions.select("ord", F.lower(F.trim("kind")).alias("kind"), F.trim("name").alias("name"))
    why = F.when(_blank(F.col("name")), "blank_name").when(~F.coalesce(F.col("kind").isin("model", "dataset"), F.lit(False)), "bad_kind")
    judged = m.withColumn("why", why)
    good = judged.where("why is null").groupBy("kind", "name").agg(F.count("*").alias("c"))
    kept = good.agg(F.count("*").alias("accepted"), (F.sum("c") - F.count("*")).alias("duplicate")).select(F.explode(F.array(F.struct(F.lit("accepted").alias("outcome"), F.col("accepted").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), F.coalesce("duplicate", F.lit(0)).alias("n")))).alias("x")).select("x.*")
    return kept.unionByName(judged.where("why is not null").groupBy(F.col("why").alias("outcome")).agg(F.count("*").alias("n")))


def attribution(e: DataFrame, pattern: str) -> DataFrame:
    """``rel_id, scope, tag``: edges whose anchor sources name one tag (first group of ``pattern``), several, or
    none; the tag is given where it is the only one."""
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("anchor_list", F.array().cast(e.schema["anchor_list"].dataType)), lambda a: F.regexp_extract(F.coalesce(a["source"], F.lit("")), pattern, 1)), lambda t: t != ""))
    t = e.select("rel_id", tags.alias("tags"))
    return t.select("rel_id", F.when(F.size("tags") == 0, "none").when(F.size("tags") == 1, "single").otherwise("shared").alias("scope"), F.when(F.size("tags") == 1, F.col("tags")[0]).alias("tag"))


def global_search(items: DataFrame, needle: str, most: int = 20) -> DataFrame:
    """Items with ``needle`` (two characters or more, any case) in name, alias, description, subset or a facet
    value: the first ``most`` by item_id."""
    low = needle.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    within = lambda c, f=lambda x: x: F.coalesce(F.exists(c, lambda x: F.coalesce(F.lower(f(x)).contains(low), F.lit(False))), F.lit(False))
    hit = has(F.col("formal_name")) | has(F.col("description")) | within("aliases") | within("subsets") | within("identity", lambda x: x["v"])
    return items.dropDuplicates(["item_id"]).where(hit & F.lit(len(low) >= 2)).orderBy("item_id").limit(most).select("item_id", "formal_name")
