"""Queries of the two general problems (hierarchies, heavy keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import hierarchy, hotkeys
from edgewright.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = hierarchy.combined_forest(spark, table(spark, sf_dir, "runs"), table(spark, sf_dir, "lattice_items"))
    return forest.select("node_kind", "node_id", "root_id", "depth")


def p2_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = hierarchy.combined_forest(spark, table(spark, sf_dir, "runs"), table(spark, sf_dir, "lattice_items"))
    return forest.select("node_kind", "node_id", "root_id", "depth", "pre", "size", (F.col("size") - 1).alias("n_descendants"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in the subtree of every run and item, itself included; null on loops."""
    return p2_ranges(spark, sf_dir).select("node_kind", "node_id", "size")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = hierarchy.paths(hierarchy.nested_sets(hierarchy.run_links(table(spark, sf_dir, "runs"))))
    return sets.select("id", F.array_join("path", "/").alias("path"), "depth")


def p2_node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of every run and item; :func:`p2_paths` is the side of the runs."""
    forest = hierarchy.paths(hierarchy.combined_forest(spark, table(spark, sf_dir, "runs"), table(spark, sf_dir, "lattice_items")))
    bare = F.transform("path", lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    return forest.select("node_kind", "node_id", F.array_join(bare, "/").alias("path"), "depth", "root_id")


def p2_node_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every run and item; :func:`p2_descendants` is the side of the items."""
    forest = hierarchy.combined_forest(spark, table(spark, sf_dir, "runs"), table(spark, sf_dir, "lattice_items"))
    bare = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)").alias(c)
    return hierarchy.descendants(forest).select(F.substring_index("ancestor", ":", 1).alias("node_kind"), bare("ancestor"), bare("descendant"), "distance")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.nested_sets(hierarchy.facet_links(table(spark, sf_dir, "lattice_items"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_endpoints(table(spark, sf_dir, "merge_relations"))


def p4_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.degrees(table(spark, sf_dir, "merge_relations"))


QUERIES = {f.__name__: f for f in (p2_found, p2_ranges, p2_sizes, p2_paths, p2_node_paths, p2_descendants, p2_node_descendants, p4_found, p4_degrees)}

_RUN_LINKS = r"""
links as (
  select l.id, case when p.id is null then null else l.parent end as parent from (
    select id, any_value(parent) as parent from (
      select lower(id) as id, nullif(regexp_replace(lower(coalesce(parent_run_id, '')), '^[\s{}]+|[\s{}]+$', '', 'g'), '') as parent,
             row_number() over (partition by id order by coalesce(ended_at, '') desc, coalesce(parent_run_id, '') desc) as r
      from runs where id is not null) where r = 1 group by id) l
  left join (select distinct lower(id) as id from runs) p on p.id = l.parent)
"""

_ITEM_LINKS = r"""
f0 as (select distinct item_id, lower(trim(coalesce(family, ''))) as family, identity from lattice_items where identity is not null and item_id is not null),
f1 as (select item_id, family, unnest(identity) as e from f0),
f2 as (select item_id, list_sort(list(distinct lower(trim(e.k)) || '=' || lower(regexp_replace(e.v, '^[\s]+|[\s]+$', '', 'g')))) as fs
       from f1 where lower(trim(e.k)) <> 'family' and trim(e.v) <> '' group by item_id),
its as (select f0.item_id, family, coalesce(fs, []) as fs from f0 left join f2 using (item_id)),
ipar as (select c.item_id, arg_min(p.item_id, (-len(p.fs)) * 1000000000 + p.item_id) as parent
         from its c join its p on c.family = p.family and len(p.fs) < len(c.fs) and list_has_all(c.fs, p.fs) group by c.item_id),
"""

_FOREST = "with recursive" + _RUN_LINKS + "," + _ITEM_LINKS + r"""al as (select 'run' as node_kind, id as node_id, parent from links
       union all select 'item', item_id::varchar, parent::varchar from its left join ipar using (item_id))"""
_WALK = """walk(node_kind, node_id, root_id, depth, path) as (
  select node_kind, node_id, node_id, 0, node_id from al where parent is null
  union all
  select a.node_kind, a.node_id, w.root_id, w.depth + 1, w.path || '/' || a.node_id from al a join walk w on a.node_kind = w.node_kind and a.parent = w.node_id)"""
_BELOW = """below(node_kind, ancestor, descendant, distance) as (
  select a.node_kind, a.parent, a.node_id, 1 from al a join walk w using (node_kind, node_id) where a.parent is not null
  union all
  select b.node_kind, p.parent, b.descendant, b.distance + 1 from below b join al p on p.node_kind = b.node_kind and p.node_id = b.ancestor where p.parent is not null)"""

ORACLE = {
    "p2_descendants": "with recursive" + _ITEM_LINKS.rstrip().rstrip(",") + """,
w(ancestor, descendant, distance) as (
  select parent, item_id, 1 from ipar
  union all
  select p.parent, w.descendant, w.distance + 1 from w join ipar p on p.item_id = w.ancestor)
select ancestor::varchar as ancestor, descendant::varchar as descendant, distance::int as distance from w""",
    "p2_paths": "with recursive" + _RUN_LINKS + """,
walk(id, path, depth) as (
  select id, id, 0 from links where parent is null
  union all
  select l.id, w.path || '/' || l.id, w.depth + 1 from links l join walk w on l.parent = w.id)
select l.id, w.path, coalesce(w.depth, -1)::int as depth from links l left join walk w on w.id = l.id""",
    "p2_found": f"{_FOREST}, {_WALK} select a.node_kind, a.node_id, coalesce(w.root_id, '') as root_id, coalesce(w.depth, -1)::int as depth from al a left join walk w using (node_kind, node_id)",
    "p2_node_paths": f"{_FOREST}, {_WALK} select a.node_kind, a.node_id, w.path, coalesce(w.depth, -1)::int as depth, coalesce(w.root_id, '') as root_id from al a left join walk w using (node_kind, node_id)",
    "p2_node_descendants": f"{_FOREST}, {_WALK}, {_BELOW} select node_kind, ancestor, descendant, distance::int as distance from below",
    "p2_sizes": f"{_FOREST}, {_WALK}, {_BELOW}, n as (select node_kind, ancestor as node_id, count(*) as c from below group by 1, 2) select a.node_kind, a.node_id, case when w.node_id is not null then coalesce(n.c, 0) + 1 end as size from al a left join walk w using (node_kind, node_id) left join n using (node_kind, node_id)",
    "p4_found": """
with l as (select 'subject' as field_name, subject as key_value from merge_relations
           union all select 'object', object from merge_relations)
select field_name, key_value from l where key_value <> '' group by all
having count(*) >= 0.02 * (select count(*) from merge_relations)""",
    "p4_degrees": """
with l as (select subject as artifact, relation, 1 as o, 0 as i from merge_relations
           union all select object, relation, 0, 1 from merge_relations)
select artifact, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, count(*) as degree, count(distinct relation) as n_relations
from l where artifact <> '' group by artifact""",
}
