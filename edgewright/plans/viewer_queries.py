"""Queries of the viewer's records, filters and counts, and of evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import edges as E
from edgewright.operators import viewer as V
from edgewright.plans.edge_queries import STATED
from edgewright.runtime import table


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return E.stated_edges(table(spark, d, "merge_relations")), table(spark, d, "lattice_items")


def viewer_edges(spark, d):
    return V.edge_records(*_parts(spark, d))


def viewer_nodes(spark, d):
    e, items = _parts(spark, d)
    return V.node_records(V.edge_records(e, items), items)


def viewer_stats(spark, d):
    e, items = _parts(spark, d)
    records = V.edge_records(e, items)
    return V.stats(records, V.node_records(records, items), items)


def viewer_universe(spark, d):
    """Nodes the viewer starts from: on the lattice, with a link."""
    e, items = _parts(spark, d)
    return V.universe(V.node_records(V.edge_records(e, items), items)).select("id", "kind", "primary_url")


def viewer_ego(spark, d):
    """Edges at the object of most edges."""
    e, items = _parts(spark, d)
    top = E.hubs(e.where("object <> ''"), "object", 1).first()
    records = V.edge_records(e, items)
    if top is None:
        return records.limit(0).select("rel_id")
    return V.ego(records, top.node).unionByName(V.ego(records, f"text::{top.node}")).select("rel_id")


def evaluation_edges(spark, d):
    return V.evaluation_edges(_parts(spark, d)[0])


def lattice_rows(spark, d):
    return V.compact_rows(table(spark, d, "lattice_items"))


def relate_stats(spark, d):
    return V.relate_stats(*_parts(spark, d))


QUERIES = {f.__name__: f for f in (viewer_edges, viewer_nodes, viewer_stats, viewer_universe, viewer_ego, evaluation_edges, lattice_rows, relate_stats)}

_IN = "(select distinct formal_name from lattice_items where formal_name <> '')"
_REC = f"""{STATED}, fn as {_IN}, rec as (select rel_id, case when s.formal_name is not null then subject when coalesce(subject, '') = '' then '' else 'text::' || subject end as subject_id, s.formal_name is not null as subject_in_lattice,
case when o.formal_name is not null then object when coalesce(object, '') = '' then '' else 'text::' || object end as object_id, o.formal_name is not null as object_in_lattice, relation,
case when relation in {V.LINEAGE!r} then 'lineage' when relation in {V.NOISE!r} then 'noise' else 'context' end as relation_class, coalesce(relation in {V.KNOWN_RELATIONS!r}, false) as known_relation, dependency_kind, coalesce(len(anchor_list), 0)::int as n_anchors
from edges left join fn s on s.formal_name = subject left join fn o on o.formal_name = object)"""
_RANK = "list_position(['" + "', '".join(V.LINK_RANK) + "'], x.kind)"
_NODE = f"""{_REC}, li as (select distinct on (item_id) * from lattice_items where item_id is not null), ln as (select formal_name as id, arg_max(struct_pack(kind := kind, family := family, links := links, description := description), item_id) as i from li where formal_name <> '' group by 1),
lk as (select id, x, k from (select id, unnest(i.links) as x, unnest(range(len(i.links))) as k from ln) where x is not null and trim(x.url) <> '' and {_RANK} is not null and {_RANK} > 0),
best as (select id, arg_min(x, {_RANK} * 1000000 + k) as x from lk group by 1),
dg as (select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select subject_id as id, 0 as i, 1 as o from rec union all select object_id, 1, 0 from rec) where id <> '' group by 1),
nodes as (select coalesce(dg.id, ln.id) as id, case when ln.id is null then 'off_lattice' else ln.i.kind end as kind, case when ln.id is null then '(off-lattice)' else coalesce(ln.i.family, '') end as family, coalesce(len(ln.i.links), 0)::int as n_links,
coalesce(best.x.url, '') as primary_url, coalesce(best.x.kind, '') as primary_link_kind, case when ln.id is null then substring(dg.id, 7) else coalesce(ln.i.description, '') end as description, coalesce(in_degree, 0) as in_degree, coalesce(out_degree, 0) as out_degree
from dg full join ln on ln.id = dg.id left join best on best.id = ln.id)"""

ORACLE = {
    "viewer_edges": f"with {_REC} select * from rec",
    "viewer_nodes": f"with {_NODE} select * from nodes",
    "viewer_stats": f"""with {_NODE} select 'nodes' as stat, case when kind = 'off_lattice' then 'off_lattice_node' when kind in ('model', 'dataset') then 'lattice_node' else 'other_node' end as name, count(*) as n from nodes group by 2
union all select 'edges', case when known_relation then 'known_relation' else 'coined_relation' end, count(*) from rec group by 2 union all select 'families', coalesce(family, ''), count(*) from li group by 2
union all select 'relations', coalesce(relation, ''), count(*) from rec group by 2 union all select 'dependency_kinds', coalesce(nullif(dependency_kind, ''), 'unknown'), count(*) from rec group by 2 union all select 'relation_classes', relation_class, count(*) from rec group by 2""",
    "viewer_universe": f"with {_NODE} select id, kind, primary_url from nodes where kind <> 'off_lattice' and n_links <> 0",
    "viewer_ego": f"with {STATED}, top as (select object as node from edges where object <> '' group by 1 order by count(*) desc, 1 limit 1) select rel_id from edges where subject = (select node from top) or object = (select node from top)",
    "evaluation_edges": f"with {STATED}, a as (select rel_id, unnest(anchor_list) as a, unnest(range(len(anchor_list)))::int as place from edges) select rel_id, place, coalesce(a.source, '') as source, coalesce(a.position, '') as location, coalesce(a.excerpt, '') as excerpt, coalesce(a.explanation, '') as explanation from a where a is not null",
    "lattice_rows": "select item_id, formal_name, family, kind, links[1].url as link, substring(coalesce(description, ''), 1, 120) as description from (select distinct on (item_id) * from lattice_items where item_id is not null)",
    "relate_stats": f"with {STATED}, fn as {_IN} select count(*) as edges, count(*) filter (where dependency_kind = 'direct') as direct, count(*) filter (where dependency_kind = 'indirect') as indirect, count(*) filter (where relation not in {V.KNOWN_RELATIONS!r}) as coined, count(*) filter (where object <> '' and fn.formal_name is null) as off_lattice_objects, count(distinct subject) as subjects from edges left join fn on fn.formal_name = object",
}
