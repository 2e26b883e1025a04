"""Queries of rule checks, name commits, attribution and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators import edges, validate
from edgewright.plans.edge_queries import EDGES
from edgewright.runtime import table

#: Stored sources carry the batch they came with.
BATCH_TAG = r"^store/([^/]+)/"


def edge_violations(spark, d):
    return validate.edge_violations(table(spark, d, "merge_relations"))


def names_commit(spark, d):
    return validate.names_commit(table(spark, d, "lattice_items").select(F.col("item_id").alias("ord"), "kind", F.col("formal_name").alias("name")))


def attribution_scopes(spark, d):
    return validate.attribution(edges.delivered_edges(table(spark, d, "merge_relations")), BATCH_TAG)


def global_search(spark, d):
    return validate.global_search(table(spark, d, "lattice_items"), "mid-training")


QUERIES = {f.__name__: f for f in (edge_violations, names_commit, attribution_scopes, global_search)}

_B = "({0} is null or trim({0}, ' ') = '')"
_ANCHORS = "len(list_filter(coalesce(anchor_list, []), lambda a: a is null or a.source is null or trim(a.source, ' ') = '' or a.explanation is null or trim(a.explanation, ' ') = '')) > 0"
ORACLE = {
    "edge_violations": f"""with r as (select distinct on (rel_id) * from merge_relations), v as (
select rel_id, 'no_subject' as rule from r where {_B.format('subject')} union all select rel_id, 'no_object' from r where {_B.format('object')}
union all select rel_id, 'bad_relation' from r where not coalesce(regexp_full_match(relation, '[A-Za-z0-9_-]*[A-Za-z0-9][A-Za-z0-9_-]*') and length(relation) <= 64, false)
union all select rel_id, 'bad_dependency_kind' from r where not coalesce(dependency_kind in ('direct', 'indirect'), false) union all select rel_id, 'no_anchor' from r where coalesce(len(anchor_list), 0) = 0
union all select rel_id, 'faulty_anchor' from r where {_ANCHORS} union all select rel_id, 'no_description' from r where {_B.format('description')} union all select rel_id, 'self_loop' from r where subject = object)
select rel_id, rule, case when rule in ('no_description', 'self_loop') then 'warning' else 'error' end as severity from v""",
    "names_commit": """with m as (select lower(trim(kind, ' ')) as kind, trim(formal_name, ' ') as name from lattice_items), j as (select *, case when name is null or name = '' then 'blank_name' when not coalesce(kind in ('model', 'dataset'), false) then 'bad_kind' end as why from m),
g as (select kind, name, count(*) as c from j where why is null group by 1, 2)
select 'accepted' as outcome, count(*) as n from g union all select 'duplicate', coalesce(sum(c - 1), 0)::bigint from g union all select why, count(*) from j where why is not null group by 1""",
    "attribution_scopes": f"""with {EDGES}, a as (select rel_id, regexp_extract(x.source, '{BATCH_TAG}', 1) as t from (select rel_id, unnest(anchor_list) as x from edges) where x is not null), g as (select rel_id, count(distinct t) as n, min(t) as t from a where t <> '' group by 1)
select e.rel_id, case when n is null then 'none' when n = 1 then 'single' else 'shared' end as scope, case when n = 1 then t end as tag from edges e left join g using (rel_id)""",
    "global_search": """with i as (select distinct on (item_id) * from lattice_items) select item_id, formal_name from i where contains(lower(formal_name), 'mid-training') or contains(lower(description), 'mid-training')
or len(list_filter(aliases, lambda a: contains(lower(a), 'mid-training'))) > 0 or len(list_filter(subsets, lambda a: contains(lower(a), 'mid-training'))) > 0 or len(list_filter(identity, lambda a: contains(lower(a.v), 'mid-training'))) > 0 order by item_id limit 20""",
}
