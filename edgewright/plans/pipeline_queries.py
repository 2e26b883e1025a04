"""Queries of the composite stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators import edges, pipeline
from edgewright.plans.edge_queries import ORACLE as EDGE_SQL
from edgewright.plans.edge_queries import STATED, shown
from edgewright.plans.lattice_queries import ORACLE as LATTICE_SQL
from edgewright.runtime import table


def reconcile(spark, d):
    return shown(pipeline.reconciled(edges.delivered_edges(table(spark, d, "merge_relations")), table(spark, d, "lattice_items")))


def heuristic_dedup(spark, d):
    return pipeline.heuristic_dedup(edges.delivered_edges(table(spark, d, "merge_relations")))


def anchor_totals_by_load(spark, d):
    e = edges.stated_edges(table(spark, d, "merge_relations"))
    return e.groupBy("load_no").agg(F.count("*").alias("n_edges"), F.sum(edges.n_anchors().cast("long")).alias("n_anchors"))


QUERIES = {"reconcile": reconcile, "heuristic_dedup": heuristic_dedup, "anchor_totals_by_load": anchor_totals_by_load}
ORACLE = {
    "reconcile": f"""with c as ({EDGE_SQL['corroborate']}), p as ({LATTICE_SQL['edge_subsumption']}), mb as ({LATTICE_SQL['edge_classes']}),
inh as (select specific_id, list_sort(list(distinct a)) as al from (select p.specific_id, unnest(r.anchor_list) as a from p join mb on mb.class_id = p.general_id join (select distinct on (rel_id) * from merge_relations) r using (rel_id)) where a is not null group by 1)
select first_id, subject, relation, dependency_kind, object, description, variants, anchor_list, loads, coalesce((select array_to_string(list_transform(al, lambda a: concat_ws('~', a.source, a.position, a.excerpt, a.explanation)), '|') from inh where specific_id = c.first_id), '') as inherited, corroboration, (select max(specific_id) from p where general_id = c.first_id) as subsumed_by, (select count(*) from p where specific_id = c.first_id) as n_subsumes from c""",
    "anchor_totals_by_load": f"with {STATED} select load_no, count(*) as n_edges, sum(na)::bigint as n_anchors from edges group by 1",
}
