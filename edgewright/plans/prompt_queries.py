"""Queries of the texts and batches for outside judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgewright.operators import dedup, prompts
from edgewright.operators import edges as E
from edgewright.plans.edge_queries import EDGES, ENDS
from edgewright.plans.graph_queries import ORACLE as GRAPH_SQL
from edgewright.plans.graph_queries import hub_audit_batches
from edgewright.runtime import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return E.delivered_edges(table(spark, d, "merge_relations"))


def sample_anchors(spark, d):
    return prompts.sample_anchors(_edges(spark, d))


def release_batches(spark, d):
    e = _edges(spark, d)
    return prompts.node_batches(dedup.node_table(e), e)


def hub_texts(spark, d):
    return prompts.hub_texts(hub_audit_batches(spark, d), _edges(spark, d))


def lex_blocks(spark, d):
    return prompts.lex_blocks(dedup.node_table(_edges(spark, d)))


def lex_block_sizes(spark, d):
    return prompts.block_sizes(lex_blocks(spark, d))


QUERIES = {f.__name__: f for f in (sample_anchors, release_batches, hub_texts, lex_blocks, lex_block_sizes)}

_SAMPLE = "sa as (select node, substring(coalesce(arg_min_null(source, rel_id), ''), 1, 140) as anchor from (select rel_id, anchor_list[1].source as source, unnest([subject, object]) as node from edges where len(anchor_list) > 0) group by 1)"
_BLOCKS = f"""{EDGES}, {ENDS}, nodes as (select node as name, count(*) as degree from ends group by 1), x as (select name, degree, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as lex from nodes),
r as (select *, count(*) over (partition by lex) as n, row_number() over (partition by lex order by degree desc, name) as r from x where lex <> ''),
blocks as (select lex, unnest(case when r = 1 then range(case when n <= 6 then 1 else ceil((n - 1) / 5.0)::bigint end) when n <= 6 then [0] else [(r - 2) // 5] end)::int as block_no, name from r where n > 1)"""
ORACLE = {
    "sample_anchors": f"with {EDGES}, {_SAMPLE} select * from sa",
    "release_batches": f"""with {EDGES}, {ENDS}, {_SAMPLE}, n as (select node as name, count(*) as degree, row_number() over (order by node) - 1 as no from ends group by 1)
select no // 20 as batch_no, no, '  [' || no || '] ' || name || '    (degree=' || degree || ', sample_anchor=' || coalesce(anchor, '(none)') || ')' as line from n left join sa on sa.node = n.name""",
    "hub_texts": f"""with {EDGES}, b as ({GRAPH_SQL['hub_audit_batches']}), f as (select b.*, subject, relation, object, substring(coalesce(description, ''), 1, 160) as told, coalesce(len(anchor_list), 0) as n, substring(coalesce(anchor_list[1].source, ''), 1, 120) as src from b join edges using (rel_id)),
i as (select *, row_number() over (partition by hub, role, batch_no order by n desc, rel_id) - 1 as i from f),
l as (select hub, role, batch_no, i, '  [' || lpad(i::varchar, 3, ' ') || '] ' || case when role = 'subject' then '--[' || relation || ']--> ' || object else subject || ' --[' || relation || ']-->' end || '   anchors=' || n || case when src <> '' then '  src=' || src else '' end || case when told <> '' then chr(10) || '           desc: ' || told else '' end as line from i)
select hub, role, batch_no, 'HUB (' || role || '-side): ' || hub || chr(10) || chr(10) || 'Edges (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by i) as text from l group by 1, 2, 3""",
    "lex_blocks": f"with {_BLOCKS} select * from blocks",
    "lex_block_sizes": f"with {_BLOCKS}, s as (select lex, block_no, count(*) as size from blocks group by 1, 2) select size, count(*) as n_blocks from s group by 1",
}
