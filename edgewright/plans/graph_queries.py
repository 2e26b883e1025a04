"""Queries on the relation graph, name deduplication, evaluation and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import dedup, edges, evaluate, graph
from edgewright.plans.edge_queries import EDGES, ENDS
from edgewright.runtime import table
from edgewright.sources import ledger


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.delivered_edges(table(spark, d, "merge_relations"))


def _nodes(f):
    return lambda spark, d: f(dedup.node_table(_edges(spark, d)))


def ancestors_bfs(spark, d):
    e = _edges(spark, d)
    return graph.ancestors(e, edges.hubs(e, "subject", 5).select(F.col("node").alias("seed")))


def connected_components(spark, d):
    return graph.components(_edges(spark, d))


def ego_expand(spark, d):
    e = _edges(spark, d)
    return graph.ego_expansion(e, edges.hubs(e, "object", 1), 3, 60)


def degree_prune(spark, d):
    return graph.pruned(_edges(spark, d), 3).select("rel_id", "subject", "object")


def visible_graph(spark, d):
    return graph.visible_edges(_edges(spark, d), ("direct",)).select("rel_id")


def expansion_picks(spark, d):
    e = _edges(spark, d)
    return graph.expansion_picks(e, edges.hubs(e, "subject", 10).select("node"), "bfs", 5)


def expansion_beam(spark, d):
    """Two rounds of a beam of five from the ten greatest subjects."""
    e = _edges(spark, d)
    return graph.beam(e, edges.hubs(e, "subject", 10).select("node"), 5, 2)


def hub_batches(spark, d):
    e = _edges(spark, d)
    return graph.ranked_hub_edges(e, edges.hubs(e, "subject", 75))


def hub_audit_batches(spark, d):
    """Batches of the 75 out-hubs and the 30 in-hubs; :func:`hub_batches` is the side of the former."""
    e = _edges(spark, d)
    return graph.audit_batches(e, edges.hubs(e, "subject", 75), edges.hubs(e, "object", 30))


def guarded_union(spark, d):
    """Unions of names that are beginnings or ends of each other unless sizes, versions or dates conflict."""
    nodes = dedup.node_table(_edges(spark, d))
    pairs = dedup.affix_pairs(nodes).select(F.col("bare_name").alias("a"), F.col("full_name").alias("b"), F.lit("pair").alias("relation"))
    comp = graph.components(pairs.select(F.col("a").alias("subject"), F.col("b").alias("object")))
    proposals = pairs.join(comp.withColumnRenamed("node", "a"), "a").select("component", F.col("b").alias("ord"), "a", "b")
    return dedup.guarded_unions(proposals, dedup.name_specs(nodes))


def pool_clusters(spark, d):
    return evaluate.pooled(evaluate.claims(table(spark, d, "claim_clusters")))


def system_precision(spark, d):
    c = table(spark, d, "claim_clusters")
    return evaluate.precision(evaluate.claims(c), evaluate.verdicts_of(c), table(spark, d, "eval_systems"))


def system_precision_by_target(spark, d):
    c = table(spark, d, "claim_clusters")
    return evaluate.precision(evaluate.claims(c), evaluate.verdicts_of(c), table(spark, d, "eval_systems"), by_target=True)


def pending_work(spark, d):
    """Claims still to be judged after a pass in which some judgements failed."""
    c = table(spark, d, "claim_clusters")
    return evaluate.pending(c, evaluate.verdicts_of(c).where("verdict <> 'error'"))


def audit_totals(spark, d):
    return evaluate.audit_totals(evaluate.verdicts_of(table(spark, d, "claim_clusters")))


def _ref_entries(spark, d):
    ref = table(spark, d, "ref_artifacts")
    return ref.select(F.col("ref_id").alias("entry_id"), F.explode(F.concat(F.array("formal_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))


def _mentions(spark, d):
    return table(spark, d, "merge_relations").select(F.col("object").alias("mention"))


def resolve_topk(spark, d):
    """Matches by equal form only; :func:`resolve_candidates` is the whole search."""
    return evaluate.resolved(_mentions(spark, d), _ref_entries(spark, d))


def resolve_candidates(spark, d):
    """The three best candidates of every object from no score on: by form, by tokens in common, and as a subset."""
    return evaluate.resolved_with_subsets(_mentions(spark, d), _ref_entries(spark, d), table(spark, d, "lattice_items"))


def latest_runs(spark, d):
    return ledger.latest_runs(table(spark, d, "runs"))


def lattice_search(spark, d):
    return ledger.lattice_search(table(spark, d, "lattice_items"), "instruct")


def lattice_unlinked(spark, d):
    """The first models without a link."""
    return ledger.lattice_search(table(spark, d, "lattice_items"), kind="model", linked=False)


def table_counts(spark, d):
    return ledger.table_counts({t: table(spark, d, t) for t in ("runs", "sources", "lattice_items", "merge_relations", "claim_clusters")})


def _table(f, name):
    return lambda spark, d: f(table(spark, d, name))


QUERIES = {
    "ancestors_bfs": ancestors_bfs, "connected_components": connected_components, "ego_expand": ego_expand, "degree_prune": degree_prune, "visible_graph": visible_graph,
    "expansion_picks": expansion_picks, "expansion_beam": expansion_beam, "hub_batches": hub_batches, "hub_audit_batches": hub_audit_batches, "guarded_union": guarded_union,
    "signature_buckets": _nodes(dedup.signature_buckets), "affix_match": _nodes(dedup.affix_pairs), "suffix_pairs": _nodes(dedup.suffix_pairs), "cross_org_names": _nodes(dedup.cross_org_names), "jaccard_candidates": _nodes(dedup.token_pairs),
    "pool_clusters": pool_clusters, "system_precision": system_precision, "system_precision_by_target": system_precision_by_target, "pending_work": pending_work, "audit_totals": audit_totals, "resolve_topk": resolve_topk, "resolve_candidates": resolve_candidates,
    "source_ledger": _table(ledger.url_ledger, "sources"), "content_ledger": _table(ledger.content_ledger, "sources"), "batch_fingerprint": _table(ledger.batch_fingerprints, "sources"), "names_packet": _table(ledger.names_packet, "merge_relations"),
    "latest_runs": latest_runs, "run_counters": _table(ledger.run_counters, "runs"), "lattice_search": lattice_search, "lattice_unlinked": lattice_unlinked, "table_counts": table_counts,
}

_CANON = "case when contains({0}, '/') then split_part({0}, '/', 1) || '/' || trim(regexp_replace(substring({0}, instr({0}, '/') + 1), '[^a-z0-9]+', '-', 'g'), '-') else trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-') end"
_UP = f"relation in {graph.UPSTREAM!r}"
_NODES = f"{EDGES}, {ENDS}, nodes as (select node as name, count(*) as degree from ends group by 1)"
_ORGX, _BAREX = r"lower(regexp_extract(name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 1))", r"case when regexp_matches(name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$') then regexp_extract(name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 2) else name end"
_LX = f"{_NODES}, lx as (select name, degree, regexp_replace(lower({_BAREX}), '[^a-z0-9]', '', 'g') as lex, {_ORGX} as org from nodes)"
_CLAIMS = f"""m as (select cluster_id, target, m.member_no as ord, m.system as system, lower(trim(m.subject)) as s, lower(trim(m.object)) as o, m.description as description from (select distinct on (cluster_id) * from claim_clusters) c, unnest(members) u(m)),
cl as (select cluster_id, target, ord, system, {_CANON.format('s')} as subject, {_CANON.format('o')} as object, description from m),
vd as (select distinct cluster_id, target, case when md5(cluster_id)[1] < 'b' then 'verified' when md5(cluster_id)[1] < 'd' then 'refuted' when md5(cluster_id)[1] < 'f' then 'unclear' else 'error' end as verdict from cl where cluster_id is not null)"""
_COUNTS = "count(*) filter (where verdict = 'verified') as verified, count(*) filter (where verdict = 'refuted') as refuted, count(*) filter (where verdict = 'unclear') as unclear, count(*) filter (where verdict = 'error') as error, count(*) filter (where verdict in ('verified', 'refuted')) as decided, round(count(*) filter (where verdict = 'verified') / nullif(count(*) filter (where verdict in ('verified', 'refuted')), 0)::double, 9) as precision"
_W = "case relation " + " ".join(f"when '{r}' then {w}" for r, w in graph.WEIGHTS.items()) + " else 1 end"

ORACLE = {
    "ancestors_bfs": f"""with recursive {EDGES}, hub as (select subject as seed from edges group by 1 order by count(*) desc, 1 limit 5), arc as (select distinct subject, object from edges where {_UP}),
w(seed, node, depth) as (select seed, seed, 0 from hub union select w.seed, a.object, w.depth + 1 from w join arc a on a.subject = w.node where w.depth < 12) select seed, node, min(depth)::int as depth from w group by 1, 2""",
    "connected_components": f"""with recursive {EDGES}, {ENDS}, ln as (select distinct a, b from (select subject as a, object as b from edges union all select object, subject from edges) where a <> b),
cc(node, component) using key (node) as (select distinct node, node from ends union select l.a, min(c.component) from ln l join cc c on c.node = l.b join recurring.cc r on r.node = l.a where c.component < r.component group by l.a) select node, component from cc""",
    "visible_graph": f"""with recursive {EDGES}, {ENDS}, ln as (select distinct a, b from (select subject as a, object as b from edges union all select object, subject from edges) where a <> b),
cc(node, component) using key (node) as (select distinct node, node from ends union select l.a, min(c.component) from ln l join cc c on c.node = l.b join recurring.cc r on r.node = l.a where c.component < r.component group by l.a),
main as (select component from cc group by 1 order by count(*) desc, 1 limit 1) select rel_id from edges where lower(dependency_kind) = 'direct' and subject in (select node from cc where component in (select component from main))""",
    "degree_prune": f"with {EDGES}, {ENDS}, k as (select node from ends group by 1 having count(*) >= 3) select rel_id, subject, object from edges where subject in (select node from k) and object in (select node from k)",
    "expansion_picks": f"with {EDGES}, x as (select subject as node from edges group by 1 order by count(*) desc, 1 limit 10) select object as node, count(*) as votes from edges where {_UP} and subject in (select node from x) and object not in (select node from x) group by 1 order by 2 desc, 1 limit 5",
    "expansion_beam": f"""with {EDGES}, x1 as (select subject as node from edges group by 1 order by count(*) desc, 1 limit 10),
v1 as (select object as node, count(*) as v from edges where subject in (select node from x1) and object not in (select node from x1) group by 1), p1 as (select node, v from v1 order by 2 desc, 1 limit 5), x2 as (select node from x1 union all select node from p1),
v2 as (select node, sum(v)::bigint as v from (select * from v1 union all select object, count(*) from edges where subject in (select node from x2) and object not in (select node from x2) group by 1) group by 1),
p2 as (select node, v from v2 where node not in (select node from x2) order by 2 desc, 1 limit 5) select 1 as round, node, v as votes from p1 union all select 2, node, v from p2""",
    "hub_batches": f"with {EDGES}, h as (select subject from edges group by 1 order by count(*) desc, 1 limit 75), r as (select subject as hub, rel_id, row_number() over (partition by subject order by coalesce(len(anchor_list), 0) desc, rel_id) as r from edges where subject in (select subject from h)) select hub, rel_id, ((r - 1) // 40)::int as batch_no from r where r <= 200",
    "hub_audit_batches": " union all ".join(
        f"select * from (with {EDGES}, h as (select {side} as node from edges group by 1 order by count(*) desc, 1 limit {k}), r as (select {side} as hub, rel_id, row_number() over (partition by {side} order by coalesce(len(anchor_list), 0) desc, rel_id) as r from edges where {side} in (select node from h)) select hub, '{side}' as role, rel_id, ((r - 1) // 40)::int as batch_no from r where r <= 200)"
        for side, k in (("subject", 75), ("object", 30))
    ),
    "affix_match": f"with {_LX} select distinct a.name as bare_name, b.name as full_name from lx a join lx b on a.org = '' and b.org <> '' and length(a.lex) >= 4 and (starts_with(b.lex, a.lex) or ends_with(b.lex, a.lex))",
    "suffix_pairs": f"with {_NODES}, c as (select name, case {' '.join(f'''when ends_with(name, '{s}') then left(name, length(name) - {len(s)})''' for s in dedup.SUFFIXES)} end as stripped from nodes) select name, stripped from c where stripped <> '' and stripped in (select name from nodes)",
    "cross_org_names": f"with {_LX} select lex, count(*) as n_names, count(distinct nullif(org, '')) as n_orgs, count(*) filter (where org = '') as n_bare from lx where lex <> '' group by 1 having count(*) between 2 and 6 and (count(distinct nullif(org, '')) >= 2 or (count(distinct nullif(org, '')) >= 1 and count(*) filter (where org = '') >= 1))",
    "jaccard_candidates": rf"""with {_NODES}, t as (select name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[\s\-_/.\[\](),=:]+'), lambda x: length(x) > 1)) as ts from nodes), l as (select name, unnest(ts) as token from t),
r as (select token from l group by 1 having count(*) between 2 and 200), f as (select l.name, l.token from l join r using (token)), p as (select a.name as a, b.name as b from f a join f b on a.token = b.token and a.name < b.name group by 1, 2 having count(*) >= 2),
j as (select a, b, len(list_intersect(x.ts, y.ts)) as n_shared, len(list_distinct(list_concat(x.ts, y.ts))) as n_union from p join t x on x.name = a join t y on y.name = b) select * from j where n_shared >= 0.6 * n_union""",
    "pool_clusters": f"with {_CLAIMS} select target, subject, object, count(*) as n_claims, count(distinct system) as n_systems, coalesce(array_to_string(list_sort(list(distinct system) filter (where system is not null)), '|'), '') as systems, first(description order by length(coalesce(description, '')) desc, cluster_id, ord) as description from cl where subject <> '' and object <> '' group by 1, 2, 3",
    "system_precision": f"with {_CLAIMS}, p as (select distinct cluster_id, system from cl where system is not null), g as (select system, {_COUNTS} from p join vd using (cluster_id) group by 1) select s.system, coalesce(verified, 0) as verified, coalesce(refuted, 0) as refuted, coalesce(unclear, 0) as unclear, coalesce(error, 0) as error, coalesce(decided, 0) as decided, precision from (select distinct system from eval_systems) s left join g using (system)",
    "system_precision_by_target": f"with {_CLAIMS}, p as (select distinct cluster_id, system from cl where system is not null) select system, target, {_COUNTS} from p join vd using (cluster_id) group by 1, 2",
    "pending_work": f"with {_CLAIMS} select cluster_id, target from claim_clusters where cluster_id not in (select cluster_id from vd where verdict <> 'error')",
    "audit_totals": f"with {_CLAIMS} select count(*) as total, count(*) filter (where verdict = 'verified') as verified, count(*) filter (where verdict = 'refuted') as refuted, count(*) filter (where verdict = 'unclear') as unclear, count(*) filter (where verdict = 'error') as error, count(*) filter (where verdict in ('verified', 'refuted')) as decisive, round(count(*) filter (where verdict = 'verified') / nullif(count(*) filter (where verdict in ('verified', 'refuted')), 0)::double, 9) as precision from vd",
    "resolve_topk": r"""with m as (select distinct object as mention from merge_relations where object is not null), mt as (select mention, regexp_replace(replace(lower(mention), '+', 'plus'), '[^a-z0-9]', '', 'g') as form, list_distinct(list_filter(regexp_split_to_array(lower(mention), '[/_\-. ]+'), lambda t: t <> '')) as ts from m),
e as (select distinct ref_id as entry_id, unnest(list_concat([formal_name], coalesce(aliases, []))) as surface from ref_artifacts), et as (select entry_id, regexp_replace(replace(lower(surface), '+', 'plus'), '[^a-z0-9]', '', 'g') as form, list_distinct(list_filter(regexp_split_to_array(lower(surface), '[/_\-. ]+'), lambda t: t <> '')) as es from e),
s as (select mention, entry_id, max(100.0::double + 10 * len(list_intersect(ts, es)) / len(ts)::double + 5 * len(list_intersect(ts, es)) / greatest(len(es), 1)::double) as score from mt join et using (form) where len(ts) > 0 group by 1, 2),
r as (select mention, entry_id, score, (row_number() over (partition by mention order by score desc, entry_id))::int as place from s) select * from r where place <= 3""",
    "source_ledger": "select id, canonical_url as url, min(fetched_at) as first_seen, max(fetched_at) as last_seen from sources where canonical_url is not null group by 1, 2",
    "content_ledger": "with s as (select distinct on (id) * from sources where content_hash is not null) select content_hash, first(id order by load_no, id) as id, count(*) as n_sources from s group by 1",
    "batch_fingerprint": "select load_no, sha256(array_to_string(list_sort(list(distinct id || ':' || coalesce(content_hash, ''))), '|')) as fingerprint, count(distinct id) as n_sources from sources group by 1",
    "names_packet": "select distinct kind, name from (select 'subject' as kind, trim(subject, ' ') as name from merge_relations union all select 'object', trim(object, ' ') from merge_relations) where name <> ''",
    "latest_runs": "select stage, first(id order by started_at desc, id desc) as id, max(started_at) as started_at, count(distinct id) as n_runs from runs where ended_at is not null and started_at is not null group by 1",
    "run_counters": "with r as (select distinct on (id) * from runs), n as (select stage, try_cast(json_extract_string(case when json_valid(attrs) then attrs end, '$.edge_count') as bigint) as n from r) select stage, count(*) as n_runs, sum(n)::bigint as edges, count(n) as with_edges from n group by 1",
    "lattice_search": "with i as (select distinct on (item_id) * from lattice_items) select item_id, family, kind, formal_name from i where contains(lower(formal_name), 'instruct') or len(list_filter(aliases, lambda a: contains(lower(a), 'instruct'))) > 0 order by item_id limit 50",
    "lattice_unlinked": "with i as (select distinct on (item_id) * from lattice_items) select item_id, family, kind, formal_name from i where kind = 'model' and coalesce(len(links), 0) = 0 order by item_id limit 50",
    "table_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in ("claim_clusters", "lattice_items", "merge_relations", "runs", "sources")),
}
