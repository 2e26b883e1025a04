"""Queries on the relation table and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions import names
from edgewright.operators import edges as E
from edgewright.runtime import table


def _on_edges(f: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(E.delivered_edges(table(spark, d, "merge_relations")), *args)


def _audited(f: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    """Over all edges, those without an end or a relation too."""
    return lambda spark, d: f(E.stated_edges(table(spark, d, "merge_relations")), *args)


def shown(df: DataFrame) -> DataFrame:
    """Lists as texts: variants and loads joined, anchors rendered."""
    for c in ("anchor_list", "inherited"):
        df = df.withColumn(c, E.rendered(F.col(c))) if c in df.columns else df
    df = df.withColumn("variants", F.array_join("variants", "|")) if "variants" in df.columns else df
    return df.withColumn("loads", F.array_join(F.col("loads").cast("array<string>"), ",")) if "loads" in df.columns else df


def _shown_on_edges(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: shown(f(E.delivered_edges(table(spark, d, "merge_relations"))))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every alias of a reference artifact and its formal name."""
    ref = table(spark, d, "ref_artifacts")
    return ref.select(F.explode("aliases").alias("name"), F.col("formal_name").alias("canonical")).groupBy("name").agg(F.min("canonical").alias("canonical"))


def rewrite_losses(spark: SparkSession, d: str) -> DataFrame:
    return E.rewrite_losses(E.stated_edges(table(spark, d, "merge_relations")), _aliases(spark, d))


def edge_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Every alias of a reference artifact becomes its formal name."""
    return shown(E.rewritten(E.stated_edges(table(spark, d, "merge_relations")), _aliases(spark, d)))


def rewire_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Drops the artifacts whose name ends in a preview stage."""
    e = E.delivered_edges(table(spark, d, "merge_relations"))
    drop = e.select(F.explode(F.array("subject", "object")).alias("node")).where("lower(node) like '%preview'")
    return shown(E.rewired(e, drop))


def _forms(ends: DataFrame) -> DataFrame:
    n = F.col("name")
    return ends.select("name", names.lex_collapse(n).alias("lex"), names.lex_norm(n).alias("norm"), names.alnum_form(n).alias("alnum"), names.canonical_name(n).alias("canonical"), names.slug(n).alias("slug"), names.org(n).alias("org"), names.bare(n).alias("bare"), names.file_slug(n).alias("file_slug"))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merge_relations").select(F.explode(F.array("subject", "object")).alias("name")).where("name <> ''").distinct()


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """The rows of :func:`all_name_forms` of printable ASCII, on which DuckDB agrees."""
    return _forms(_ends(spark, d).where(~F.col("name").rlike("[^\\x20-\\x7E]")))


def all_name_forms(spark: SparkSession, d: str) -> DataFrame:
    """All normal forms of every distinct endpoint."""
    return _forms(_ends(spark, d))


QUERIES = {
    "anchor_coverage": _audited(E.anchor_coverage),
    "top_out_hubs": _on_edges(E.hubs, "subject"),
    "top_in_hubs": _on_edges(E.hubs, "object"),
    "relation_breakdown": _audited(E.relation_breakdown),
    "near_dup_names": _on_edges(E.near_duplicate_names),
    "concept_pairs": _on_edges(E.concept_edges),
    "weak_claims": _audited(E.weak_claims),
    "multi_relation_pairs": _on_edges(E.multi_relation_pairs),
    "audit_role_table": _audited(E.audit_roles),
    "source_type_table": _audited(E.source_types),
    "graph_totals": _audited(E.totals),
    "corroborate": _shown_on_edges(E.corroborated),
    "merge_relations": _shown_on_edges(E.merged_relations),
    "merge_conflicts": _shown_on_edges(E.description_conflicts),
    "edge_rewrite": edge_rewrite,
    "rewrite_losses": rewrite_losses,
    "rewire_dropped": rewire_dropped,
    "name_forms": name_forms,
    "all_name_forms": all_name_forms,
}

EDGES = """edges as (select distinct on (rel_id) rel_id, load_no, subject, relation, dependency_kind, object, description,
  (select count(*) from unnest(anchor_list) t(a) where a is not null) as na, anchor_list
  from merge_relations where subject <> '' and object <> '' and relation <> '')"""
STATED = EDGES.replace(" and object <> '' and relation <> ''", "").replace("subject <> ''", "rel_id is not null")
ENDS = "ends as (select subject as node, rel_id from edges union all select object, rel_id from edges)"
_LEX = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_NORM = _LEX.format(r"regexp_replace(regexp_replace({0}, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g')")
_CONCEPT = r"({0} <> '' and not regexp_matches({0}, '[/\[(]') and not (regexp_matches({0}, '[0-9]') and regexp_matches({0}, '[Bb]')) and length({0}) < 30)"
_DASH = "trim(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '-')"

_ALIASES = "c as (select name, min(formal_name) as canonical from (select unnest(aliases) as name, formal_name from ref_artifacts) group by 1)"
_ANCHORS = "array_to_string(list_transform(list_filter(flatten(al), lambda a: a is not null), lambda a: concat_ws('~', a.source, a.position, a.excerpt, a.explanation)), '|')"


def _merged_sql(at: str, source: str, columns: str, where: str = "") -> str:
    """Edges ``k`` of ``source`` merged by ``at``: first kind and description, texts by first appearance, anchors, loads."""
    kind = "any_value(dependency_kind)" if "dependency_kind" in at else "arg_min_null(dependency_kind, rel_id)"
    return f"""with {source}, tx as (select {at}, t, min(rel_id) as o from k {where or 'where true'} and t is not null group by all), tl as (select {at}, list(t order by o) as ts from tx group by all),
g as (select {at}, min(rel_id) as first_id, {kind} as kind, arg_min_null(t, rel_id) as description, list(coalesce(anchor_list, []) order by rel_id) as al, list_sort(list(distinct load_no) filter (where load_no is not null)) as loads, count(*) as merged from k {where} group by {at}),
gt as (select g.*, coalesce(ts, []) as ts from g left join tl using ({at})) select {columns} from gt"""


ORACLE = {
    "anchor_coverage": f"with {STATED} select case when na = 0 then '0' when na = 1 then '1' when na <= 3 then '2-3' else '4+' end as bucket, count(*) as n_edges, sum(na)::bigint as n_anchors from edges group by 1",
    "top_out_hubs": f"with {EDGES} select subject as node, count(*) as degree from edges group by 1 order by 2 desc, 1 limit 25",
    "top_in_hubs": f"with {EDGES} select object as node, count(*) as degree from edges group by 1 order by 2 desc, 1 limit 25",
    "relation_breakdown": f"with {STATED} select relation, count(*) as n_edges, count(*) filter (where na = 0) as zero_anchor, sum(na)::bigint as anchors, round(avg(na), 9) as avg_anchors, count(distinct subject) as subjects, count(distinct object) as objects from edges group by 1",
    "near_dup_names": f"with {EDGES}, {ENDS}, d as (select node, count(*) as degree from ends group by 1), f as (select {_NORM.format('node')} as form, degree from d) select form, count(*) as surfaces, sum(degree)::bigint as degree from f where form <> '' group by 1 having count(*) > 1 order by 2 desc, 1 limit 30",
    "concept_pairs": f"with {EDGES} select rel_id, subject, relation, object from edges where {_CONCEPT.format('subject')} and {_CONCEPT.format('object')}",
    "weak_claims": f"with {STATED} select rel_id, relation from edges where na <= 1 and relation in (select relation from edges group by 1 having count(*) >= 100)",
    "multi_relation_pairs": f"with {EDGES} select subject, object, count(distinct relation) as n_relations from edges group by 1, 2 having count(distinct relation) > 1",
    "audit_role_table": f"""with {STATED}, r as (select case {' '.join(f"when relation in {labels!r} then '{role}'" for role, labels in E.AUDIT_ROLES.items())} end as role, coalesce(lower(dependency_kind), 'none') as kind from edges)
select role, kind, count(*) as n, (select count(*) from edges) as all_edges from r where role is not null group by rollup (role, kind)""",
    "source_type_table": f"""with {STATED}, a as (select rel_id, unnest(anchor_list).source as src from edges), b as (select rel_id, lower(trim(src)) as s from a where trim(src) <> ''),
k as (select distinct rel_id, case when contains(s, 'huggingface.co') then 'hf_card' when contains(s, 'arxiv.org') or s like '%.pdf' then 'pdf'
 when contains(s, 'github.com') or regexp_matches(s, '\\.(py|yaml|yml|json|sh|md)$') or contains(s, '/blob/') then case when contains(s, 'readme') then 'doc_other' when regexp_matches(s, 'blog|announcement|/news/|/posts/') then 'blog' else 'code' end
 when regexp_matches(s, 'blog|/announcement|/news/|/posts/') then 'blog' else 'doc_other' end as kind from b),
o as (select rel_id, case when count(*) > 1 then 'multi' else min(kind) end as source_type from k group by 1) select source_type, count(*) as n_edges from o group by 1""",
    "graph_totals": f"with {STATED}, {ENDS} select (select count(*) from edges) as n_edges, (select sum(na)::bigint from edges) as n_anchors, (select count(distinct node) from ends where node <> '') as n_nodes",
    "corroborate": _merged_sql("subject, relation, dependency_kind, object", f"{EDGES}, k as (select * replace (coalesce(dependency_kind, '') as dependency_kind), nullif(description, '') as t from edges)",
        f"first_id, subject, relation, dependency_kind, object, description, case when description is null then '' else array_to_string(list_filter(ts, lambda x: x <> description), '|') end as variants, {_ANCHORS} as anchor_list, array_to_string(list_transform(loads, lambda x: x::varchar), ',') as loads, merged as corroboration"),
    "merge_relations": _merged_sql("subject, relation, object", f"{EDGES}, k as (select *, nullif(description, '') as t from edges)", f"subject, relation, object, first_id, kind as dependency_kind, description, case when description is null or len(ts) < 2 then '' else array_to_string(ts, '|') end as variants, {_ANCHORS} as anchor_list, merged"),
    "merge_conflicts": "with m as (" + _merged_sql("subject, relation, object", f"{EDGES}, k as (select *, nullif(description, '') as t from edges)", "subject, relation, object, description, ts") + ") select subject, relation, object, array_to_string(ts[:n], '|') as variants, n::int as n_variants from (select *, unnest(range(2, len(ts) + 1)) as n from m where description is not null and len(ts) > 1)",
    "edge_rewrite": _merged_sql("subject, relation, object", f"{STATED}, {_ALIASES}, k as (select rel_id, load_no, coalesce(a.canonical, subject) as subject, relation, coalesce(b.canonical, object) as object, dependency_kind, nullif(description, '') as t, anchor_list from edges left join c a on a.name = subject left join c b on b.name = object)",
        f"subject, relation, object, first_id, kind as dependency_kind, description, {_ANCHORS} as anchor_list, merged", "where subject <> '' and object <> '' and subject <> object and relation <> ''"),
    "rewrite_losses": f"with {STATED}, {_ALIASES}, k as (select coalesce(a.canonical, subject) as s, relation, coalesce(b.canonical, object) as o from edges left join c a on a.name = subject left join c b on b.name = object) select count(*) filter (where coalesce(s, '') = '' or coalesce(o, '') = '') as dropped_endpoint, count(*) filter (where s <> '' and o <> '' and (s = o or coalesce(relation, '') = '')) as dropped_self from k",
    "rewire_dropped": f"""with {EDGES}, e as (select *, lower(subject) like '%preview' as ds, lower(object) like '%preview' as dob, list_filter(coalesce(anchor_list, []), lambda a: a is not null) as al from edges), kept as (select * from e where not ds and not dob),
m(r1, r2, relation) as (values {', '.join(str(x) for x in E.REWIRE)}),
p as (select i.subject, m.relation, o.object, i.object as via, i.rel_id as o1, o.rel_id as o2, list_concat(i.al[:6], o.al[:6])[:6] as al from e i join e o on i.object = o.subject and i.dob and not i.ds and not o.dob join m on m.r1 = i.relation and m.r2 = o.relation),
q as (select distinct on (subject, relation, object) * from p order by subject, relation, object, via, o1, o2)
select subject, relation, object, arg_min_null(dependency_kind, rel_id) as dependency_kind, nullif(arg_min_null(description, rel_id), '') as description, array_to_string(list_transform(flatten(list(al order by rel_id)), lambda a: concat_ws('~', a.source, a.position, a.excerpt, a.explanation)), '|') as anchor_list, null::varchar as via from kept group by 1, 2, 3
union all select subject, relation, object, 'indirect', '(rewired through ' || via || ')', array_to_string(list_transform(al, lambda a: concat_ws('~', a.source, a.position, a.excerpt, a.explanation)), '|'), via from q where not exists (select 1 from kept k where k.subject = q.subject and k.relation = q.relation and k.object = q.object)""",
    "name_forms": f"""with n as (select distinct name from (select subject as name from merge_relations union all select object from merge_relations) where name <> '' and not regexp_matches(name, '[^\\x20-\\x7E]')), l as (select name, lower(trim(name)) as s from n)
select name, {_LEX.format('name')} as lex, {_NORM.format('name')} as norm, regexp_replace(replace(lower(name), '+', 'plus'), '[^a-z0-9]', '', 'g') as alnum,
 case when contains(s, '/') then split_part(s, '/', 1) || '/' || {_DASH.format("substring(s, instr(s, '/') + 1)")} else {_DASH.format('s')} end as canonical,
 trim(regexp_replace(regexp_replace(regexp_replace(s, '[\\s_]+', '-', 'g'), '[^a-z0-9\\-+.]', '', 'g'), '-{{2,}}', '-', 'g'), '-') as slug,
 lower(regexp_extract(name, '^([A-Za-z0-9][A-Za-z0-9_.\\-]*)/(.+)$', 1)) as org,
 case when regexp_matches(name, '^([A-Za-z0-9][A-Za-z0-9_.\\-]*)/(.+)$') then regexp_extract(name, '^([A-Za-z0-9][A-Za-z0-9_.\\-]*)/(.+)$', 2) else name end as bare,
 case when trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '-') = '' then 'source' else trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '-') end as file_slug from l""",
}
