"""Queries on the identity lattice and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import edges as E
from edgewright.operators import lattice as L
from edgewright.plans.edge_queries import _ALIASES, EDGES, _aliases
from edgewright.runtime import table

#: Link kinds a lattice may use first.
LINK_KINDS = ("hf_model", "hf_dataset", "hf_space", "github", "vendor_docs", "paper", "blog", "hf_collection", "hf_dataset_config")


def _lattice(f, *args, items: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, "lattice_items")
        return f(L.items_of(t) if items else t, *args)

    return run


def _identified(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = E.delivered_edges(table(spark, d, "merge_relations"))
        return f(L.identified_edges(e, L.endpoint_identities(e, table(spark, d, "lattice_items"))))

    return run


def endpoint_identities(spark: SparkSession, d: str) -> DataFrame:
    e = E.delivered_edges(table(spark, d, "merge_relations"))
    out = L.endpoint_identities(e, table(spark, d, "lattice_items"))
    return out.select("name", "family", F.array_join("facets", "|").alias("facets"))


def rebuilt_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Items under the formal names of the reference artifacts whose aliases they bear."""
    return L.rebuilt(table(spark, d, "lattice_items"), _aliases(spark, d))


def hint_invented_root_alias(spark: SparkSession, d: str) -> DataFrame:
    """Roots without an alias among the names the relations mention."""
    piled = table(spark, d, "merge_relations").select(F.explode(F.array("subject", "object")).alias("name")).where("name <> ''")
    return L.invented_root_aliases(table(spark, d, "lattice_items"), piled)


QUERIES = {
    "edge_classes": _identified(L.class_members),
    "item_roles": _lattice(L.item_roles),
    "rebuilt_lattice": rebuilt_lattice,
    "hint_invented_root_alias": hint_invented_root_alias,
    "subsumed_pairs": _lattice(L.subsumed_pairs, items=True),
    "direct_parents": _lattice(L.direct_parents, items=True),
    "merge_items": _lattice(L.merged_items),
    "identity_conflicts": _lattice(L.identity_conflicts),
    "family_keys": _lattice(L.family_keys),
    "expand_lattice": _lattice(L.expanded, items=True),
    "complete_roots": _lattice(L.completed_roots),
    "lattice_stats": _lattice(L.lattice_stats),
    "link_kinds": _lattice(L.link_kinds),
    "lattice_hints": _lattice(L.hints),
    "hint_name_matches_subset": _lattice(L.name_matches_subset),
    "lattice_violations": _lattice(L.violations, LINK_KINDS),
    "endpoint_identities": endpoint_identities,
    "edge_subsumption": _identified(L.edge_subsumption),
    "sibling_conflicts": _identified(L.sibling_conflicts),
}

ITEMS = r"""it0 as (select distinct on (item_id) * from lattice_items where identity is not null and item_id is not null),
fx as (select item_id, list_sort(list(distinct e.k || '=' || e.v)) as facets from (select item_id, unnest(identity) as e from it0) where trim(e.v) <> '' and e.k is not null group by 1),
it as (select it0.* replace (coalesce(family, '') as family), coalesce(facets, []) as facets, list_filter(coalesce(facets, []), lambda f: not starts_with(f, 'family=')) as own from it0 left join fx using (item_id))"""
_SUB = f"with {ITEMS}, p as (select a.family, a.item_id as parent_id, b.item_id as child_id from it a join it b on a.family = b.family and len(a.own) < len(b.own) and list_has_all(b.own, a.own))"
_SLUG = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[\s_]+', '-', 'g'), '[^a-z0-9\-+.]', '', 'g'), '-{{2,}}', '-', 'g'), '-')"
_ALNUM = "regexp_replace(replace(lower({0}), '+', 'plus'), '[^a-z0-9]', '', 'g')"
_ORG = r"lower(regexp_extract(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 1))"
_BARE = r"case when regexp_matches(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$') then regexp_extract(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 2) else formal_name end"
_UNIQUE = "(len(list_filter(links, lambda x: x.kind in ('hf_model', 'hf_dataset', 'vendor_docs') and trim(x.url) <> '')) > 0)"
_IDS = rf"""{ITEMS}, {EDGES}, nm as (select formal_name, arg_min(facets, item_id) as facets from it where formal_name is not null group by 1),
en as (select distinct name from (select subject as name from edges union all select object from edges)),
ad as (select name, trim(regexp_extract(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$', 1)) as fam, string_split(regexp_extract(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$', 2), ',') as ps from en where regexp_matches(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$')),
pc as (select name, fam, trim(p) as p, i from (select name, fam, unnest(ps) as p, unnest(range(len(ps))) as i from ad)),
ok as (select name from pc group by 1 having bool_and(p = '' or regexp_matches(p, '^[^=]*[^=\s][^=]*=.*\S.*$'))),
kv as (select name, trim(split_part(p, '=', 1)) as k, arg_max(trim(substring(p, instr(p, '=') + 1)), i) as v from pc where p <> '' group by 1, 2),
ak as (select ad.name, list_sort(list_concat(['family=' || fam], coalesce((select list(k || '=' || v) from kv where kv.name = ad.name and k <> 'family'), []))) as facets from ad join ok on ok.name = ad.name where fam <> ''),
ids as (select en.name, coalesce(nm.facets, ak.facets) as facets from en left join nm on nm.formal_name = en.name left join ak on ak.name = en.name where coalesce(nm.facets, ak.facets) is not null),
idf as (select name, coalesce(list_filter(facets, lambda f: starts_with(f, 'family='))[1][8:], '') as family, facets from ids)"""
_CLS = f"""with {_IDS}, ie as (select rel_id, relation, coalesce(dependency_kind, '') as kind, s.family as sf, s.facets as sx, o.family as o_f, o.facets as ox from edges e join idf s on s.name = e.subject join idf o on o.name = e.object),
c as (select relation, kind, sf, o_f, sx, ox, min(rel_id) as id from ie group by all),
c2 as (select *, list_concat(list_transform(list_filter(sx, lambda f: not starts_with(f, 'family=')), lambda f: 's:' || f), list_transform(list_filter(ox, lambda f: not starts_with(f, 'family=')), lambda f: 'o:' || f)) as own from c)"""

ORACLE = {
    "subsumed_pairs": f"{_SUB} select * from p",
    "direct_parents": f"{_SUB} select * from p where not exists (select 1 from p a join p b on a.child_id = b.parent_id where a.parent_id = p.parent_id and b.child_id = p.child_id)",
    "merge_items": """with i as (select distinct on (item_id) *, list_filter(list_transform(coalesce(links, []), lambda x: x.url), lambda u: u is not null)[1] as url from lattice_items where formal_name is not null)
select min(i.item_id) as item_id, formal_name, url, arg_min_null(family, i.item_id) as family, arg_min_null(kind, i.item_id) as kind, count(*) as merged, len(list_distinct(flatten(list(coalesce(aliases, []))))) as n_aliases from i group by formal_name, url""",
    "identity_conflicts": """with e as (select formal_name, e.k as k, e.v as v, item_id from (select distinct on (item_id) item_id, formal_name, identity from lattice_items where formal_name is not null and identity is not null) t, unnest(identity) u(e) where e.v is not null),
r as (select formal_name, k, v, row_number() over (partition by formal_name, k order by min(item_id), v) as r from e group by 1, 2, 3)
select a.formal_name, a.k, b.v as first_value, a.v as other_value from r a join r b on a.formal_name = b.formal_name and a.k = b.k and b.r = 1 where a.r > 1""",
    "family_keys": f"with {ITEMS} select family, e.k as k, min(item_id) as first_item, count(*) as n from (select family, item_id, unnest(identity) as e from it) where e is not null group by 1, 2",
    "expand_lattice": f"""with {ITEMS}, m as (select item_id, family, own, unnest(range(1, (1 << len(own)) - 1)) as mask from it where len(own) between 2 and 14),
s as (select family, list_filter(own, lambda f, i: ((mask >> (i - 1)) & 1) = 1) as sub, item_id from m), g as (select family, sub, min(item_id) as from_item from s group by 1, 2)
select family, array_to_string(sub, ', ') as facets, family || ' ' || array_to_string(list_transform(sub, lambda f: substring(f, instr(f, '=') + 1)), ' ') as label, from_item from g where not exists (select 1 from it where it.family = g.family and it.own = g.sub)""",
    "complete_roots": f"with {ITEMS} select family, family as formal_name, arg_min_null(kind, item_id) as kind, count(*) as n_items from it where family <> '' group by family having not bool_or(len(own) = 0)",
    "lattice_stats": f"""with {ITEMS} select count(*) as n_items, count(distinct family) as n_families, count(*) filter (where len(own) = 0) as n_roots, count(*) filter (where len(links) > 0) as n_linked,
count(*) filter (where trim(description) <> '') as n_described, count(*) filter (where coalesce(len(aliases), 0) = 0) as n_without_alias, sum(coalesce(len(subsets), 0))::bigint as n_subsets from it""",
    "link_kinds": f"with {ITEMS} select x.kind as kind, count(*) as n from (select unnest(links) as x from it) group by 1",
    "lattice_hints": f"""with {ITEMS}, u as (select family, item_id, x.url as url, x.kind as kind from (select family, item_id, unnest(links) as x from it) where trim(x.url) <> ''),
f as (select family, min(item_id) as item_id, bool_or(len(own) = 0) as root, bool_or(coalesce({_UNIQUE}, false)) as entity, count(*) as n, count(distinct nullif({_ORG}, '')) as orgs from it where family <> '' group by 1)
select 'phantom_item' as hint, family, item_id, null::varchar as detail from it where coalesce(len(aliases), 0) = 0
union all select 'sibling_identity_collision', family, min(item_id), count(*)::varchar from it group by family, facets having count(*) > 1
union all select 'branch_variant_in_formal_name', family, item_id, split_part(formal_name, '@', -1) from it where formal_name like '%@%'
union all select 'missing_family_root', family, item_id, null from f where not root
union all select 'cross_org_family', family, item_id, orgs::varchar from f where orgs > 1 and n > 1
union all select 'concept_with_no_entity', family, item_id, n::varchar from f where not entity and n > 1
union all select 'over_specified', family, item_id, aliases[1] from it where len(own) > 0 and {_ALNUM.format('aliases[1]')} = {_ALNUM.format('family')}
union all select 'same_url_duplicate', family, min(item_id), url from u group by family, url having count(distinct item_id) > 1
union all select 'same_url_cross_family', min(family), min(item_id), url from u where kind in ('hf_model', 'hf_dataset', 'vendor_docs') group by url having count(distinct family) > 1
union all select case when coalesce({_UNIQUE}, false) then 'subset_with_anchor' else 'concept_subsumed_candidate' end, a.family, a.item_id, b.item_id::varchar from it a join (select item_id, family, own from it) b on a.family = b.family and len(a.own) > 0 and len(a.own) < len(b.own) and list_has_all(b.own, a.own)
union all select 'formal_name_vs_canonical_url_mismatch', family, item_id, p from (select *, regexp_extract(links[1].url, 'huggingface\\.co/(?:datasets/)?([^/]+/[^/?#]+)', 1) as p from it where links[1].kind in ('hf_model', 'hf_dataset')) where p <> '' and lower(p) <> lower(coalesce(formal_name, ''))""",
    "item_roles": f"""with {ITEMS}, k as (select item_id, coalesce(links[1].kind, '') as kind, links[1].url as url, list_distinct(list_transform(list_filter(identity, lambda e: e is not null), lambda e: e.k)) as ks, len(list_filter(identity, lambda e: e is not null and e.k is null)) as nulls from it)
select item_id, case when ks = ['family'] and nulls = 0 then 'family-root' when kind = '' then 'unanchored' when coalesce(regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([?#].*)?'), false) then 'concept' when kind in {L.CANONICAL_LINKS!r} then 'canonical' when kind in {L.CONCEPT_LINKS!r} then 'concept' else 'other' end as role from k""",
    "edge_classes": f"""with {_IDS}, ie as (select rel_id, relation, coalesce(dependency_kind, '') as kind, s.family as sf, s.facets as sx, o.family as o_f, o.facets as ox from edges e join idf s on s.name = e.subject join idf o on o.name = e.object)
select min(rel_id) over (partition by relation, kind, sf, o_f, sx, ox) as class_id, rel_id from ie""",
    "rebuilt_lattice": f"""with {ITEMS}, {_ALIASES}, n as (select it.*, coalesce(c.canonical, formal_name) as nm from it left join c on c.name = formal_name where formal_name <> '')
select distinct on (nm) nm as name, item_id, family, kind, count(*) over (partition by nm) as alias_count from n order by nm, formal_name <> nm, item_id""",
    "hint_invented_root_alias": f"""with {ITEMS}, p as (select subject as name from merge_relations union select object from merge_relations), r as (select item_id, family, aliases from it where list_distinct(list_transform(list_filter(identity, lambda e: e is not null), lambda e: e.k)) = ['family'])
select item_id, family from r where not exists (select 1 from (select unnest(r.aliases) as a) x where x.a in (select name from p where name is not null))""",
    "hint_name_matches_subset": f"""with {ITEMS}, nm as (select item_id, unnest(list_concat([formal_name], coalesce(aliases, []))) as n from it), sl as (select item_id, n, {_SLUG.format('n')} as s from nm where n is not null),
o as (select distinct item_id, unnest([s, replace(s, '-', ''), replace(s, '-', '_'), replace(s, '+', 'plus'), replace(s, '+', '-plus'), {_ALNUM.format('n')}, replace(replace(s, '-', ''), '+', 'plus'), replace(replace(s, '-', '_'), '+', 'plus')]) as s from sl),
b as (select distinct parent_id, unnest([x, {_ALNUM.format('x')}]) as s from (select item_id as parent_id, unnest(subsets) as x from it) where x is not null) select distinct item_id, parent_id from o join b using (s) where s <> '' and item_id <> parent_id""",
    "lattice_violations": _lattice(L.violations, LINK_KINDS),
    "endpoint_identities": endpoint_identities,
    "edge_subsumption": _identified(L.edge_subsumption),
    "sibling_conflicts": _identified(L.sibling_conflicts),
}

ITEMS = r"""it0 as (select distinct on (item_id) * from lattice_items where identity is not null and item_id is not null),
fx as (select item_id, list_sort(list(distinct e.k || '=' || e.v)) as facets from (select item_id, unnest(identity) as e from it0) where trim(e.v) <> '' and e.k is not null group by 1),
it as (select it0.* replace (coalesce(family, '') as family), coalesce(facets, []) as facets, list_filter(coalesce(facets, []), lambda f: not starts_with(f, 'family=')) as own from it0 left join fx using (item_id))"""
_SUB = f"with {ITEMS}, p as (select a.family, a.item_id as parent_id, b.item_id as child_id from it a join it b on a.family = b.family and len(a.own) < len(b.own) and list_has_all(b.own, a.own))"
_SLUG = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[\s_]+', '-', 'g'), '[^a-z0-9\-+.]', '', 'g'), '-{{2,}}', '-', 'g'), '-')"
_ALNUM = "regexp_replace(replace(lower({0}), '+', 'plus'), '[^a-z0-9]', '', 'g')"
_ORG = r"lower(regexp_extract(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 1))"
_BARE = r"case when regexp_matches(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$') then regexp_extract(formal_name, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$', 2) else formal_name end"
_UNIQUE = "(len(list_filter(links, lambda x: x.kind in ('hf_model', 'hf_dataset', 'vendor_docs') and trim(x.url) <> '')) > 0)"
_IDS = rf"""{ITEMS}, {EDGES}, nm as (select formal_name, arg_min(facets, item_id) as facets from it where formal_name is not null group by 1),
en as (select distinct name from (select subject as name from edges union all select object from edges)),
ad as (select name, trim(regexp_extract(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$', 1)) as fam, string_split(regexp_extract(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$', 2), ',') as ps from en where regexp_matches(trim(name), '^\s*(.+?)\s*\[([^\]]*)\]\s*$')),
pc as (select name, fam, trim(p) as p, i from (select name, fam, unnest(ps) as p, unnest(range(len(ps))) as i from ad)),
ok as (select name from pc group by 1 having bool_and(p = '' or regexp_matches(p, '^[^=]*[^=\s][^=]*=.*\S.*$'))),
kv as (select name, trim(split_part(p, '=', 1)) as k, arg_max(trim(substring(p, instr(p, '=') + 1)), i) as v from pc where p <> '' group by 1, 2),
ak as (select ad.name, list_sort(list_concat(['family=' || fam], coalesce((select list(k || '=' || v) from kv where kv.name = ad.name and k <> 'family'), []))) as facets from ad join ok on ok.name = ad.name where fam <> ''),
ids as (select en.name, coalesce(nm.facets, ak.facets) as facets from en left join nm on nm.formal_name = en.name left join ak on ak.name = en.name where coalesce(nm.facets, ak.facets) is not null),
idf as (select name, coalesce(list_filter(facets, lambda f: starts_with(f, 'family='))[1][8:], '') as family, facets from ids)"""
_CLS = f"""with {_IDS}, ie as (select rel_id, relation, coalesce(dependency_kind, '') as kind, s.family as sf, s.facets as sx, o.family as o_f, o.facets as ox from edges e join idf s on s.name = e.subject join idf o on o.name = e.object),
c as (select relation, kind, sf, o_f, sx, ox, min(rel_id) as id from ie group by all),
c2 as (select *, list_concat(list_transform(list_filter(sx, lambda f: not starts_with(f, 'family=')), lambda f: 's:' || f), list_transform(list_filter(ox, lambda f: not starts_with(f, 'family=')), lambda f: 'o:' || f)) as own from c)"""

ORACLE = {
    "subsumed_pairs": f"{_SUB} select * from p",
    "direct_parents": f"{_SUB} select * from p where not exists (select 1 from p a join p b on a.child_id = b.parent_id where a.parent_id = p.parent_id and b.child_id = p.child_id)",
    "merge_items": """with i as (select distinct on (item_id) *, list_filter(list_transform(coalesce(links, []), lambda x: x.url), lambda u: u is not null)[1] as url from lattice_items where formal_name is not null)
select min(i.item_id) as item_id, formal_name, url, arg_min_null(family, i.item_id) as family, arg_min_null(kind, i.item_id) as kind, count(*) as merged, len(list_distinct(flatten(list(coalesce(aliases, []))))) as n_aliases from i group by formal_name, url""",
    "identity_conflicts": """with e as (select formal_name, e.k as k, e.v as v, item_id from (select distinct on (item_id) item_id, formal_name, identity from lattice_items where formal_name is not null and identity is not null) t, unnest(identity) u(e) where e.v is not null),
r as (select formal_name, k, v, row_number() over (partition by formal_name, k order by min(item_id), v) as r from e group by 1, 2, 3)
select a.formal_name, a.k, b.v as first_value, a.v as other_value from r a join r b on a.formal_name = b.formal_name and a.k = b.k and b.r = 1 where a.r > 1""",
    "family_keys": f"with {ITEMS} select family, e.k as k, min(item_id) as first_item, count(*) as n from (select family, item_id, unnest(identity) as e from it) where e is not null group by 1, 2",
    "expand_lattice": f"""with {ITEMS}, m as (select item_id, family, own, unnest(range(1, (1 << len(own)) - 1)) as mask from it where len(own) between 2 and 14),
s as (select family, list_filter(own, lambda f, i: ((mask >> (i - 1)) & 1) = 1) as sub, item_id from m), g as (select family, sub, min(item_id) as from_item from s group by 1, 2)
select family, array_to_string(sub, ', ') as facets, family || ' ' || array_to_string(list_transform(sub, lambda f: substring(f, instr(f, '=') + 1)), ' ') as label, from_item from g where not exists (select 1 from it where it.family = g.family and it.own = g.sub)""",
    "complete_roots": f"with {ITEMS} select family, family as formal_name, arg_min_null(kind, item_id) as kind, count(*) as n_items from it where family <> '' group by family having not bool_or(len(own) = 0)",
    "lattice_stats": f"""with {ITEMS} select count(*) as n_items, count(distinct family) as n_families, count(*) filter (where len(own) = 0) as n_roots, count(*) filter (where len(links) > 0) as n_linked,
count(*) filter (where trim(description) <> '') as n_described, count(*) filter (where coalesce(len(aliases), 0) = 0) as n_without_alias, sum(coalesce(len(subsets), 0))::bigint as n_subsets from it""",
    "link_kinds": f"with {ITEMS} select x.kind as kind, count(*) as n from (select unnest(links) as x from it) group by 1",
    "lattice_hints": f"""with {ITEMS}, u as (select family, item_id, x.url as url, x.kind as kind from (select family, item_id, unnest(links) as x from it) where trim(x.url) <> ''),
f as (select family, min(item_id) as item_id, bool_or(len(own) = 0) as root, bool_or(coalesce({_UNIQUE}, false)) as entity, count(*) as n, count(distinct nullif({_ORG}, '')) as orgs from it where family <> '' group by 1)
select 'phantom_item' as hint, family, item_id, null::varchar as detail from it where coalesce(len(aliases), 0) = 0
union all select 'sibling_identity_collision', family, min(item_id), count(*)::varchar from it group by family, facets having count(*) > 1
union all select 'branch_variant_in_formal_name', family, item_id, split_part(formal_name, '@', -1) from it where formal_name like '%@%'
union all select 'missing_family_root', family, item_id, null from f where not root
union all select 'cross_org_family', family, item_id, orgs::varchar from f where orgs > 1 and n > 1
union all select 'concept_with_no_entity', family, item_id, n::varchar from f where not entity and n > 1
union all select 'over_specified', family, item_id, aliases[1] from it where len(own) > 0 and {_ALNUM.format('aliases[1]')} = {_ALNUM.format('family')}
union all select 'same_url_duplicate', family, min(item_id), url from u group by family, url having count(distinct item_id) > 1
union all select 'same_url_cross_family', min(family), min(item_id), url from u where kind in ('hf_model', 'hf_dataset', 'vendor_docs') group by url having count(distinct family) > 1
union all select case when coalesce({_UNIQUE}, false) then 'subset_with_anchor' else 'concept_subsumed_candidate' end, a.family, a.item_id, b.item_id::varchar from it a join (select item_id, family, own from it) b on a.family = b.family and len(a.own) > 0 and len(a.own) < len(b.own) and list_has_all(b.own, a.own)
union all select 'formal_name_vs_canonical_url_mismatch', family, item_id, p from (select *, regexp_extract(links[1].url, 'huggingface\\.co/(?:datasets/)?([^/]+/[^/?#]+)', 1) as p from it where links[1].kind in ('hf_model', 'hf_dataset')) where p <> '' and lower(p) <> lower(coalesce(formal_name, ''))""",
    "item_roles": f"""with {ITEMS}, k as (select item_id, coalesce(links[1].kind, '') as kind, links[1].url as url, list_distinct(list_transform(list_filter(identity, lambda e: e is not null), lambda e: e.k)) as ks, len(list_filter(identity, lambda e: e is not null and e.k is null)) as nulls from it)
select item_id, case when ks = ['family'] and nulls = 0 then 'family-root' when kind = '' then 'unanchored' when coalesce(regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([?#].*)?'), false) then 'concept' when kind in {L.CANONICAL_LINKS!r} then 'canonical' when kind in {L.CONCEPT_LINKS!r} then 'concept' else 'other' end as role from k""",
    "edge_classes": f"""with {_IDS}, ie as (select rel_id, relation, coalesce(dependency_kind, '') as kind, s.family as sf, s.facets as sx, o.family as o_f, o.facets as ox from edges e join idf s on s.name = e.subject join idf o on o.name = e.object)
select min(rel_id) over (partition by relation, kind, sf, o_f, sx, ox) as class_id, rel_id from ie""",
    "rebuilt_lattice": f"""with {ITEMS}, {_ALIASES}, n as (select it.*, coalesce(c.canonical, formal_name) as nm from it left join c on c.name = formal_name where formal_name <> '')
select distinct on (nm) nm as name, item_id, family, kind, count(*) over (partition by nm) as alias_count from n order by nm, formal_name <> nm, item_id""",
    "hint_invented_root_alias": f"""with {ITEMS}, p as (select subject as name from merge_relations union select object from merge_relations), r as (select item_id, family, aliases from it where list_distinct(list_transform(list_filter(identity, lambda e: e is not null), lambda e: e.k)) = ['family'])
select item_id, family from r where not exists (select 1 from (select unnest(r.aliases) as a) x where x.a in (select name from p where name is not null))""",
    "hint_name_matches_subset": f"""with {ITEMS}, o as (select item_id, {_SLUG.format('formal_name')} as s from it union select item_id, {_SLUG.format(f'({_BARE})')} from it),
b as (select distinct item_id as parent_id, {_SLUG.format('x')} as s from (select item_id, unnest(subsets) as x from it)) select distinct item_id, parent_id from o join b using (s) where s <> '' and item_id <> parent_id""",
    "lattice_violations": f"""with i as (select distinct on (item_id) * from lattice_items where identity is not null), f as (select item_id, list_filter(identity, lambda e: e.k = 'family')[1].v as fam from i)
select item_id, 'family_facet' as rule from f where coalesce(trim(fam), '') = ''
union all select item_id, 'no_alias' from i where coalesce(len(aliases), 0) = 0
union all select item_id, 'link_kind' from i where links[1] is not null and not coalesce(links[1].kind in {LINK_KINDS!r}, false)
union all select item_id, 'link_url' from i where links[1] is not null and not coalesce(regexp_matches(links[1].url, '^https?://'), false)
union all select item_id, 'blank_subset' from i where len(list_filter(subsets, lambda s: s is null or trim(s) = '')) > 0""",
    "endpoint_identities": f"with {_IDS} select name, family, array_to_string(facets, '|') as facets from idf",
    "edge_subsumption": f"{_CLS} select a.id as general_id, b.id as specific_id from c2 a join c2 b using (relation, kind, sf, o_f) where len(a.own) < len(b.own) and list_has_all(b.own, a.own)",
    "sibling_conflicts": f"{_CLS} select a.id as first_id, b.id as second_id from c a join c b using (relation, kind, sf, sx, o_f) where a.id < b.id and not list_has_all(a.ox, b.ox) and not list_has_all(b.ox, a.ox)",
}
